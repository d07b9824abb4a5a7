"""Shared plumbing: shared work folders, Arrow text access, batch slicing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels look at in one go.
SLICE_BYTES = 1 << 20
REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Text that goes to a Python worker at once; Spark's own bound of 64 MB is held several times over in a task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed, and hand them small batches."""
    spark.conf.set(BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir; in local mode without that, below the temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/polyquery-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release() -> None:
    """Give memory that is free inside this process back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with :func:`release` behind its last batch."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; also the folder."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`work_dir`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id (long), text (string) and the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = at.astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Hashes of any range of a sequence from one running sum.

    ``sum += T[symbol] * r**i`` modulo 2**64 with odd ``r``: the hash of a range
    is the difference of two sums times ``r**-start``, the same wherever the
    range stands.
    """

    def __init__(self, multiplier: int):
        self.r = np.uint64(multiplier | 1)
        self.inv = np.uint64(pow(int(self.r), -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, base in (("_up", self.r), ("_down", self.inv)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self._up, self._down

    def sums(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(sums))
        return (sums[end] - sums[start]) * down[start]


#: Random values for bytes, the same in every process.
BYTE_A = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_B = np.random.Generator(np.random.PCG64(2)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words of all texts, and the text that each is in."""
    inside = ~SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    if len(cuts):  # texts that touch: a word ends where its text does
        cuts = np.unique(cuts)
        joined = cuts[inside[cuts] & inside[cuts - 1]]
        if len(joined):
            starts = np.union1d(starts, joined)
            ends = np.union1d(ends, joined)
    return starts, ends, np.searchsorted(at, starts, side="right") - 1
