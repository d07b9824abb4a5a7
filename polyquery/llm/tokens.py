"""Token ids as Arrow stream files of fixed-size lists.

Format ``pqs1``: every file is one Arrow IPC stream. Its schema metadata holds
``format``, ``shard``, ``part``, ``sequence_length`` and ``end_id``; each row is

``ids``   fixed-size list of ``sequence_length`` unsigned integers (16 bits if
          the vocabulary fits, else 32), token ids packed one after the other;
``mask``  fixed-size list of booleans, false for the padding of the last row;
``docs``  list of (doc_id, end): the documents that end in this row and the
          offset, in the file's ids, behind their last id.

Equal-length buffers mean that row k of a mapped batch is a slice, without
copying (:func:`open_file`). Files are written by Spark's own file committer,
one row a file, so a lost executor leaves no half file and any file system that
Spark reaches will do. The byte behind the stream's end mark is the writer's
line end, which Arrow readers never reach.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquery.llm.common import materialise, ship, sliced, text_bytes, texts, trimmed, work_dir

SEQUENCE = 2048
#: Text that one shard covers, and ids after which a writer starts the shard's next file.
SHARD_TEXT = 24 << 20
PART_IDS = 4 << 20
ROWS_A_BATCH = 256
#: Bytes of text that are encoded in one go.
ENCODE_TEXT = 8 << 20
#: How a byte-level vocabulary parts text, and what it takes for white space (fixed values).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with any of these is encoded as a whole: white space that isn't one blank or one line feed between other characters.
ODD = ("  ", "\n\n", " \n", "\n ", *(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31)))
ODD_WIDE = tuple(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Marks that end a word in one part of their own.
MARKS = ".,!?;:|*&%$#"
#: Words that a memory holds before it starts anew.
KEPT_WORDS = 200_000


def _known_characters() -> re.Pattern:
    """Finds a character that Unicode tables of different versions may class differently: one unassigned here, or beyond U+FFFF."""
    sure, begin = [], None
    for code in range(0x80, 0x10001):
        assigned = code < 0x10000 and unicodedata.category(chr(code)) not in ("Cn", "Cs")
        if assigned and begin is None:
            begin = code
        elif not assigned and begin is not None:
            sure.append(f"{re.escape(chr(begin))}-{re.escape(chr(code - 1))}")
            begin = None
    return re.compile(f"[^\\x00-\\x7f{''.join(sure)}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Encoder:
    """encode(text) -> little-endian ids, the same as the tokenizer's own, word by word with a bounded memory.

    Parting a text into words here and in the library agrees only for characters
    that both know, so a text with any other one (:func:`_known_characters`) is
    encoded as a whole by the library, like one with unusual white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        if sys.byteorder != "little":
            raise RuntimeError("the file format is little-endian")
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.parts = regex.compile(PARTS)
        self.unsure = _known_characters()
        self.known: dict[str, bytes] = {}
        self.first = _Words(self, "")
        self.later = _Words(self, " ")
        self.newline = self.piece("\n")
        self.by_words = self._agrees()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _agrees(self) -> bool:
        """Whether word by word is the same, for this vocabulary."""
        probe = "It's 12 O'Neill-ish, naïve…\nΩmega 漢字 don't (3.14)!! x_y\nfoo​bar 😀 é"
        return self._words(probe) == self.whole(probe)

    def piece(self, part: str) -> bytes:
        """The ids of one part of a text, straight from the library's merges."""
        mapped = part.replace(" ", self.letters[32]) if part.isascii() and part.lstrip(" ").isalpha() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        return self.mapped(mapped)

    def mapped(self, letters: str) -> bytes:
        """The ids of one part that is written in the vocabulary's letters."""
        return array(self.code, [t.id for t in self.tok.model.tokenize(letters)]).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a run of other characters, with its lead."""
        out, known = [], self.known
        for part in self.parts.findall(word):
            ids = known.get(part)
            if ids is None:
                ids = self.piece(part)
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[part] = ids
            out.append(ids)
        return b"".join(out)

    def _words(self, text: str) -> bytes:
        out: list[bytes] = []
        first, later = self.first, self.later
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            if len(words) > 1:
                out.extend(map(later.__getitem__, words[1:]))
            out.append(self.newline)
        out.pop()
        return b"".join(out)

    def _odd(self, text: str) -> bool:
        if text[0] in " \n" or text[-1] in " \n" or any(s in text for s in self.specials) or any(s in text for s in ODD):
            return True
        return not text.isascii() and (self.unsure.search(text) is not None or any(s in text for s in ODD_WIDE))

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end_id`` behind each, and how many each has.

        Each different word of the texts is looked up once; ids are put together
        by its number.
        """
        n = len(texts)
        body = texts.to_pylist()
        plain = np.array([bool(t) and self.by_words and not self._odd(t) for t in body], bool)
        sizes = np.zeros(n, np.int64)
        flat = np.zeros(0, self.dtype)
        if plain.any():
            # a word behind a line feed keeps it; none of these texts has a blank beside a line feed
            parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)).cast(pa.large_string()), "\n", " \n"), " ")
            begin = parts.offsets.to_numpy()
            coded = parts.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
            begin = begin - begin[0]
            first, later, newline = self.first, self.later, self.newline
            words = coded.dictionary.to_pylist()
            found = [newline + first[w[1:]] if w[0] == "\n" else later[w] for w in words]
            which = coded.indices.to_numpy().astype(np.int64)
            found += [first[words[k]] for k in which[begin[:-1]].tolist()]  # nothing leads a text's own first word
            which[begin[:-1]] = len(words) + np.arange(len(begin) - 1)
            long = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
            ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(long)))), pa.Array.from_buffers(kind, int(long.sum()), [None, pa.py_buffer(b"".join(found))]))
            flat = ids.take(pa.array(which)).flatten().to_numpy()
            sizes[plain] = np.add.reduceat(long[which], begin[:-1])
        if not plain.all():
            rest = {i: np.frombuffer(self.encode(body[i]), self.dtype) for i in np.flatnonzero(~plain).tolist()}
            at = np.concatenate(([0], np.cumsum(sizes[plain])))
            turn = np.cumsum(plain) - 1
            flat = np.concatenate([rest[i] if i in rest else flat[at[turn[i]] : at[turn[i] + 1]] for i in range(n)] or [flat])
            for i, x in rest.items():
                sizes[i] = len(x)
        return np.insert(flat, np.cumsum(sizes), end_id).astype(self.dtype), sizes + 1

    def forget(self) -> None:
        """Empty the memories: Python workers outlive their tasks."""
        for memory in (self.known, self.first, self.later):
            memory.clear()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or self._odd(text):
            return self.whole(text)
        return self._words(text)


class _Words(dict):
    """Words of letters met so far, up to a bound, with what leads them in the text."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.letters = "".join(encoder.letters[ord(c)] for c in lead)

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.encoder.mapped(self.letters + (word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.encoder.letters)))
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
            return ids
        stem = word.rstrip(MARKS)
        if stem.isalpha():  # letters, then marks: two parts
            marks = word[len(stem) :]
            ids = self.encoder.known.get(marks)
            return self[stem] + (self.encoder.word(marks) if ids is None else ids)
        return self.encoder.word(self.lead + word)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _file(shard: int, part: int, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, length: int, end_id: int) -> bytes:
    """One file's bytes."""
    kind = pa.uint16() if ids.dtype.itemsize == 2 else pa.uint32()
    rows = max(1, -(-len(ids) // length))
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int64())])))], {"format": "pqs1", "shard": str(shard), "part": str(part), "sequence_length": str(length), "end_id": str(end_id)})
    ends = np.cumsum(sizes)
    row_of = np.maximum(ends - 1, 0) // length
    counts = np.bincount(row_of, minlength=rows) if len(ends) else np.zeros(rows, np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(docs, pa.int64()), pa.array(ends)], ["doc_id", "end"]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for k in range(0, rows, ROWS_A_BATCH):
            n = min(ROWS_A_BATCH, rows - k)
            some = ids[k * length : (k + n) * length]
            flat = np.zeros(n * length, ids.dtype)
            flat[: len(some)] = some
            mask = np.zeros(n * length, bool)
            mask[: len(some)] = True
            out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length), listed.slice(k, n)], schema=schema))
    return sink.getvalue().to_pybytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = SEQUENCE, shard_text: int = SHARD_TEXT) -> None:
    """Encode ``docs`` and write them below ``path`` in ascending doc_id order.

    Shards are range partitions of (doc_id, a hash of the text), so the rows of
    one doc_id spread as well; a task encodes its sorted texts and streams them
    into files of about PART_IDS ids, a document being whole in one file. Null
    texts give the end id alone; rows without a doc_id come first; rows with one
    doc_id stay next to each other, in the order of their texts' hashes. An empty
    table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    n = max(1, -(-text_bytes(docs) // shard_text))
    own = texts(docs).withColumn("place", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("place"))
    ordered = own.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        shard, part = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            body = _file(shard, part, names, np.concatenate(sizes), np.concatenate(ids), length, end_id)
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["value"])

        try:
            held = 0
            for batch in sliced(batches, ENCODE_TEXT):
                flat, size = enc.encode_all(batch.column("text"), end_id)
                own, ends = batch.column("doc_id").to_pylist(), np.cumsum(size)
                begin = 0
                while begin < len(size):  # documents until the file is full
                    base = ends[begin - 1] if begin else 0
                    cut = min(len(size), int(np.searchsorted(ends, base + PART_IDS - held)) + 1)
                    ids.append(flat[base : ends[cut - 1]])
                    sizes.append(size[begin:cut])
                    names += own[begin:cut]
                    held += int(ends[cut - 1] - base)
                    begin = cut
                    if held >= PART_IDS:
                        yield flush()
                        part, ids, sizes, names, held = part + 1, [], [], [], 0
            if names:
                yield flush()
        finally:
            enc.forget()

    files = ordered.select("doc_id", "text").mapInArrow(trimmed(run), "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def open_file(body: bytes | memoryview | pa.Buffer) -> tuple[dict[str, str], list[pa.RecordBatch]]:
    """A file's metadata and batches, as views of ``body``."""
    with pa.ipc.open_stream(pa.py_buffer(body) if not isinstance(body, pa.Buffer) else body) as stream:
        meta = {k.decode(): v.decode() for k, v in (stream.schema.metadata or {}).items()}
        return meta, list(stream)


def sequence(batch: pa.RecordBatch, row: int, name: str = "ids") -> np.ndarray | pa.Array:
    """Row ``row`` of ids (or mask) of a batch, as a view."""
    column = batch.column(name)
    length = column.type.list_size
    flat = column.values.slice((column.offset + row) * length, length)
    return flat.to_numpy() if name == "ids" else flat


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, part of every document of the files below ``path``."""
    ship(spark)
    schema = "shard int, part int, place long, doc_id long, n_tokens long, ids_crc32 long, before long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("content"):
                meta, parts = open_file(body.as_buffer())
                ids = np.concatenate([p.column("ids").flatten().to_numpy() for p in parts])
                docs = pa.concat_arrays([p.column("docs").flatten() for p in parts])
                ends = docs.field("end").to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(meta["shard"]), np.int32)), pa.array(np.full(n, int(meta["part"]), np.int32)), pa.array(np.arange(n, dtype=np.int64)), docs.field("doc_id"), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(starts)], ["shard", "part", "place", "doc_id", "n_tokens", "ids_crc32", "before"])

    # a narrow table, so that files are read once for it and for the totals
    rows = materialise(spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(run), schema), "token-rows")
    # one row a file: what all files before it hold
    sums = rows.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(offsets, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "part")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The op7 contract: write the files to the shared folder and report the documents that they hold."""
    spark = docs.sparkSession
    path = work_dir(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    if not _any(spark, path):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, part int")
    return read(spark, path)


def _any(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))
    return found is not None and any(s.getLen() > 0 for s in found)
