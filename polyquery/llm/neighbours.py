"""Nearest neighbours through shifted Hilbert curves.

1. Equal vectors collapse to one with its smallest ids (a partial limit before
   the shuffle), so a vector that a third of the rows share is one point.
2. Vectors are projected to a few dimensions by ``curves`` different random
   rotations, shifted and laid on a Hilbert curve each; a bounded sample gives the
   quantiles that cut each curve into cells. Runs of cells are the range
   partitions that Spark deals points to. A cell of more than ``CELL_ROWS``
   points is parted by a hash of the point.
3. A query visits the cells around its own key on every curve; a cell is one
   matrix product. Lists of the best of each cell merge by query and rerank.

The sample also says how wide the windows have to be: of its own nearest
neighbours ``RECALL`` must be inside a window of some curve. Vectors with
structure do with narrow ones, vectors without any need wide ones (a neighbour
then is hardly nearer than chance).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyquery.llm.common import materialise, mix64, ship, trimmed

DIMENSIONS = 8
CURVES = 16
#: Share of the sample's neighbours that windows must cover, the queries of the sample that are asked, and the rows that a window covers at least.
RECALL = 0.96
ASKED = 400
LEAST_ROWS = 400
CELL_ROWS = 1 << 14
#: Vectors that the quantiles are fitted on, at most (about).
SAMPLE = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates under 2**bits (rows of ``cells``); dimensions * bits <= 64.

    Gray-code state walk from the highest bits on: each level's corner is rotated
    and reflected into the curve's local frame and yields ``dimensions`` bits.
    """
    n, d = cells.shape
    x = cells.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    entry = np.zeros(n, np.uint64)
    turn = np.zeros(n, np.uint64)
    full = np.uint64((1 << d) - 1)
    size = np.uint64(d)
    one = np.uint64(1)
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.uint64)
        for k in range(d):
            corner |= (x[:, k] >> np.uint64(level) & one) << np.uint64(k)
        local = corner ^ entry
        by = (turn + one) % size
        local = (local >> by | local << (size - by)) & full
        rank = local.copy()
        shift = 1
        while shift < d:
            rank ^= rank >> np.uint64(shift)
            shift *= 2
        key = key << size | rank
        # the next frame: where the curve enters this corner's cell and along which axis it leaves
        even = np.where(rank == 0, np.uint64(0), (rank - one) & ~one)
        begin = even ^ even >> one
        begin = (begin << by | begin >> (size - by)) & full
        flips = np.where(rank & one == 1, rank, np.where(rank == 0, np.uint64(0), rank - one))
        axis = np.where(flips == 0, np.uint64(0), _trailing_ones(flips)) % size
        entry = entry ^ begin
        turn = (turn + axis + one) % size
    return key


def _trailing_ones(x: np.ndarray) -> np.ndarray:
    low = ~x & (x + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)).astype(np.uint64)


@dataclass
class Curves:
    """Rotations, shifts, scales and cell bounds of every curve."""

    turns: np.ndarray  # curves x length x dimensions
    low: np.ndarray
    span: np.ndarray
    bits: int
    bounds: list[np.ndarray]

    def cells(self, unit: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(unit, curve), side="right").astype(np.int32)

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        place = (unit @ self.turns[curve] - self.low[curve]) / self.span[curve]
        return hilbert((np.clip(place, 0, 1 - 1e-12) * (1 << self.bits)).astype(np.uint64), self.bits)


def fit(sample: np.ndarray, cells: int, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = 7) -> Curves:
    """Curves whose cells hold like numbers of ``sample``'s unit vectors."""
    rng = np.random.default_rng(seed)
    length = sample.shape[1]
    dimensions = min(dimensions, length)
    turns = np.stack([np.linalg.qr(rng.normal(size=(length, length)))[0][:, :dimensions] for _ in range(curves)])
    low, span = np.empty((curves, dimensions)), np.empty((curves, dimensions))
    for c in range(curves):
        p = sample @ turns[c]
        a, b = p.min(axis=0), p.max(axis=0)
        wide = np.maximum(b - a, 1e-9)
        shift = rng.uniform(0, 0.25, dimensions) * wide
        low[c], span[c] = a - shift, wide * 1.25
    out = Curves(turns, low, span, max(1, min(16, 62 // dimensions)), [])
    for c in range(curves):
        keys = np.sort(out.keys(sample, c))
        out.bounds.append(np.unique(keys[(np.arange(1, cells) * len(keys)) // cells]) if cells > 1 else keys[:0])
    return out


def window(sample: np.ndarray, curves: Curves, k: int, recall: float = RECALL, asked: int = ASKED) -> float:
    """The share of a curve that windows must have for ``recall`` of the ``k`` nearest of some of ``sample``'s unit vectors."""
    n = len(sample)
    if n <= k + 1:
        return 1.0
    some = np.linspace(0, n - 1, min(asked, n)).astype(np.int64)
    near = np.empty((len(some), k), np.int64)
    for a in range(0, len(some), 64):
        rough = sample[some[a : a + 64]] @ sample.T
        rough[np.arange(len(rough)), some[a : a + 64]] = -2.0
        near[a : a + 64] = np.argpartition(-rough, k - 1, axis=1)[:, :k]
    far = np.full(near.shape, n)
    for c in range(len(curves.turns)):
        place = np.empty(n, np.int64)
        place[np.argsort(curves.keys(sample, c), kind="stable")] = np.arange(n)
        far = np.minimum(far, np.abs(place[near] - place[some][:, None]))
    return min(1.0, 2.0 * float(np.quantile(far, recall)) / n)


def _usable(column: str = "embedding"):
    """Vectors without nulls, non-finite parts or zero length."""
    v = F.col(column)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, share: float | None = None, dimensions: int = DIMENSIONS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id is divisible by ``every``.

    ``share`` is the part of a curve that a window covers (default: fitted by
    :func:`window`). Vectors that are null, zero or hold a null or non-finite
    part, and rows without a vec_id, take no part; neither do vectors of another
    length than the most common one. Cosines that agree to 12 decimals are tied;
    ties go to the smaller vec_id. Rows that repeat a vec_id and its vector count
    once. No usable vector: no row.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & _usable())
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("embedding") == lengths["n"])
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    asks = rows.where(F.col("vec_id") % every == 0).distinct()
    points = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = points.join(asks.select("embedding").distinct().withColumn("asked", F.lit(True)), "embedding", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    points = materialise(points, "ann-points")
    n = points.count()
    size = int(np.clip(n // 64, 16, cell_rows))
    some = points.where(F.pmod(F.xxhash64("ids"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n))).select("embedding").toPandas()["embedding"]
    if not len(some):
        some = points.select("embedding").limit(1).toPandas()["embedding"]
    sample = scaled(np.stack(some.to_numpy()).astype(float))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    cells = max(1, min(-(-n // size), len(sample)))
    fitted = fit(sample, cells, curves, dimensions)
    share = window(sample, fitted, k) if share is None else share
    held = spark.sparkContext.broadcast(fitted)
    reach = max(1, int(np.ceil(max(share * n, LEAST_ROWS) * cells / n / 2)))
    subs = max(1, -(-n // (cells * cell_rows)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * curves // (4 * cell_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every point to its cell on every curve, and asked points to the cells around as well."""
        c = held.value

        def dealt(batch: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, curve: int, sub: np.ndarray, ask: bool) -> pa.RecordBatch:
            take = pa.array(rows)
            key = (np.int64(curve) * cells + cell) * subs + sub
            part = key * parts // (curves * cells * subs)
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), pa.array(np.full(len(rows), ask)), batch.column("embedding").take(take), batch.column("ids").take(take)], ["part", "cell", "ask", "embedding", "ids"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v = scaled(_matrix(batch.column("embedding"), lengths["n"]))
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
                least = np.array([x[0] for x in batch.column("ids").to_pylist()], np.int64)
                sub = (mix64(least.view(np.uint64)) % np.uint64(subs)).astype(np.int64)
                for curve in range(curves):
                    cell = c.cells(unit, curve).astype(np.int64)
                    yield dealt(batch, np.arange(len(v)), cell, curve, sub, False)
                    if len(asked):
                        around = (cell[asked][:, None] + np.arange(-reach, reach + 1)).repeat(subs, axis=1)
                        inside = (around >= 0) & (around < cells)
                        every_sub = np.broadcast_to(np.tile(np.arange(subs), 2 * reach + 1), around.shape)
                        yield dealt(batch, np.repeat(asked, inside.sum(axis=1)), around[inside], curve, every_sub[inside], True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (points of a cell, then who asks) to the best lists of each who asks."""
        now, parts, body = None, [], None
        for batch in batches:
            key = batch.column("cell").to_numpy()
            ask = batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(ask.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(int(a), int(b - a))
                if now is None or key[a] != now:
                    now, parts, body = key[a], [], None
                if not ask[a]:
                    parts.append(part)
                    body = None
                elif parts:
                    if body is None:
                        v = scaled(np.concatenate([_matrix(p.column("embedding"), lengths["n"]) for p in parts]))
                        body = (v, np.sqrt((v * v).sum(axis=1)), [x for p in parts for x in p.column("ids").to_pylist()])
                    yield _best(part, body, lengths["n"], k + 1)

    fields = "part int, cell long, ask boolean, embedding array<double>, ids array<long>"
    dealt = points.select("embedding", "ids", "asked").mapInArrow(trimmed(deal), fields)
    lists = dealt.repartitionById(parts, "part").sortWithinPartitions("cell", "ask").drop("part").mapInArrow(trimmed(search), "point long, best array<struct<far: double, vec_id: long, score: double>>")
    merged = lists.groupBy("point").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))
    named = points.where("asked").select("embedding", F.element_at("ids", 1).alias("point")).join(merged, "point").select("embedding", "best")
    own = asks.join(named, "embedding").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that their largest parts are near 1: lengths neither vanish nor overflow, angles stay."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) if len(v) else v


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _best(asks: pa.RecordBatch, body: tuple[np.ndarray, np.ndarray, list[list[int]]], length: int, k: int) -> pa.RecordBatch:
    """For every asking point its ``k`` nearest ids among the points of a cell; all that may tie with the last are ranked exactly."""
    v, norm, ids = body
    q = scaled(_matrix(asks.column("embedding"), length))
    out, points = [], []
    own = asks.column("ids").to_pylist()
    for a in range(0, len(q), 256):
        x = q[a : a + 256]
        rough = (x @ v.T) / (norm * np.sqrt((x * x).sum(axis=1))[:, None])
        take = min(len(v), k)
        least = np.partition(rough, len(v) - take, axis=1)[:, len(v) - take]
        for i, row in enumerate(rough >= least[:, None] - 1e-9):
            near = np.flatnonzero(row)
            # the same sum in whatever cell a pair meets
            exact = (v[near] * x[i]).sum(axis=1) / (norm[near] * np.sqrt((x[i] * x[i]).sum()))
            best = sorted((-round(float(s), 12), d, float(s)) for s, r in zip(exact, near.tolist()) for d in ids[r])[:k]
            points.append(own[a + i][0])
            out.append([{"far": f, "vec_id": d, "score": s} for f, d, s in best])
    return pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array(out, pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64()), ("score", pa.float64())])))], ["point", "best"])


def query(vectors: DataFrame) -> DataFrame:
    """The op9 contract."""
    return nearest(vectors)
