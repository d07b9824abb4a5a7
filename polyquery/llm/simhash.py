"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are linked at a Hamming distance of ``max_bits`` or less, exactly:

1. Equal fingerprints collapse to one (a map-side-combined aggregation), so any
   number of exact copies costs one row per map task.
2. Two fingerprints that differ in at most ``max_bits`` bits agree on at least
   one of ``max_bits + 1`` runs of bits. Every distinct fingerprint goes to one
   key per run. A key with more than ``group_limit`` members is dealt again on
   the bits that its members do not share by key, by the same rule, until it
   fits; ``b`` free bits hold at most ``2**b`` distinct fingerprints, so that
   ends, and no task ever holds an unbounded group.
3. Within a key the members are sorted by Gray rank and packed into a tree. A
   node keeps the bits that all its members share; the differences of two nodes'
   shared bits bound every member pair from below, so whole groups are pruned
   from accumulated differences. Node pairs that are already connected are
   skipped, so a dense group costs no quadratic work, and each key returns a
   spanning forest (fewer links than members) instead of pairs.
4. Components of the links: alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyquery.llm.common import materialise, mix64, ship, texts, trimmed
from polyquery.llm.components import components

FAN = 8
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text (unsigned); 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), dtype="<u8", count=n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row of ``docs``.

    A null text has no words (fingerprint 0); a null doc_id stays null; repeated
    rows each get a row.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, int] = {}
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text")):
                t = text.as_py()
                if t not in seen:
                    seen[t] = fingerprint(t, shingle, seed)
                out[i] = seen[t]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, fp long")


def signatures(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """SimHashes of ``64 * words`` bits of several runs of hashes: run i is ``hashes[at[i] : at[i + 1]]``.

    Word w has the bits that are set in over half of the run's hashes, each mixed
    with the w-th salt. A run without hashes has no bits.
    """
    n = np.diff(at)
    out = np.zeros((len(n), words), np.uint64)
    used = np.flatnonzero(n)
    if not len(used):
        return out
    # 255 hashes at most are counted together: eight counters of a byte in each sum
    pieces = -(-n[used] // 255)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(at[used], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.uint64(0x0101010101010101)
    salt = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for w in range(words):
        mixed = mix64(hashes ^ salt[w])
        for j in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(j)) & ones, start)
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            # bit j of byte b comes to bit b of byte j: any order of the bits does
            out[used, w] |= np.packbits(2 * counts > n[used, None], axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * j)
    return out


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all items that the pairs (a, b) connect the least of their labels, in place."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


class GrayTree:
    """The hierarchical index of fingerprints sorted by (key, Gray rank).

    ``more`` (one row of further words for each fingerprint) makes them longer; the tree is over the first word.
    """

    def __init__(self, key: np.ndarray, fps: np.ndarray, more: np.ndarray | None = None):
        self.order = order = np.lexsort((gray_rank(fps), key))
        self.key, self.fps = key[order], fps[order]
        self.more = None if more is None else more[order]
        self.levels: list[dict[str, np.ndarray]] = []
        owner, low, high = self.key, self.fps, self.fps
        while len(owner):
            new = np.concatenate(([True], owner[1:] != owner[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(owner)))
            place = np.arange(len(owner)) - np.repeat(first, size)
            start = np.flatnonzero(place % FAN == 0)
            node = {"start": start, "end": np.append(start[1:], len(owner)), "and": np.bitwise_and.reduceat(low, start), "or": np.bitwise_or.reduceat(high, start)}
            node["shared"] = ~(node["and"] ^ node["or"])
            owner = owner[start]
            only = np.concatenate(([True], owner[1:] != owner[:-1])) & np.concatenate((owner[1:] != owner[:-1], [True]))
            node["root"] = only
            self.levels.append(node)
            low, high = node["and"], node["or"]
            if only.all():
                break

    def forest(self, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fewest links (fp, fp) that connect what distances of max_bits or less connect within each key."""
        label = self.labels(max_bits)
        other = np.flatnonzero(label != np.arange(len(label)))
        return self.fps[other], self.fps[label[other]]

    def _whole(self, x: np.ndarray, y: np.ndarray, whole_bits: int | None) -> np.ndarray:
        """Of pairs whose first words are near: all words are."""
        if self.more is None:
            return np.ones(len(x), bool)
        bits = np.bitwise_count(self.fps[x] ^ self.fps[y]).astype(np.int64) + np.bitwise_count(self.more[x] ^ self.more[y]).sum(axis=1, dtype=np.int64)
        return bits <= whole_bits

    def labels(self, max_bits: int, whole_bits: int | None = None) -> np.ndarray:
        """For each place in the order, the least place that distances connect it with within its key.

        Distances of max_bits or less of the first word, with ``more`` also of whole_bits or less of all words.
        """
        n = len(self.fps)
        label = np.arange(n)
        if n < 2:
            return label
        near = (self.key[1:] == self.key[:-1]) & (np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= max_bits)
        left = np.flatnonzero(near)
        left = left[self._whole(left, left + 1, whole_bits)]
        _connect(label, left, left + 1)
        top = len(self.levels) - 1
        stack: list[tuple[int, np.ndarray, np.ndarray]] = []
        for h in range(top, -1, -1):
            roots = self.levels[h]["root"]
            if h < top:  # a root's only child is no root of its own
                above = self.levels[h + 1]
                covered = np.zeros(len(roots), bool)
                single = (above["end"] - above["start"]) == 1
                covered[above["start"][single & above["root"]]] = True
                roots = roots & ~covered
            r = np.flatnonzero(roots)
            if len(r):
                stack.append((h, r, r))
        while stack:
            h, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(h, a[:half], b[:half]), (h, a[half:], b[half:])]
                continue
            node = self.levels[h]
            far = np.bitwise_count((node["and"][a] ^ node["and"][b]) & node["shared"][a] & node["shared"][b])
            keep = far <= max_bits
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            same = self._joined(h, a, b, label)
            a, b = a[~same], b[~same]
            if not len(a):
                continue
            na, nb = node["end"][a] - node["start"][a], node["end"][b] - node["start"][b]
            count = na * nb
            if count.sum() > 4 * PAIRS_AT_ONCE and len(a) > 1:
                half = len(a) // 2
                stack += [(h, a[:half], b[:half]), (h, a[half:], b[half:])]
                continue
            if not h:
                # a node's places, its last one repeated where it has fewer
                x = np.minimum(node["start"][a][:, None] + np.arange(FAN), node["end"][a][:, None] - 1)
                y = np.minimum(node["start"][b][:, None] + np.arange(FAN), node["end"][b][:, None] - 1)
                hit = np.flatnonzero(np.bitwise_count(self.fps[x][:, :, None] ^ self.fps[y][:, None, :]) <= max_bits)
                x, y = x.ravel()[hit // FAN], y.ravel()[hit // FAN**2 * FAN + hit % FAN]
                use = label[x] != label[y]
                x, y = x[use], y[use]
                use = self._whole(x, y, whole_bits)
                _connect(label, x[use], y[use])
                continue
            which = np.repeat(np.arange(len(a)), count)
            place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            x = node["start"][a][which] + place // nb[which]
            y = node["start"][b][which] + place % nb[which]
            use = (a[which] != b[which]) | (x <= y)
            stack.append((h - 1, x[use], y[use]))
        return label

    def _joined(self, h: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Of node pairs: all members of both are connected already."""
        low = high = label
        for node in self.levels[: h + 1]:
            low, high = np.minimum.reduceat(low, node["start"]), np.maximum.reduceat(high, node["start"])
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])


def _deal(max_bits: int):
    """Rows (key, fp, free) to one row for each run of the free bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, free = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "free"))
            for mask in np.unique(free):
                rows = np.flatnonzero(free == mask)
                bits = [i for i in range(64) if int(mask) >> i & 1]
                for k, run_bits in enumerate(np.array_split(np.array(bits, dtype=np.uint64), max_bits + 1)):
                    part = np.uint64(sum(1 << int(i) for i in run_bits))
                    salt = np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
                    child = mix64(key[rows] + salt) ^ mix64((fp[rows] & part) ^ salt)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (child, fp[rows], np.full(len(rows), mask & ~part, np.uint64))], ["key", "fp", "free"])

    return run


def _link(max_bits: int, hold: int):
    """Sorted rows (key, fp) to links; whole keys are taken together, about ``hold`` rows at once."""

    def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = GrayTree(key, fp).forest(max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0
        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= hold:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
                if cut:
                    yield flush(key[:cut], fp[:cut])
                keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield flush(np.concatenate(keys), np.concatenate(fps))

    return run


def links(distinct: DataFrame, max_bits: int = 4, group_limit: int = 1 << 15) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``distinct.fp`` as distances of max_bits or less do."""
    spark = distinct.sparkSession
    ship(spark)
    schema = "key long, fp long, free long"
    dealt = distinct.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(-1).cast("long").alias("free")).mapInArrow(_deal(max_bits), schema)
    found = None
    for _ in range(64):
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.max("free").alias("open"))
        hot = materialise(sizes.where((F.col("n") > group_limit) & (F.bit_count("open") > 15)).select("key"), "simhash-hot")
        is_hot = not hot.isEmpty()
        part = dealt.join(hot, "key", "left_anti") if is_hot else dealt
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        edges = part.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link(max_bits, 2 * group_limit), "a long, b long")
        found = edges if found is None else found.unionAll(edges)
        if not is_hot:
            break
        dealt = materialise(dealt.join(hot, "key", "left_semi"), "simhash-deal").mapInArrow(_deal(max_bits), schema)
    return found.distinct()


def groups(docs: DataFrame, max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the least doc_id that links reach) of every row.

    Nulls: a null text has fingerprint 0 and links like any other; a null doc_id
    never is a component_id unless its whole component has none. An empty table
    gives an empty result. Other columns of ``docs`` are ignored.
    """
    prints = materialise(fingerprints(docs, shingle), "simhash-fp")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = materialise(links(distinct.select("fp"), max_bits), "simhash-links")
    if edges.isEmpty():
        return prints.join(distinct.withColumnRenamed("first_id", "component_id"), "fp").select("doc_id", "fp", "component_id")
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written first, so that the join alone can be split where a root has very many fingerprints
    least = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = materialise(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The op3 contract: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's least; of rows with one doc_id the one of the least text stays.

    ``found`` has doc_id and component_id (default: those of :func:`groups`). Rows
    without a doc_id can't stand for a group and are all kept. An empty table
    gives an empty result.
    """
    found = groups(docs) if found is None else found
    ids = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    # documents are shuffled at every size, never the ids broadcast: they grow with the input
    kept = docs.join(ids.hint("merge"), docs["doc_id"] == ids["kept_id"], "left_semi")
    again = docs.where(docs["doc_id"].isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"))
    without = docs.where(docs["doc_id"].isNull())
    again = materialise(again, "repeated-ids")
    if again.isEmpty():
        return kept.unionAll(without)
    once = kept.join(again, kept["doc_id"] == again["again_id"], "left_anti")
    # only rows of a repeated doc_id are compared with each other
    several = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*[c for c in docs.columns]))
    place = "place"
    while place in [c.lower() for c in docs.columns]:
        place += "_"
    first = several.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return once.unionAll(first).unionAll(without)
