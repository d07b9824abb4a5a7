"""Near-duplicates by the Jaccard similarity of five-word shingles, found by SimHash.

1. Every text becomes its set of shingle hashes and their SimHash of ``BANDS * RUN``
   bits. Equal sets are linked by a 128-bit hash of the set, so any number of copies
   costs one row each from here.
2. Of the different sets, each of ``BANDS`` runs of ``RUN`` bits is a key, as op3's
   runs are. Two bits of sets of similarity 0.8 differ with a chance p of 0.151
   (arccos(2 s / (1 + s)) / pi), so the sets share no key once in a million pairs,
   (1 - (1 - p)**RUN)**BANDS.
3. Within a key op3's Gray-order tree connects the fingerprints, the first ``WORDS``
   words, that differ in at most ``FIRST_BITS`` bits of the first word and
   ``WHOLE_BITS`` of all: at 0.8 all but 2 and 0.4 pairs in ten million do, of
   unlike texts 2 in a hundred million. What is connected within a key is a group.
   A key of more than ``HOLD`` rows is one group whole.
4. Groups that share documents are one pool, so a document is in one: each document
   ties its groups to its least one, and the ties' components, as in op3, are the
   pools. A pool of many or long sets is dealt into blocks by a hash; its first
   document is in each.
5. In a block all pairs that nothing connects yet are compared by their whole
   sets; only a similarity of ``LEAST`` or more links.
6. In pools of several blocks, the documents that are not connected with the first
   one are compared with all others as well, block by block; pairs that are
   connected by then are left out. A pool of copies so costs what its rows cost.
7. Components as in op3.

The bits of two sets differ by p only about where the sets are small. Of sets of
0.8 or more that differ the worst are 4 shingles in 5, with 0.1875: 4 in ten
thousand such pairs are missed. All figures of 2. and 3. are by calculation.

op3's 64 bits and 4 differing ones find few such pairs: at 0.8 two texts differ in
10 of 64 bits on average, so the fingerprint is longer and the keys are more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import materialise, mix64, ship, sliced, texts, trimmed
from polyquery.llm.components import components
from polyquery.llm.simhash import GrayTree, signatures

SHINGLE = 5
LEAST = 0.8
#: Keys of a set and the bits of each.
BANDS, RUN = 92, 12
#: Words of 64 bits of a SimHash that hold all keys, and those that are compared within a key.
ALL_WORDS, WORDS = -(-BANDS * RUN // 64), 3
FINGERPRINT = [f"f{w}" for w in range(WORDS)]
#: Most differing bits of the first word and of all words compared.
FIRST_BITS, WHOLE_BITS = 26, 58
#: Shingle hashes of a block; a set counts as BLOCK / 512 of them at least, so a block has 512 members at most.
BLOCK = 1 << 21
#: Rows of buckets that a task holds at once.
HOLD = 1 << 17


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts)))


def _key(prints: np.ndarray, band: int) -> np.ndarray:
    """The keys of one band of SimHashes of ALL_WORDS words each."""
    word, bit = divmod(band * RUN, 64)
    run = prints[:, word] >> np.uint64(bit)
    if bit + RUN > 64:
        run = run | prints[:, word + 1] << np.uint64(64 - bit)
    return mix64((run & np.uint64((1 << RUN) - 1)) + np.uint64((band + 1) << 32))


def buckets(found: np.ndarray) -> np.ndarray:
    """The key of each band of a set that isn't empty."""
    prints = signatures(found, np.array([0, len(found)]), ALL_WORDS)
    return np.concatenate([_key(prints, k) for k in range(BANDS)])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [shingles(text.as_py()) for text in batch.column("text")]
        whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), np.int64).reshape(-1, 2)
        n = np.array([len(x) for x in found], np.int64)
        prints = signatures(np.concatenate(found), np.concatenate(([0], np.cumsum(n))), ALL_WORDS)
        columns = [pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in prints], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "hi", "lo", "n", "print"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, print) to one row for each band."""
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, ALL_WORDS)
        compared = [pa.array(prints[:, w].view(np.int64)) for w in range(WORDS)]
        for k in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(_key(prints, k).view(np.int64)), batch.column("doc_id"), batch.column("n"), *compared], ["bucket", "doc_id", "n", *FINGERPRINT])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "root", "shares")), found], ["doc_id", "root", "shares", "found"])


def _members(hold: int):
    """Rows (bucket, doc_id, n, fingerprint) sorted by bucket and doc_id to (rep, doc_id, n) of what the tree connects within a bucket.

    What is connected is named by its least document. A bucket of more than
    ``hold`` rows is one group whole and goes out in pieces.
    """

    def flush(bucket: np.ndarray, ids: np.ndarray, n: np.ndarray, fps: np.ndarray, whole: np.uint64 | None, lead: int) -> pa.RecordBatch:
        hot = np.zeros(len(bucket), bool) if whole is None else bucket == whole
        rest = np.flatnonzero(~hot)
        rep, use = np.full(len(bucket), lead, np.int64), hot
        if len(rest):
            tree = GrayTree(bucket[rest], fps[rest, 0], fps[rest, 1:])
            label = tree.labels(FIRST_BITS, WHOLE_BITS)
            order = np.argsort(label, kind="stable")
            label, rest = label[order], rest[tree.order[order]]
            start = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
            size = np.diff(np.append(start, len(rest)))
            least = np.minimum.reduceat(ids[rest], start)
            rep[rest] = np.repeat(least, size)
            use[rest] = np.repeat(least != np.maximum.reduceat(ids[rest], start), size)
        return pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(ids[use]), pa.array(n[use])], ["rep", "doc_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, whole, lead = 0, None, 0
        for batch in batches:
            bucket, ids, n, *fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "doc_id", "n", *FINGERPRINT))
            held.append([bucket.view(np.uint64), ids, n, np.stack(fps, axis=1).view(np.uint64)])
            count += batch.num_rows
            if count < hold:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))[-1])
            if not cut:
                cut = count
                if whole is None or whole != rows[0][0]:
                    whole, lead = rows[0][0], rows[1][0]
            yield flush(*(x[:cut] for x in rows), whole, lead)
            held, count = [[x[cut:] for x in rows]], count - cut
        if count:
            yield flush(*(np.concatenate(x) for x in zip(*held)), whole, lead)

    return run


def forest(ids: list[int], sets: list[np.ndarray], roots: list[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Fewest links that connect what similarities of ``least`` or more connect; what shares a root is connected."""
    label = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    out = []
    for i in range(len(ids) - 1):
        use = label[i + 1 :] != label[i]
        use &= np.minimum(size[i + 1 :], size[i]) >= least * np.maximum(size[i + 1 :], size[i]) - 1e-9
        others = np.flatnonzero(use) + i + 1
        if not len(others):
            continue
        values = np.concatenate([sets[k] for k in others])
        hit = sets[i][np.minimum(np.searchsorted(sets[i], values), size[i] - 1)] == values
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[others]) - size[others])
        for k in others[common >= least * (size[i] + size[others] - common) - 1e-9]:
            if label[k] != label[i]:
                out.append((ids[i], ids[k]))
                label[label == label[k]] = label[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (share, doc_id, root, found) sorted by share to links."""

    def flush() -> pa.RecordBatch:
        links = forest(ids, sets, roots)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    now, ids, sets, roots = None, [], [], []
    for batch in batches:
        for share, doc_id, root, found in zip(batch.column("share").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("root").to_pylist(), batch.column("found")):
            if share != now:
                if len(ids) > 1:
                    yield flush()
                now, ids, sets, roots = share, [], [], []
            ids.append(doc_id)
            sets.append(np.frombuffer(found.as_py(), np.uint64))
            roots.append(root)
    if len(ids) > 1:
        yield flush()


def _links(own: DataFrame, shares: DataFrame) -> DataFrame:
    """Links (u, v) inside the shares (share, doc_id, root); a text travels once to its set, the set once to each of its shares."""
    n = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = shares.groupBy("doc_id").agg(F.min("root").alias("root"), F.collect_set("share").alias("shares"))
    # no side is broadcast at any size: all grow with the input
    sets = own.join(wanted.hint("merge"), "doc_id").select("doc_id", "root", "shares", "text").mapInArrow(trimmed(_sets), "doc_id long, root long, shares array<long>, found binary")
    dealt = sets.where(F.length("found") > 0).select(F.explode("shares").alias("share"), "doc_id", "root", "found")
    return dealt.repartition(n, "share").sortWithinPartitions("share").mapInArrow(trimmed(_compare), "u long, v long")


def _blocks(weight: Column, block: int) -> Column:
    """How many blocks a pool takes, less one."""
    return (F.ceil(F.sum(weight) / F.lit(block)) - 1).cast("int")


def _place(salt: int, most: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), most + 1).cast("int")


def pools(members: DataFrame) -> DataFrame:
    """(pool, doc_id, n) of the groups ``members`` (rep, doc_id, n): groups that share documents are one pool, so a document is in one."""
    # sums are written before they are joined back: the join alone can then be split where a group is very large
    tied = materialise(members.groupBy("doc_id").agg(F.min("rep").alias("tie"), F.max("n").alias("n")), "near-tied")
    # each document ties its groups to its least one; only names of groups go through the rounds
    ties = materialise(members.select("doc_id", "rep").join(tied.select("doc_id", "tie").hint("merge"), "doc_id").select(F.col("rep").alias("u"), F.col("tie").alias("v")).distinct(), "near-ties")
    if ties.where("u <> v").isEmpty():
        return tied.select(F.col("tie").alias("pool"), "doc_id", "n")
    roots = materialise(components(ties), "near-roots").select(F.col("node").alias("tie"), F.col("root").alias("pool"))
    return tied.join(roots.hint("merge"), "tie").select("pool", "doc_id", "n")


def groups(docs: DataFrame, block: int = BLOCK, hold: int = HOLD) -> DataFrame:
    """doc_id and component_id (the least doc_id that links reach) of every doc_id.

    Texts without words (null ones too) are copies of each other. Rows without a
    doc_id take no part. A doc_id that is repeated is one document, linked by any
    of its texts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = texts(docs).where("doc_id is not null")
    sketch = materialise(own.mapInArrow(trimmed(_sketch), "doc_id long, hi long, lo long, n int, print binary"), "near-sketch")
    # one row for each different set; written before it is joined back, so that copies of one text can be split
    firsts = materialise(sketch.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.min_by("n", "doc_id").alias("n"), F.min_by("print", "doc_id").alias("print")), "near-firsts")
    named = materialise(sketch.select("doc_id", "hi", "lo").join(firsts.select("hi", "lo", "first_id").hint("merge"), ["hi", "lo"]).select("doc_id", "first_id").distinct(), "near-copies")
    copies = named.where("doc_id <> first_id").select(F.col("doc_id").alias("u"), F.col("first_id").alias("v"))
    schema = ", ".join(["bucket long, doc_id long, n int", *(f"{c} long" for c in FINGERPRINT)])
    rows = firsts.where("n > 0").select(F.col("first_id").alias("doc_id"), "n", "print").mapInArrow(trimmed(_deal), schema)
    members = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(trimmed(_members(hold)), "rep long, doc_id long, n int")
    members = materialise(members.groupBy("rep", "doc_id").agg(F.max("n").alias("n")), "near-members")
    weight = F.greatest(F.col("n"), F.lit(max(1, block // 512))).cast("long")
    pooled = materialise(pools(members), "near-pools")
    sizes = materialise(pooled.groupBy("pool").agg(_blocks(weight, block).alias("most"), F.min("doc_id").alias("first")), "near-sizes")
    placed = pooled.join(sizes.hint("merge"), "pool")
    mine = placed.select("pool", _place(0, F.col("most")).alias("block"), "doc_id")
    firsts = sizes.where("most > 0").select("pool", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("block"), F.col("first").alias("doc_id"))
    shares = mine.unionAll(firsts).select(F.xxhash64("pool", "block").alias("share"), "doc_id", F.col("doc_id").alias("root"))
    edges = materialise(_links(own, shares).unionAll(copies), "near-links")
    ids = named.select("doc_id").distinct()
    if edges.isEmpty():
        roots = ids.withColumn("root", F.col("doc_id"))
    else:
        roots = components(edges).select(F.col("node").alias("doc_id"), "root")
    large = placed.where("most > 0")
    if not large.isEmpty():
        rooted = large.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        heads = rooted.where("doc_id = first").select("pool", F.col("root").alias("head")).distinct()
        rooted = materialise(rooted.join(heads, "pool"), "near-large")
        rest = rooted.where("root <> head")
        few = materialise(rest.groupBy("pool").agg(_blocks(weight, block).alias("few")), "near-few")
        one = rest.join(few, "pool").withColumn("a", _place(1, F.col("few"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("most"))))
        all_ = rooted.join(few, "pool").withColumn("b", _place(2, F.col("most"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("few"))))
        both = one.select("pool", "a", "b", "doc_id", "root").unionAll(all_.select("pool", "a", "b", "doc_id", "root"))
        shares = both.select(F.xxhash64("pool", "a", "b").alias("share"), "doc_id", "root")
        # few texts, if any: their ids are sent to all tasks if they are small by the planner's own bound, else shuffled
        some = materialise(shares.select("doc_id").distinct(), "near-some")
        more = materialise(_links(own.join(some, "doc_id", "left_semi"), shares), "near-links")
        if not more.isEmpty():
            edges = materialise(edges.unionAll(more), "near-links")
            roots = components(edges).select(F.col("node").alias("doc_id"), "root")
    return ids.join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
