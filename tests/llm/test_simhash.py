import random

import numpy as np
import pytest

from polyquery.llm import simhash
from polyquery.llm.components import components


def brute(rows, bits=4):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = [(d, simhash.fingerprint(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def naive_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "A b\tC  d e f", "Äpfel ÄPFEL x y z äpfel", "a b c d " * 50, "x\x0by\x85z w v u"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    # one shingle: the fingerprint is its hash
    got = spark.sql("select xxhash64('a b c') as h").first()["h"]
    assert simhash.fingerprint("A B c") == got & (1 << 64) - 1


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(4)):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (None, rows[0][1]), (3, rows[3][1])]
    return rows


def test_groups_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in simhash.query(df.selectExpr("doc_id", "text", "'x' as fp", "1 as component_id")).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert simhash.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limit", [40, 1 << 15])
def test_links_of_dense_groups(spark, limit):
    """Links connect exactly what all pairs connect, also when groups are dealt again."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = [base]
    for _ in range(40):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5, 20)).astype(np.uint64), axis=0)
        fps.append(base ^ flips)
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = simhash.links(df, 4, limit).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want, got = np.arange(len(fps)), np.arange(len(fps))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    simhash._connect(want, i, j)
    simhash._connect(got, np.array([place[p.a] for p in pairs]), np.array([place[p.b] for p in pairs]))
    assert (want == got).all()
    for p in pairs:
        assert p.a in place and p.b in place


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (900, 900), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 900: 900}


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    roots = {c for _, _, c in brute(rows)}
    assert sorted(x for x in kept if x is not None) == sorted(roots)
    assert kept.count(None) == 1


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "b b b", 1), (1, "a a a", 2), (1, None, 3), (2, "c", 4), (None, "x", 5), (None, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    found = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, component_id long")
    assert sorted(r.place for r in simhash.keep_one(df, found).collect()) == [3, 4, 5, 6]
    assert simhash.keep_one(df, found).columns == df.columns
    assert sorted(r.place for r in simhash.keep_one(df.where("place > 3"), found).collect()) == [4, 5, 6]
