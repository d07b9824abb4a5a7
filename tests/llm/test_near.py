import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from polyquery.llm import near, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least=0.8):
    """doc_id -> least doc_id that similarities of all pairs reach."""
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if label[d] != label[e] and (not a and not b or a and b and len(a & b) >= least * len(a | b)):
                low, high = sorted((label[d], label[e]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def corpus():
    """Texts and copies of each with 1 to 12 words changed, similar ones on both sides of 0.8."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 60, 250]))]
        rows.append((1000 - len(rows), " ".join(words)))
        for edits in rng.sample(range(1, 13), 4):
            other = list(words)
            for k in rng.sample(range(len(words)), min(edits, len(words))):
                other[k] = f"changed{rng.randrange(10**6)}"
            rows.append((1000 - len(rows), " ".join(other)))
    copy = rows[7][1].upper().replace(" ", "\n ")
    return rows + [(5, ""), (6, None), (7, copy), (7, "another text of it"), (None, rows[0][1]), (8, "one two"), (9, "One  two")]


@pytest.mark.parametrize("block, hold", [(near.BLOCK, near.HOLD), (600, 3)])
def test_groups_against_all_pairs(spark, block, hold):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.groups(df, block, hold).collect()} == brute(rows)


def test_stage_drops_edited_copies(spark):
    """Copies of similarity 0.8 and more whose fingerprints differ in more than 4 bits go."""
    rows = [r for r in corpus() if r[0] != 7]
    least = brute(rows)
    by = {d: t for d, t in rows if d is not None}
    far = [d for d, c in least.items() if (simhash.fingerprint(by[d]) ^ simhash.fingerprint(by[c])).bit_count() > 4]
    assert far
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(least.values()))
    assert kept.count(None) == 1


def test_empty(spark):
    assert near.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_sets_share_a_bucket():
    rng = np.random.default_rng(4)
    for n in (9, 90, 900):
        for _ in range(200):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = n // 10
            a, b = np.sort(both[: n - cut]), np.sort(both[cut:])
            if (n - 2 * cut) / n >= 0.8:
                assert (near.buckets(a) == near.buckets(b)).any()


def test_keys_are_runs_of_a_simhash():
    """Bit by bit: set if over half of the salted hashes have it; equal runs give equal keys."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 254, 255, 256, 700)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    found = simhash.signatures(np.concatenate(sets), at, near.ALL_WORDS)
    salt = near.mix64(np.arange(1, near.ALL_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for row, own in zip(found, sets):
        for w in (0, 1, near.ALL_WORDS - 1):
            mixed = near.mix64(own ^ salt[w])
            place = [8 * (bit % 8) + bit // 8 for bit in range(64)]
            want = sum(1 << place[bit] for bit in range(64) if 2 * int((mixed >> np.uint64(bit) & np.uint64(1)).sum()) > len(own))
            assert int(row[w]) == want
    bits = ["".join(f"{int(w):064b}"[::-1] for w in row) for row in found]
    keys = [near.buckets(s) for s in sets]
    for k in range(near.BANDS):
        for i in range(len(sets)):
            for j in range(i):
                run = slice(k * near.RUN, (k + 1) * near.RUN)
                assert (keys[i][k] == keys[j][k]) == (bits[i][run] == bits[j][run])


def test_no_words_have_no_bits():
    assert not simhash.signatures(np.zeros(0, np.uint64), np.array([0, 0, 0]), 2).any()


@pytest.mark.parametrize("piece", [1000, 7])
def test_members_of_a_key_are_connected_by_their_fingerprints(piece):
    """Within a key only fingerprints that the Gray-order tree connects are a group: against all pairs."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, (300, near.WORDS), dtype=np.uint64) * np.uint64(2)
    for i in range(150):
        fps[i] = fps[rng.integers(150, 300)]
        for b in rng.choice(64 * near.WORDS, rng.integers(0, 80), replace=False):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket, ids = np.sort(rng.integers(0, 4, 300)), rng.permutation(300)
    for b in range(4):
        ids[bucket == b].sort()
    far = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
    close = (far[:, :, 0] <= near.FIRST_BITS) & (far.sum(axis=2) <= near.WHOLE_BITS) & (bucket[:, None] == bucket[None])
    least = ids.copy()
    for _ in range(300):
        least = np.where(close, least[None], 300).min(axis=1)
    size = {r: int((least == r).sum()) for r in least}
    want = {(r, d) for r, d in zip(least.tolist(), ids.tolist()) if size[r] > 1}
    assert want and len(want) < 300
    columns = [pa.array(x) for x in (bucket, ids, np.ones(300, np.int32), *fps.view(np.int64).T)]
    batch = pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "n", *near.FINGERPRINT])
    batches = [batch.slice(k, piece) for k in range(0, 300, piece)]
    out = [r for b in near._members(100)(iter(batches)) for r in b.to_pylist()]
    assert {(r["rep"], r["doc_id"]) for r in out} == want


def test_a_key_of_very_many_rows_is_one_group():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 63, (60, near.WORDS), dtype=np.uint64)
    columns = [pa.array(x) for x in (np.repeat([3, 9], [50, 10]), np.arange(60), np.ones(60, np.int32), *fps.view(np.int64).T)]
    batch = pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "n", *near.FINGERPRINT])
    out = [r for b in near._members(20)(iter([batch.slice(k, 6) for k in range(0, 60, 6)])) for r in b.to_pylist()]
    assert [(r["rep"], r["doc_id"]) for r in out] == [(0, d) for d in range(50)]


def test_a_document_is_in_one_pool(spark):
    rows = [(1, 1), (1, 5), (2, 2), (2, 5), (2, 6), (6, 6), (6, 9), (3, 3), (3, 4)]
    found = near.pools(spark.createDataFrame([(r, d, 7) for r, d in rows], "rep long, doc_id long, n int"))
    assert sorted(tuple(r) for r in found.select("pool", "doc_id", "n").collect()) == [(1, 1, 7), (1, 2, 7), (1, 5, 7), (1, 6, 7), (1, 9, 7), (3, 3, 7), (3, 4, 7)]
