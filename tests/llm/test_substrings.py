import hashlib
import random
import re

import pytest

from polyquery.llm import substrings


def brute(rows, window=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((d, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(50)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 21, 100, 300]))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(40)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(15, 40)]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(rows[3][0] + 10**7, rows[3][1]), (5, "a " * 70), (6, "a " * 25), (None, rows[4][1]), (7, None), (8, ""), (9, "x\x85y " * 30)]
    return rows


@pytest.mark.parametrize("options", [{}, {"group_text": 4000, "tree_text": 3000, "hot": 1, "fan": 2}])
def test_against_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("text", "doc_id", "1 as g", "2 as n_words")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df, **options).collect()), key=str)
    assert got == brute(rows)


def test_windows_that_a_polynomial_hash_cannot_tell_apart(spark):
    """Thue-Morse words of a/b and their complement have equal polynomial hashes modulo 2**64."""
    long = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = long.translate(str.maketrans("ab", "ba"))
    words = [f"t{i}" for i in range(19)]
    rows = [(1, " ".join([*words, long])), (2, " ".join([*words, other])), (3, " ".join([*words, long]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"group_text": 4000, "tree_text": 3000}):
        got = sorted((r.doc_id, r.n_removed) for r in substrings.dedup(df, **options).collect())
        assert got == [(1, 0), (2, 0), (3, 20)]


def test_tree_nodes_are_classes_of_equal_windows():
    rng = random.Random(3)
    words = [rng.randrange(1, 4) for _ in range(400)]
    numbers = substrings.np.array(words, "int32")
    window, width = 6, 4
    first = substrings.np.arange(width, 400 - window)
    bits = substrings.np.full(len(first), (1 << width) - 1)
    again = substrings.repeats(substrings.table_of(numbers, first, bits, window, width), bits, window, width)
    for j in range(width):
        seen = set()
        for f, b in zip(first.tolist(), again.tolist()):
            w = tuple(words[f - j : f - j + window])
            assert bool(b >> j & 1) == (w in seen)
            seen.add(w)


def test_a_null_doc_id_is_no_number(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [((1 << 63) - 1, text), (None, text), (0, "x")]
    got = {r.doc_id: r.n_removed for r in substrings.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1 << 63) - 1: 0, None: 30, 0: 0}


def test_repeated_rows_of_one_document(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text)]
    got = sorted(tuple(r) for r in substrings.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(r[2] for r in got) == [0, 30, 30]


def test_kept_text_and_empty(spark):
    df = spark.createDataFrame([(1, " b  a\n c ")], "doc_id long, text string")
    assert substrings.dedup(df, with_text=True).first()["text"] == "b a c"
    assert substrings.query(df.limit(0)).collect() == []
