import random

import numpy as np
import pytest

from polyquery.llm import decontaminate as D

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(5, len(s) - 5)
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "z"
        elif kind == 1:
            s.insert(at, "z")
        else:
            del s[at]
    return "".join(s)


def distance_inside(item, body):
    """Least edits of all of item in any part of body."""
    row = [0] * (len(body) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(body)
        for j, b in enumerate(body, 1):
            row[j] = min(last[j - 1] + (c != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_align_against_full_programme():
    for _ in range(30):
        item = text(12)
        body = text(6) + " " + edited(item, rng.randrange(6)) + " " + text(6)
        want = distance_inside(item, body)
        a, b = (np.frombuffer(s.encode(), np.uint8) for s in (item, body))
        got = D.align(a, b, -5, len(body), 8)
        assert (got is None) == (want > 8)
        if got:
            assert got[0] == want
            assert distance_inside(item, body[got[1] : got[2]]) == want


def test_finds_every_passage_within_budget(spark):
    items = [(i, text(rng.randrange(15, 50))) for i in range(12)] + [(20, None), (21, ""), (22, "tiny")]
    docs, want = [], set()
    for i in range(80):
        body = text(rng.randrange(0, 80))
        if i % 3 == 0:
            k = rng.randrange(12)
            item = items[k][1]
            shown = edited(item, int(len(item) * D.BUDGET)) if i % 2 else item.upper().replace(" ", "\n ", 3)
            body = f"{body} {shown} {text(5)}"
            want.add((i, k))
        docs.append((i, body))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "'q' as item_id")
    got = D.query(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    by = {d: t for d, t in docs}
    for r in got:
        norm = " ".join((by[r.doc_id].encode()[r.start : r.end]).decode().lower().split())
        assert distance_inside(norm, " ".join(items[r.item_id][1].split())) <= r.edits
    kept = [r.doc_id for r in D.keep_uncontaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(kept) == sorted({d for d, _ in docs if d is not None} - {d for d, _ in want})


@pytest.mark.parametrize("pairs", [D.PAIRS, 7])
def test_against_all_pairs(spark, monkeypatch, pairs):
    """Every document with every item by the full programme; items share a head, some are copies."""
    monkeypatch.setattr(D, "PAIRS", pairs)
    head = text(4)
    items = [(i, f"{head} {text(8)}") for i in range(5)]
    items.append((9, items[0][1]))
    docs = []
    for i in range(24):
        item = items[i % 5][1]
        docs.append((i, f"{text(10)} {edited(item, i // 5 * 2) if i % 4 else head} {text(10)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.query(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, body in docs for i, item in items if distance_inside(item, body) <= int(len(item) * D.BUDGET)}
    assert got == want and len(want) > 5


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "Say  yes"), (2, "é!"), (3, " "), (4, "say yes"), (5, "hello worl")]
    docs = [(1, "They SAY\n yes."), (2, "They say yes now"), (3, "essay yesterday"), (4, "é!"), (5, "é!!"), (6, None), (7, ""), (8, "say yes"), (9, "hello world")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.query(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2, 1), (2, 4), (4, 2), (8, 1), (8, 4)}
    assert {(r.start, r.end) for r in found if r.doc_id == 2} == {(5, 12)}


def test_a_long_text_and_clashing_columns(spark):
    item = text(20)
    body = text(60_000) + " " + item + " " + text(60_000)
    df = spark.createDataFrame([(1, body), (2, text(50))], "doc_id long, text string").selectExpr("text", "doc_id", "1 as item_id", "2 as edits", "3 as start")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.query(df, bench).collect()] == [(1, 7)]
    assert [r.doc_id for r in D.keep_uncontaminated(df, bench).collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.query(docs, none).collect() == []
    assert D.keep_uncontaminated(docs, none).count() == 1
    assert D.query(docs.limit(0), spark.createDataFrame([(1, text(20))], "item_id long, text string")).collect() == []
    assert pytest.approx(D.BUDGET) == 0.05
