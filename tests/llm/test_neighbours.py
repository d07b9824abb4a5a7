import itertools

import numpy as np
import pytest

from polyquery.llm import neighbours


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (4, 2), (8, 1)])
def test_hilbert_visits_neighbouring_cells(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    key = neighbours.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * d))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("vec_id", "embedding", "1 as rank", "2 as score")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[500:1500] = v[7]  # a vector that a third of the rows share
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 3), (None, v[0].tolist()), (5200, [None] * 16), (5250, [float("inf")] * 16), (100, v[100].tolist())]
    want = brute({(i, tuple(x) if x else None): (i, x) for i, x in rows}.values())
    got = {}
    for r in sorted(neighbours.query(table(spark, rows)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    at = dict(rows[:3000])
    for q, near in got.items():
        for j, s in near:
            a, b = np.array(at[q], float), np.array(at[j], float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        if 500 <= q < 1500:  # ties go to the smaller id
            assert [j for j, _ in near] == [j for j in (7, 500, 501, 502, 503, 504) if j != q][:5]


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = neighbours.query(table(spark, rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.query(table(spark, [])).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    """Many different vectors of one direction."""
    rows = [(i, [float(i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(80)] + [(100, [1.0, 0.0, 0.0])]
    got = {}
    for r in sorted(neighbours.query(table(spark, rows)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_very_small_and_large_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2.1e200]), (2, [1e300, -1e300]), (3, [3e-310, 5e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 3)) for r in neighbours.query(df).collect())
    assert [g[1] for g in got] == [1, 3, 2] and all(np.isfinite(g[2]) for g in got)


def test_cells_are_parted_when_the_sample_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 20)
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)).astype(np.float32))]
    want = brute(rows)
    got = {}
    for r in neighbours.nearest(table(spark, rows), share=1.0, cell_rows=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_windows_follow_the_structure():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=(4000, 32))
    grouped = rng.normal(size=(400, 32)).repeat(10, axis=0) + 0.05 * rng.normal(size=(4000, 32))
    share = []
    for v in (noise, grouped):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        share.append(neighbours.window(unit, neighbours.fit(unit, 64), 5))
    assert share[1] < 0.02 < share[0] < 0.2
