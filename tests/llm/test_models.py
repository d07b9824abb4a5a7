import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from polyquery.llm import mixing, quality, toxicity
from polyquery.llm.common import utf8, word_spans
from polyquery.llm.crf import Crf


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    c = Crf((3,))
    c.unary, c.pair, c.start = [np.array([0.3, -1.0, 2.0])], np.array([[0.5, -0.2], [0.1, 0.9]]), -0.4
    for sizes in ([1], [5, 3], [4, 1, 6, 2]):
        first = np.zeros(sum(sizes), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        obs = rng.integers(0, 3, sum(sizes))
        got, want, at = c.marginals([obs], first), [], 0
        for n in sizes:
            part = obs[at : at + n]
            at += n
            total, ones = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(c.start * y[0] + sum(c.unary[0][o] * v for o, v in zip(part, y)) + sum(c.pair[a, b] for a, b in itertools.pairwise(y)))
                total += w
                ones += w * np.array(y)
            want += list(ones / total)
        assert np.allclose(got, want)


@pytest.mark.parametrize("texts", [["", None, "a b", "é\x0bü", " x "], ["ab", "cd"], [None, ""], []])
def test_word_spans(texts):
    raw, at = utf8(pa.array(texts, pa.string()))
    starts, ends, owner = word_spans(raw, at)
    got = [(int(o), raw[a:b].tobytes()) for a, b, o in zip(starts, ends, owner)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 8))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            lines[1:] = [" ".join(w.upper() + "!!" for w in line.split()) for line in lines] * 2
        if toxic:
            lines[0] += rng.choice([" nasty", " Horrid.", " vilex", " viley"])
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    docs = docs + [(2000, ""), (2001, None), (None, "a b"), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'s' as source", "0 as label", "1 as score")
    return docs, labels, d, spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels, d, lab = frames(spark)
    rows = toxicity.query(d, lab).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(d, lab).collect()}
    assert {i for i, t in truth.items() if not t} <= kept | {-1}


def test_toxic_spans():
    docs, labels = corpus()
    model = toxicity.fit([(t, y) for (_, t), (_, _, y) in zip(docs, labels)])
    text = "Éa bad NASTY horrid thing\nhere vilex."
    p, at = model.tokens([text.lower().split()], toxicity.Lookup(model.lexicon))
    spans = toxicity._spans(text, text.lower(), text.lower().split(), set(np.flatnonzero(p > 0.5).tolist()))
    assert [text[s["start"] : s["end"]] for s in spans] == ["NASTY horrid", "vilex."]


def test_quality_on_held_out_rows(spark):
    docs, labels, d, lab = frames(spark)
    rows = quality.query(d, lab).collect()
    assert len(rows) == len(docs)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_models_without_labels(spark):
    _, _, d, lab = frames(spark)
    for part in (lab.limit(0), lab.where("toxic = 0 and quality = 1")):
        assert toxicity.query(d, part).count() == quality.query(d, part).count() == mixing.query(d, part).count() == d.count()
    assert toxicity.query(d.limit(0), lab).count() == quality.query(d.limit(0), lab).count() == mixing.query(d.limit(0), lab).count() == 0


def test_mixing_meets_targets(spark):
    _, labels, d, lab = frames(spark)
    rows = mixing.mix(d, lab, {"good": 0.5, "poor": 0.3, "toxic": 0.2}).collect()
    total = sum(r.n_tokens for r in rows)
    for name, share in (("good", 0.5), ("poor", 0.3), ("toxic", 0.2)):
        assert sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows) == pytest.approx(share * total, rel=1e-6)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    assert all(r.p_good + r.p_poor + r.p_toxic == pytest.approx(1) for r in rows)


def test_mixing_with_rates_at_zero(spark):
    """A target of nothing for one domain: rates reach the bound and the others still meet theirs."""
    _, _, d, lab = frames(spark)
    rows = mixing.mix(d, lab, {"good": 1.0}).collect()
    total = sum(r.n_tokens for r in rows)
    assert min(r.rate for r in rows) == 0
    assert sum(r.rate * r.n_tokens * r.p_good for r in rows) == pytest.approx(total, rel=1e-2)


def test_mixing_keeps_good_documents(spark):
    _, labels, d, lab = frames(spark)
    kept = [r.doc_id for r in mixing.keep_mixed(d, lab).collect()]
    good = {i for i, q, t in labels if q and not t}
    assert good <= set(kept)
    assert len(kept) < d.count()


def cone(p, w, goal):
    """The least distance of nonnegative mixtures to ``goal``: every way in which at most three rows carry all."""
    import itertools

    best = float(goal @ goal) / 2
    a = (p * w[:, None]).T
    for size in (1, 2, 3):
        for some in itertools.combinations(range(len(p)), size):
            x, *_ = np.linalg.lstsq(a[:, some], goal, rcond=None)
            if (x >= 0).all():
                d = a[:, some] @ x - goal
                best = min(best, float(d @ d) / 2)
    return best


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (1.0, 0.0, 0.0), (0.0, 0.05, 0.95), (0.02, 0.98, 0.0)])
def test_rates_against_all_supports(spark, weights):
    """The fit's distance is the least there is, whether targets can be met or not."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([4.0, 2.0, 1.0], 14)
    w = rng.integers(1, 200, 14)
    names = mixing.DOMAINS
    df = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(w, p)], "n_tokens long, " + ", ".join(f"p_{n} double" for n in names))
    fit = mixing.rates(df, dict(zip(names, weights)))
    assert fit.converged and fit.passes < mixing.STEPS
    total = w.sum()
    gap = np.array([fit.reached[n] - fit.wanted[n] for n in names]) / total
    goal = np.array(weights)
    assert float(gap @ gap) / 2 == pytest.approx(cone(p, w / total, goal), abs=1e-6)
    rates = np.array([r.rate for r in df.select(mixing.rate_column(fit.steps).alias("rate")).collect()])
    assert (rates >= 0).all()
    assert np.allclose((rates * w) @ p, [fit.reached[n] for n in names])


def test_rates_without_tokens_or_targets(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "n_tokens long, p_good double, p_poor double, p_toxic double")
    assert mixing.rates(df, {"good": 1.0}).steps == [] and mixing.rates(df.limit(0), {"good": 1.0}).steps == []
    assert mixing.rates(df.selectExpr("5L as n_tokens", "p_good", "p_poor", "p_toxic"), {}).steps == []


def test_mixing_stage_reaches_its_weights(spark):
    """Poor text is thinned to the share asked for, rows with odd values pass."""
    docs, labels, d, lab = frames(spark)
    kept = mixing.keep_mixed(d, lab, {"good": 0.9, "poor": 0.1})
    assert kept.columns == d.columns
    truth = {i: (q, t) for i, q, t in labels}
    by = dict(docs)
    rows = kept.collect()
    size = {k: sum(len(by[r.doc_id].split()) for r in rows if r.doc_id in truth and truth[r.doc_id] == k) for k in ((1, 0), (0, 0))}
    assert 0.04 < size[0, 0] / (size[0, 0] + size[1, 0]) < 0.2
    assert {r.doc_id for r in rows} >= {2000, 2001}
    assert mixing.keep_mixed(d.limit(0), lab).count() == 0
