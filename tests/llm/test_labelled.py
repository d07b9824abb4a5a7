from polyquery.llm import mixing, toxicity
from polyquery.llm.labelled import sample, within


def tables(spark, long=()):
    rows = [(i, f"text {i} " + ("nasty " if i % 4 == 0 else "plain ") * 8) for i in range(80)]
    rows = [(i, t * 200 if i in long else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    return dict(rows), docs, labels


def test_a_long_text_is_skipped(spark):
    """It ends the sample for no other document, wherever its doc_id stands."""
    by, docs, labels = tables(spark)
    everything = sample(docs, labels, "toxic", 3, 1)
    for long in (min(by), 40):
        _, docs, labels = tables(spark, [long])
        got = sample(docs, labels, "toxic", 3, 1, characters=9000)
        assert got == [x for x in everything if x[0] != by[long]]
    assert toxicity.fit(got) is not None and {y for _, y in got} == {0, 1}


def test_labels_share_the_characters(spark):
    """A bound that holds a part of the texts takes from each label, not from the least doc_ids."""
    by, docs, labels = tables(spark)
    ids = labels.selectExpr("doc_id", "toxic as label")
    got = within(docs, ids, 2000)
    assert 1800 < sum(len(t) for _, t, _ in got) <= 2000
    counts = [sum(y == k for *_, y in got) for k in (0, 1)]
    assert abs(counts[0] - counts[1]) <= 1
    assert {d for d, *_ in got} != set(sorted(by)[: len(got)]) and max(d for d, *_ in got) > 60
    assert within(docs, ids, 0) == []


def test_mixing_learns_past_a_long_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "fit", lambda rows, count: seen.append(rows))
    by, docs, labels = tables(spark, [0])  # its hash is the least
    mixing.learn(docs, mixing.domain_of(labels), 3, characters=9000)
    assert sorted(t for t, _ in seen[0]) == sorted(t for d, t in by.items() if d)
