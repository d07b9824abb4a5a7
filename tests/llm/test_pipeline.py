"""The pipeline's stages against plain Python over a small corpus."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from polyquery.llm import simhash, tokens, toxicity
from polyquery.llm.labelled import sample

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(600)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(2, 5)))
        toxic, bad, leak = i % 5 == 1, i % 7 == 2, i % 11 == 3
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " nasty horrid"
        if leak:
            text += " " + items[i % 5][1]
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    for i in range(300, 330):  # near copies of clean ones
        base = docs[(i - 300) * 5][1]
        docs.append((i, base, "en", "src", len(base)))
    return docs, labels, items


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    by = {i: t for i, t, *_ in docs}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [set(by)]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        path = str(tmp_path / f"out-{name}")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        if name != "tokens":
            assert now.columns == d.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    _, clean, single, pure, mixed, written = kept

    model = toxicity.fit(sample(d, lab, "toxic", 3, 1))
    marks = {i: float(model.scores(*model.tokens([t.lower().split()], toxicity.Lookup(model.lexicon)))[0]) for i, t in by.items()}
    assert clean == {i for i in by if marks[i] < 0.7}
    assert {i for i, _, t in labels if t} & clean == set()
    prints = {i: simhash.fingerprint(by[i]) for i in clean}
    group = {i: {i} for i in clean}
    for i in clean:
        for j in clean:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] is not group[j]:
                union = group[i] | group[j]
                for k in union:
                    group[k] = union
    assert single == {min(g) for g in group.values()}
    assert pure == {i for i in single if not any(t in by[i] for _, t in items)}
    good = {i for i, q, t in labels if q}
    assert pure & good <= mixed <= pure
    assert len(mixed) < len(pure)  # poor text is thinned
    assert written == mixed
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(now.collect(), key=lambda r: r.doc_id):
        ids = np.append(np.frombuffer(enc.encode(by[r.doc_id]), enc.dtype), enc.dtype.type(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_names_and_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
