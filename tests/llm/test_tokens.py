import random
import unicodedata
import zlib

import numpy as np
import pytest

from polyquery.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "plain words here.", "two  blanks\n\nand\ttabs ", " lead", "trail\n", "don't I'll, x's 12ab ÄÖ ß…", "漢字 and 😀 smile", "<|endoftext|> a", "a #b ## c", "nb\xa0sp  em", "THE!! this*** a | b", "x" * 5000, "ctl\x1c\x1fx", "word​zero"]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_words_are_the_tokenizers_own(text):
    enc = tokens.Encoder(PATH)
    assert enc.by_words
    for _ in range(2):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(text)


def test_every_character_is_encoded_as_the_library_does():
    """All code points, each before and behind letters, digits, marks and itself."""
    from tokenizers import Tokenizer

    own, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    codes = [c for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    unsure = [c for c in codes if enc.unsure.search(chr(c))]
    assert all(c > 0xFFFF or unicodedata.category(chr(c)) == "Cn" for c in unsure)
    sure = sorted(set(codes) - set(unsure))
    some = sure + unsure[::400]
    texts = ["|".join(f"x{chr(c)}'s {chr(c)}1 {chr(c)}{chr(c)} {chr(c)}! a{chr(c)}b 7{chr(c)}" for c in some[k : k + 40]) for k in range(0, len(some), 40)]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice(sure)) if rng.random() < 0.5 else rng.choice("ab 1.'s\n") for _ in range(60)) for _ in range(3000)]
    for text, want in zip(texts, own.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want.ids, text


def test_all_texts_at_once():
    enc = tokens.Encoder(PATH)
    rng = random.Random(9)
    made = ["".join(rng.choice(["a", "word", " b", " c,", "\n", ". ", "é", "'s", " 12", "漢"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for texts in (TEXTS, made, [], [None], ["x"], ["one\ntwo", "  ", "three four"], ["same"] * 3):
        column = tokens.pa.array(["skipped", *texts], tokens.pa.string()).slice(1)
        flat, sizes = enc.encode_all(column, 2)
        want = [[*whole_by(enc, t), 2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert flat.dtype == enc.dtype and flat.tolist() == [i for w in want for i in w]


def whole_by(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids


def test_memories_start_anew_and_can_be_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    enc = tokens.Encoder(PATH)
    text = " ".join(f"word{chr(97 + i)} {i}x-{i}" for i in range(20))
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(text)
    assert max(map(len, (enc.known, enc.first, enc.later))) <= 3
    enc.forget()
    assert not enc.known and not enc.first and not enc.later


def test_round_trip(spark):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(100 + i, "some words " * (i + 1)) for i in range(40)] + [(100, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("text", "doc_id", "1 as shard", "2 as start", "3 as place")
    got = sorted(tokens.round_trip(df, PATH, 2).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(d), len(whole(t)) + 1, zlib.crc32(np.array([*whole(t), 2], "<u4").tobytes())) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "one two three " * (i % 9)) for i in range(300)], "doc_id long, text string")
    tokens.write(df, f"file://{tmp_path}/t", PATH, 2, length=16, shard_text=2000)
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) > 2
    seen = []
    for f in files:
        meta, batches = tokens.open_file(f.read_bytes())
        assert meta["format"] == "pqs1" and meta["sequence_length"] == "16"
        for b in batches:
            assert tokens.sequence(b, 0).shape == (16,)
            assert len(tokens.sequence(b, b.num_rows - 1, "mask")) == 16
        seen += [d["doc_id"] for b in batches for row in b.column("docs").to_pylist() for d in row]
    assert sorted(seen) == list(range(300))


def test_empty(spark):
    assert tokens.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
