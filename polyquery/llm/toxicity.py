"""Toxic spans by a linear-chain conditional random field over words.

Fit (on a bounded sample of labelled training rows, in two halves): words and
word beginnings get the log odds of standing in a toxic document; a word of a
toxic document whose odds are high within its own half is a labelled toxic
token, all others are not. What the random field observes of the word and of both
neighbours are odds classes learnt from the *other* half, so that token labels
are no function of the observations: the field learns how far odds and
neighbours can be trusted. A logistic curve, fitted to the document labels, turns
the strongest and the summed token marginals into a document score. The odds that
score are learnt from both halves.

Scoring: every word of every whole text is looked up, forward-backward gives
each its marginal, runs of words over a half are toxic spans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import release, ship, sliced, texts, trimmed
from polyquery.llm.crf import Crf, logistic, probability, shifted
from polyquery.llm.labelled import FIT_DOCUMENTS, held_out, sample

#: Odds classes; 0 is "no evidence".
CLASSES = 8
EDGE = CLASSES
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 3
#: Clean documents that every word is taken to stand in besides those seen: what a few documents show weighs less.
PRIOR = 2.0
#: Odds class from which a toxic document's word is a labelled toxic token.
GOLD = 3
#: Words that the random field learns from, of whole documents.
FIT_WORDS = 300_000
#: Words that a memory holds before it starts anew.
KEPT_WORDS = 100_000
STRIP = ".,;:!?|()[]{}\"'*&%$#-_"


def _class(odds: float) -> int:
    """The class of a log-odds value: 0 under 1, then one a unit."""
    return max(0, min(CLASSES - 1, int(odds)))


@dataclass
class Lexicon:
    """Odds classes of words and of word beginnings; unknown words have class 0."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)

    def of(self, word: str) -> int:
        bare = word.strip(STRIP)
        found = self.words.get(bare, 0)
        for n in PREFIXES:
            if len(bare) >= n:
                found = max(found, self.stems.get(bare[:n], 0))
        return found


class Lookup(dict):
    """Words met lately, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        value = self.lexicon.of(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value
        return value


def _terms(text: str) -> tuple[set[str], set[str]]:
    """The words of a text and the beginnings of the longer ones."""
    words = {w.strip(STRIP) for w in text.lower().split()} - {""}
    return words, {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def lexicon(rows: list[tuple[str, int]], part: float = 1.0) -> Lexicon:
    """Classes from in how many toxic and other documents a word or beginning stands; only what toxic documents share is held.

    ``part``: the share of the training rows that ``rows`` are; bounds and priors shrink with it, so that classes mean the same.
    """
    total = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    out = []
    for kind in (0, 1):
        toxic: Counter[str] = Counter()
        for text, y in rows:
            if y:
                toxic.update(_terms(text)[kind])
        toxic = Counter({w: n for w, n in toxic.items() if n >= LEAST_DOCUMENTS * part})
        clean: Counter[str] = Counter()
        for text, y in rows:
            if not y:
                clean.update(_terms(text)[kind] & toxic.keys())
        odds = {w: _class(math.log(t / total[1]) - math.log((clean[w] + PRIOR * part) / (total[0] + PRIOR * part))) for w, t in toxic.items()}
        out.append({w: c for w, c in odds.items() if c})
    return Lexicon(*out)


@dataclass
class Model:
    lexicon: Lexicon
    crf: Crf
    curve: np.ndarray

    def tokens(self, words: list[list[str]], look: Lookup) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, and where each text's begin."""
        at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        own = np.fromiter((c for w in words for c in map(look.__getitem__, w)), dtype=np.int16, count=int(at[-1]))
        return self.crf.marginals(*observations(own, at)), at

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return probability(summary(p, at), self.curve)


def observations(own: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    first = np.zeros(len(own), bool)
    begins = at[:-1][np.diff(at) > 0]
    first[begins] = True
    return [own, shifted(own, first, -1, EDGE), shifted(own, first, 1, EDGE)], first


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal and the log of 1 + the marginals' sum over a tenth."""
    size = np.diff(at)
    out = np.zeros((len(size), 2))
    full = np.flatnonzero(size)
    if len(full):
        starts = at[:-1][full]
        out[full, 0] = np.maximum.reduceat(p, starts)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0.0), starts))
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows; without both labels, one that scores the share of toxic rows."""
    ys = np.array([y for _, y in rows], dtype=float)
    if not len(ys) or ys.min() == ys.max():
        share = float(ys.mean()) if len(ys) else 0.0
        return Model(Lexicon(), Crf((CLASSES, CLASSES + 1, CLASSES + 1)), np.array([0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3))]))
    rows = _interleaved(rows)
    ys = np.array([y for _, y in rows], dtype=float)
    model = Model(lexicon(rows), Crf((CLASSES, CLASSES + 1, CLASSES + 1)), np.zeros(3))
    halves = [rows[0::2], rows[1::2]]
    if all(len({y for _, y in half}) == 2 for half in halves):
        looks = [Lookup(lexicon(half, len(half) / len(rows))) for half in halves]
    else:
        looks = [Lookup(model.lexicon)] * 2
    parts, marks = [], []
    for i, (text, y) in enumerate(rows):
        words = text.lower().split()
        parts.append(np.fromiter(map(looks[1 - i % 2].__getitem__, words), dtype=np.int16, count=len(words)))
        marks.append(np.fromiter(map(looks[i % 2].__getitem__, words), dtype=np.int16, count=len(words)) >= GOLD if y else np.zeros(len(words), bool))
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    own, gold = np.concatenate(parts), np.concatenate(marks).astype(np.int64)
    del parts, marks, looks
    n = max(1, int(np.searchsorted(at, FIT_WORDS, side="right")) - 1)
    model.crf.fit(*observations(own[: at[n]], at[: n + 1]), gold[: at[n]], steps=25)
    seen = []
    for a in range(0, len(rows), 200):  # a few documents at a time
        cut = at[a : a + 201]
        seen.append(summary(model.crf.marginals(*observations(own[cut[0] : cut[-1]], cut - cut[0])), cut - cut[0]))
    model.curve = logistic(np.concatenate(seen), ys)
    return model


def _interleaved(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Both labels evenly spread, so that any first part has its share of each."""
    by = [[r for r in rows if r[1] == y] for y in (0, 1)]
    place = [((i + 0.5) / len(part), y, i) for y, part in enumerate(by) for i in range(len(part))]
    return [by[y][i] for _, y, i in sorted(place)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans (start, end: character offsets of toxic runs) of every row.

    Null and empty texts have no words: they get the curve's value for none and
    no span. Repeated rows each get a row; a null doc_id stays null.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.lexicon)
        for batch in sliced(batches):
            raw = [t.as_py() or "" for t in batch.column("text")]
            low = [t.lower() for t in raw]
            words = [t.split() for t in low]
            p, at = model.tokens(words, look)
            hot = np.flatnonzero(p > 0.5)
            spans: list[list[dict[str, int]]] = [[] for _ in raw]
            owner = np.searchsorted(at, hot, side="right") - 1
            for d in np.unique(owner):
                spans[d] = _spans(raw[d], low[d], words[d], set((hot[owner == d] - at[d]).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(p, at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "score", "spans"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, score double, spans array<struct<start: long, end: long>>")


def _spans(raw: str, low: str, words: list[str], hot: set[int]) -> list[dict[str, int]]:
    """Character offsets of runs of hot words."""
    out: list[dict[str, int]] = []
    base = low if len(low) == len(raw) else raw  # lower-casing can lengthen a text
    at, last = 0, -2
    cut = raw.split() if base is raw else words
    for i, w in enumerate(cut):
        at = base.index(w, at)
        if i in hot:
            if i == last + 1:
                out[-1]["end"] = at + len(w)
            else:
                out.append({"start": at, "end": at + len(w)})
            last = i
        at += len(w)
    return out


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, bound: int = FIT_DOCUMENTS) -> Model:
    try:
        return fit(sample(docs, labels, "toxic", folds, fold, bound))
    finally:
        release()  # the driver's own memory


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op5 contract: doc_id, held_out, score, predicted; n_spans, toxic_chars and the spans follow."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("toxic_chars"), "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, in one pass without a shuffle.

    Null and empty texts get the curve's value for no words and stay, unless most
    training rows are toxic; repeated rows and null doc_ids are judged by their
    text like any other. An empty table gives an empty result.
    """
    model = learn(docs, labels)
    ship(docs.sparkSession)
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.lexicon)
        where = [n.lower() for n in names].index("text")
        for batch in sliced(batches, column=names[where]):
            p, at = model.tokens([(t.as_py() or "").lower().split() for t in batch.column(where)], look)
            yield batch.filter(pa.array(model.scores(p, at) < most))

    return docs.mapInArrow(trimmed(run), schema)
