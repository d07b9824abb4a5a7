"""Document quality from good and bad lines of a linear-chain conditional random field.

Fit (on a bounded sample of labelled training rows, in two halves): the joint
class of a line's observations (marks, capitals, digits, repeated words, length)
gets the log odds of standing in a bad document; a line of a bad document whose
odds are high within its own half is a labelled bad line, every other line a good
one. The random field learns from those labels with a line's own observations and
the odds of the line and both neighbours as features, odds being learnt from the
*other* half: labels are no function of the features. Scoring: forward-backward marginals of all lines, averaged by line
length, then a logistic curve fitted to the document labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import release, ship, sliced, texts, trimmed, utf8
from polyquery.llm.crf import Crf, logistic, probability, shifted
from polyquery.llm.labelled import FIT_DOCUMENTS, held_out, sample
from polyquery.llm.lines import CODES, SIZES, Lines, observe, observe_all

ODDS = 6
#: Odds class from which a line of a bad document is a labelled bad line.
GOLD = 2
PRIOR = 2.0


@dataclass
class Model:
    odds: np.ndarray  # class of each joint code of observations
    crf: Crf
    curve: np.ndarray

    def observations(self, lines: Lines, own: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        first = lines.first
        own = self.odds[lines.code] if own is None else own
        return [own, *lines.obs.values(), shifted(own, first, -1, ODDS), shifted(own, first, 1, ODDS)], first

    def bad(self, lines: Lines) -> np.ndarray:
        """P(bad) of every line."""
        return self.crf.marginals(*self.observations(lines)) if len(lines.owner) else np.zeros(0)

    def scores(self, lines: Lines) -> np.ndarray:
        return probability(summary(lines, self.bad(lines)), self.curve)


def summary(lines: Lines, bad: np.ndarray) -> np.ndarray:
    """Per text: the share of its length in bad lines, by marginals, and whether it has no words."""
    n = len(lines.words)
    weight = np.bincount(lines.owner, weights=lines.weight, minlength=n)
    share = np.bincount(lines.owner, weights=lines.weight * bad, minlength=n) / np.maximum(weight, 1)
    return np.column_stack([share, (lines.words == 0).astype(float)])


def _odds(owner: np.ndarray, code: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The odds class of each code, from in how many bad and good documents of ``use`` it stands."""
    pairs = np.unique(np.column_stack([owner, code])[use[owner]], axis=0)
    low = (y == 0)[pairs[:, 0]]
    in_bad = np.bincount(pairs[low, 1], minlength=CODES)
    in_good = np.bincount(pairs[~low, 1], minlength=CODES)
    part = use.mean()  # the priors shrink with it, so that classes mean the same
    odds = np.log((in_bad + 0.01 * part) / (y[use] == 0).sum()) - np.log((in_good + PRIOR * part) / ((y[use] == 1).sum() + PRIOR * part))
    return np.clip(odds.astype(np.int64), 0, ODDS - 1)


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, quality) rows; without both labels, one that scores the share of good rows."""
    sizes = (ODDS, *SIZES.values(), ODDS + 1, ODDS + 1)
    y = np.array([q for _, q in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(CODES, np.int64), Crf(sizes), np.array([0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3))]))
    lines = observe_all([t for t, _ in rows])
    code = lines.code
    bad_doc = (y == 0)[lines.owner]
    model = Model(_odds(lines.owner, code, y, np.ones(len(y), bool)), Crf(sizes), np.zeros(3))
    half = np.zeros(len(y), np.int64)
    for label in (0, 1):  # every other document of each label
        some = np.flatnonzero(y == label)
        half[some] = np.arange(len(some)) % 2
    tables = np.stack([_odds(lines.owner, code, y, half == h) if len(set(y[half == h])) == 2 else model.odds for h in (0, 1)])
    side = half[lines.owner]
    gold = (bad_doc & (tables[side, code] >= GOLD)).astype(np.int64)
    obs, first = model.observations(lines, tables[1 - side, code])
    model.crf.fit(obs, first, gold, steps=30)
    model.curve = logistic(summary(lines, model.crf.marginals(obs, first)), y)
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, bound: int = FIT_DOCUMENTS) -> Model:
    try:
        return fit(sample(docs, labels, "quality", folds, fold, bound))
    finally:
        release()  # the driver's own memory


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_lines and bad_lines of every row.

    Null and empty texts have no lines and get the curve's value for none;
    repeated rows each get a row; a null doc_id stays null. An empty table gives an
    empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines = observe(*utf8(batch.column("text")))
            bad = model.bad(lines)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(probability(summary(lines, bad), model.curve)), pa.array(np.bincount(lines.owner, minlength=n)), pa.array(np.bincount(lines.owner[bad > 0.5], minlength=n))],
                ["doc_id", "score", "n_lines", "bad_lines"],
            )

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, score double, n_lines long, bad_lines long")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 contract: doc_id, held_out, score, predicted; line counts follow."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "bad_lines")
