"""Mixing by soft membership: document rates whose expected domain tokens meet targets.

1. A softmax regression, fitted on a bounded sample of the labelled table,
   gives every document its posterior over the domains. Its features are the
   shares of the text in each class of line and the words that speak for one
   domain in the sample; one vectorised pass over whole texts.
2. Nonnegative rates r minimise the squared distance of the expected domain
   totals sum(r * tokens * posterior) to the targets, by projected gradient
   steps from r = 1, in units where a document weighs as its tokens:
   r <- max(0, r - length * posterior . gap), gap being the totals less the
   targets. Lengths are Barzilai and Borwein's, taken if the distance falls
   enough against the last few; else shorter ones, down to the reciprocal of the
   Gram matrix's largest eigenvalue, which always descends. A step is the same
   small vector for all documents and an iteration one aggregation to K + 1
   numbers, so nothing of the corpus ever is on the driver; rates are written
   every few steps. The fit has converged when the targets are met or the
   projected gradient vanishes, which for this convex problem is the minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import materialise, release, ship, sliced, texts, trimmed, utf8
from polyquery.llm.labelled import FIT_CHARACTERS, within
from polyquery.llm.lines import SIZES, Lines, hashed, observe

DOMAINS = ("good", "poor", "toxic")
#: Labelled documents of each domain that the fit uses at most (about).
FIT_EACH = 700
#: Bytes of text that the fit looks at in one go.
FIT_SLICE = 1 << 20
STEMS = (4, 5, 6)
LEAST_DOCUMENTS = 4
PRIOR = 2.0
ODDS = 3.0
#: Aggregations of a fit at most; steps after which rates are written.
STEPS = 200
REWRITE = 10
#: Largest gap, as a share of the tokens, at which targets count as met; largest projected gradient at which a fit that can't meet them has converged.
TOLERANCE = 1e-7
FLAT = 1e-6
#: Distances that a step is held against, and the part of its promise that it must keep.
MEMORY = 5
ENOUGH = 1e-4


@dataclass
class Model:
    """Softmax weights (features x domains) and, by domain, the sorted hashes of words that speak for it."""

    weights: np.ndarray
    words: list[np.ndarray] = field(default_factory=list)

    def posteriors(self, lines: Lines, stems: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = features(lines, stems, self.words) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def look(raw: np.ndarray, at: np.ndarray) -> tuple[Lines, list[tuple[np.ndarray, np.ndarray]]]:
    """Lines, and (hash, text) of all words and of the beginnings of longer ones."""
    lines = observe(raw, at)
    out = [(lines.word_hash, lines.word_owner)]
    size = lines.ends - lines.starts
    for n in STEMS:
        long = np.flatnonzero(size > n)
        begin = lines.starts[long]
        out.append((hashed(lines.sums, begin, begin + n) ^ np.uint64(n), lines.word_owner[long]))
    return lines, out


def sieve(table: np.ndarray) -> np.ndarray:
    """Which low 16 bits the hashes of ``table`` have."""
    out = np.zeros(1 << 16, bool)
    out[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def features(lines: Lines, stems: list[tuple[np.ndarray, np.ndarray]], words: list[np.ndarray]) -> np.ndarray:
    n = len(lines.words)
    weight = np.bincount(lines.owner, weights=lines.weight, minlength=n)
    columns = [np.ones(n), (lines.words == 0).astype(float)]
    for name, size in SIZES.items():
        if name == "words":
            continue
        shares = np.bincount(lines.owner * size + lines.obs[name], weights=lines.weight, minlength=n * size).reshape(n, size)
        columns += list((shares[:, 1:] / np.maximum(weight, 1)[:, None]).T)
    for table in words:
        hits = np.zeros(n)
        if len(table):
            passed = sieve(table)
            for codes, owner in stems:
                some = np.flatnonzero(passed[(codes & np.uint64(0xFFFF)).astype(np.int64)])
                code = codes[some]
                place = np.minimum(np.searchsorted(table, code), len(table) - 1)
                hits += np.bincount(owner[some[table[place] == code]], minlength=n)
        columns += [np.log1p(hits), (hits > 0).astype(float)]
    return np.column_stack(columns)


def fit(rows: list[tuple[str, int]], domains: int) -> Model:
    """From (text, domain number) rows; domains without rows keep a small prior."""
    y = np.array([d for _, d in rows], dtype=np.int64)
    if not len(y):
        return Model(np.zeros((2 + 12 + 2 * domains, domains)), [np.zeros(0, np.uint64)] * domains)
    texts_ = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.large_string())], ["text"])
    found: list[list[np.ndarray]] = [[] for _ in range(domains)]
    base = 0
    for batch in sliced(iter([texts_]), FIT_SLICE):
        _, stems = look(*utf8(batch.column("text")))
        for codes, owner in stems:
            kind = y[base + owner]
            for d in range(domains):
                pick = kind == d
                pairs = np.unique(np.stack([codes[pick], owner[pick].astype(np.uint64)]), axis=1)
                found[d].append(pairs[0])
        base += batch.num_rows
    counts = [np.unique(np.concatenate(f), return_counts=True) for f in found]
    del found
    size = np.bincount(y, minlength=domains)
    words = []
    for d in range(domains):
        code, n = counts[d]
        often = n >= LEAST_DOCUMENTS
        code, n = code[often], n[often]
        other = np.zeros(len(code))
        for k in range(domains):
            if k != d and len(counts[k][0]):
                at = np.minimum(np.searchsorted(counts[k][0], code), len(counts[k][0]) - 1)
                other += np.where(counts[k][0][at] == code, counts[k][1][at], 0)
        rest = len(y) - size[d]
        odds = np.log(np.maximum(n, 1) / max(1, size[d])) - np.log((other + PRIOR) / (rest + PRIOR))
        words.append(np.sort(code[odds >= ODDS]) if rest else code[:0])
    del counts
    x = np.concatenate([features(*look(*utf8(b.column("text"))), words) for b in sliced(iter([texts_]), FIT_SLICE)])
    w = np.zeros((x.shape[1], domains))
    onehot = np.eye(domains)[y]
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 301):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (onehot - p) / len(y) - 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w += 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model(w, words)


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and the number of its domain in DOMAINS, from the labels table."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def learn(docs: DataFrame, domains: DataFrame, count: int, each: int = FIT_EACH, characters: int = FIT_CHARACTERS) -> Model:
    """Fit on about ``each`` labelled documents of each domain, picked by a hash of doc_id, and at most ``characters`` of text."""
    sizes = {r["domain"]: r["n"] for r in domains.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 20
    under = F.lit(0)
    for d, n in sizes.items():
        under = F.when(F.col("domain") == d, F.lit(min(spread, int(spread * each / n)))).otherwise(under)
    ids = domains.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < under)
    # about ``each`` rows a domain: small enough to send to every task
    rows = within(docs, ids.withColumnRenamed("domain", "label"), characters)
    try:
        return fit([(text, d) for _, text, d in sorted(rows, key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1]))], count)
    finally:
        release()  # the driver's own memory


def posteriors(docs: DataFrame, model: Model, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """doc_id, n_tokens (words) and p_<domain> of every row; null and empty texts have no tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines, stems = look(*utf8(batch.column("text")))
            p = model.posteriors(lines, stems)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines.words), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", "n_tokens", *(f"p_{n}" for n in names)])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_tokens long, " + ", ".join(f"p_{n} double" for n in names))


def rate_column(steps: list[np.ndarray], names: tuple[str, ...] = DOMAINS, start: Column | None = None) -> Column:
    """The rate of a row after ``steps`` from ``start`` (1)."""
    r = F.lit(1.0) if start is None else start
    for u in steps:
        move = F.lit(0.0)
        for k, n in enumerate(names):
            move = move + F.col(f"p_{n}") * F.lit(float(u[k]))
        r = F.greatest(F.lit(0.0), r - move)
    return r


@dataclass
class Fit:
    """The steps from rate 1; tokens wanted and reached of each domain; whether it is the minimum; aggregations."""

    steps: list[np.ndarray]
    wanted: dict[str, float]
    reached: dict[str, float]
    converged: bool
    passes: int


def rates(table: DataFrame, targets: dict[str, float], total: float | None = None, names: tuple[str, ...] = DOMAINS, most: int = STEPS) -> Fit:
    """The rates that bring expected domain totals nearest to the targets.

    ``targets`` are weights of the domains (negative ones count as 0; they are
    scaled to sum to 1), ``total`` the tokens wanted (default: those of
    ``table``). Targets that no rates meet give the nearest totals there are.
    Without tokens or without targets all rates stay 1.
    """
    k = len(names)
    want = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    w = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{n}") for n in names]
    first = table.agg(F.sum(w).alias("n"), *(F.sum(w * p[i]).alias(f"a{i}") for i in range(k)), *(F.sum(w * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    start = first["n"] or 0.0
    if not start or not want.sum():
        return Fit([], dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), True, 1)
    goal = want / want.sum() * (start if total is None else total) / start
    gram = np.array([[first[f"g{max(i, j)}_{min(i, j)}"] / start for j in range(k)] for i in range(k)])
    least = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    gap = np.array([first[f"a{i}"] / start for i in range(k)]) - goal
    now = table.select("n_tokens", *(f"p_{n}" for n in names)).withColumn("rate", F.lit(1.0))
    taken: list[np.ndarray] = []
    steps, length, passes = [], least, 1
    seen = [float(gap @ gap) / 2]
    done = np.abs(gap).max() < TOLERANCE
    while not done and passes < most:
        if len(steps) >= REWRITE:
            now, steps = materialise(now.withColumn("rate", rate_column(steps, names, F.col("rate"))), "mixing-rates"), []
        old, new = rate_column(steps, names, F.col("rate")), rate_column([*steps, length * gap], names, F.col("rate"))
        row = now.select("*", old.alias("old"), new.alias("new")).agg(F.sum(w * (F.col("new") - F.col("old")) * (F.col("new") - F.col("old"))).alias("moved"), *(F.sum(w * F.col("new") * p[i]).alias(f"a{i}") for i in range(k))).first()
        passes += 1
        other = np.array([row[f"a{i}"] / start for i in range(k)]) - goal
        distance, moved = float(other @ other) / 2, row["moved"] / start
        if length > least * 1.001 and distance > max(seen[-MEMORY:]) - ENOUGH * moved / length:
            length = max(length / 4, least)
            continue
        steps.append(length * gap)
        taken.append(steps[-1])
        done = np.abs(other).max() < TOLERANCE or np.sqrt(moved) / length < FLAT
        turn = other - gap
        bend = float(turn @ turn)
        length = float(np.clip(moved / bend, least, 1e6 * least)) if bend > 0 else least
        gap = other
        seen.append(distance)
    tokens = lambda x: {n: float(v * start) for n, v in zip(names, x)}
    return Fit(taken, tokens(goal), tokens(gap + goal), bool(done), passes)


def chance(doc_id: Column) -> Column:
    """A number from 0 to 1 by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long")), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies (rate rounded by a hash of doc_id, so that its mean is the rate) of every row.

    Null and empty texts have no tokens and don't count in any total; repeated
    rows each get a row; a null doc_id stays null and draws like any other. Of
    several labels of a doc_id the worst counts, null ones don't. Without labels
    all domains are alike. An empty table gives an empty result.
    """
    model = learn(docs, domain_of(labels), len(DOMAINS))
    table = materialise(posteriors(docs, model), "mixing")
    rate = F.col("rate")
    return table.withColumn("rate", rate_column(rates(table, targets, total).steps)).withColumn("copies", (F.floor(rate) + (chance(F.col("doc_id")) < rate - F.floor(rate)).cast("long")).cast("long"))


#: op1: two thirds more poor text than labels call for is never wanted; toxic text is kept rare.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: as many tokens as there are, mixed to TARGETS."""
    return mix(docs, labels, TARGETS)


def keep_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, each at most once: a row of rate under 1 stays with that probability, by a hash of its doc_id.

    The total is what the weights call for when all good text stays, so good
    documents keep a rate of about 1; of a domain there is not more asked for
    than there is, so no row has to be repeated. A row that is good by more than
    half is never dropped. Rows without words stay; null doc_ids draw like any
    other; repeated rows share their draw. An empty table gives an empty result.
    """
    model = learn(docs, domain_of(labels), len(DOMAINS))
    ship(docs.sparkSession)
    names = docs.columns
    where = [n.lower() for n in names].index("text")
    inner = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=inner[where]):
            lines, stems = look(*utf8(batch.column(where)))
            p = model.posteriors(lines, stems)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines.words), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], [*inner, "n_tokens", *(f"p_{n}" for n in DOMAINS)])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema.fields))
    table = docs.toDF(*inner).mapInArrow(trimmed(run), f"{kinds}, n_tokens long, " + ", ".join(f"p_{n} double" for n in DOMAINS))
    table = materialise(table, "mixing")
    there = table.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{n}")), F.lit(0.0)).alias(n) for n in DOMAINS)).first()
    total = there["good"] / targets["good"] if targets.get("good") else sum(there)
    wanted = {n: min(there[n], targets.get(n, 0.0) * total) for n in DOMAINS}
    steps = rates(table, wanted, sum(wanted.values())).steps
    key = F.col(inner[[n.lower() for n in names].index("doc_id")])
    stays = (F.col("n_tokens") == 0) | (F.col("p_good") > 0.5) | (chance(key) < rate_column(steps))
    return table.where(stays).select(*inner).toDF(*names)
