"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

An alignment of an item of n characters with at most e edits leaves at least
``n + 1 - q * (e + 1)`` of its q-grams whole, all on diagonals (place in the
document minus place in the item) at most e apart. So shared q-grams are counted
in diagonal bands that overlap by e; bands with enough of them are regions, and
only regions are aligned: a dynamic programme over the band's diagonals, free at
the region's ends.

Text is compared with A-Z as a-z and white space runs as one blank; characters
are UTF-8 bytes. Items too short for a q-gram are found as they are, as whole
words, by one automaton over the text. The benchmark is taken in blocks of bounded size, each sent to
all tasks as the fixed query set of one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import SPACES, PrefixHash, ship, sliced, trimmed, utf8
from polyquery.llm.lines import LOWER

Q = 12
#: Edits allowed per character of an item.
BUDGET = 0.05
#: Benchmark text of one pass.
BLOCK_TEXT = 4 << 20
#: Pairs of a place in the text and a place in an item that are held at once.
PAIRS = 1 << 21
_SIEVE_BITS = 22
_HASH = PrefixHash(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 256, dtype=np.uint64)


def normalise(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with single blanks, the texts' offsets in them, and where each byte came from."""
    space = SPACES[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = at[(at > 0) & (at < len(raw))]
    keep[inner] = True  # each text on its own
    place = np.flatnonzero(keep)
    out = LOWER[raw[place]]
    out[space[place]] = 32
    return out, np.searchsorted(place, at), place


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q consecutive bytes."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = _HASH.sums(_BYTE[text])
    start = np.arange(n)
    return _HASH.ranges(sums, start, start + q)


@dataclass
class Index:
    """The q-grams of a block of items."""

    q: int
    items: list[int | None]
    texts: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    code: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    short: ahocorasick.Automaton | None

    @staticmethod
    def build(rows: list[tuple[int | None, str]], q: int = Q, budget: float = BUDGET) -> Index:
        """Items get as many edits as leave a q-gram whole; those of less than q characters are found exactly, those of none match nothing."""
        items, bodies = [], []
        short: dict[str, list[int]] = {}
        for item_id, text in rows:
            raw = np.frombuffer(text.strip().encode("utf-8", "surrogatepass"), np.uint8)
            body = normalise(raw, np.array([0, len(raw)]))[0]
            if len(body):
                if len(body) < q:
                    short.setdefault(body.tobytes().decode("latin-1"), []).append(len(items))
                items.append(item_id)
                bodies.append(body)
        size = np.array([len(b) for b in bodies], np.int64)
        edits = np.minimum((size * budget).astype(np.int64), np.maximum(size // q - 1, 0))
        least = np.maximum(size + 1 - q * (edits + 1), 1)
        codes = [grams(b, q) for b in bodies]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(bodies)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[_slot(code)] = True
        automaton = None
        if short:
            automaton = ahocorasick.Automaton()
            for text, which in short.items():
                automaton.add_word(text, (len(text), which))
            automaton.make_automaton()
        return Index(q, items, bodies, edits, least, code[order], item[order], place[order], sieve, automaton)

    def words(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the short items that stand in ``text`` as whole words."""
        if self.short is None or not len(text):
            return []
        line = text.tobytes().decode("latin-1")
        out = []
        for last, (n, which) in self.short.iter(line):
            start, end = last + 1 - n, last + 1
            if (not start or line[start - 1] == " ") and (end == len(line) or line[end] == " "):
                out += [(i, start, end) for i in which]
        return out

    def hits(self, text: np.ndarray, pairs: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in text, item, place in item) of all shared q-grams, about ``pairs`` (default: PAIRS) at a time."""
        pairs = pairs or PAIRS
        code = grams(text, self.q)
        at = np.flatnonzero(self.sieve[_slot(code)])
        code = code[at]
        low = np.searchsorted(self.code, code, side="left")
        n = np.searchsorted(self.code, code, side="right") - low
        use = n > 0
        at, low, n = at[use], low[use], n[use]
        total = np.cumsum(n)
        begin = 0
        while begin < len(at):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + pairs, side="right")))
            a, l, c = at[begin:end], low[begin:end], n[begin:end]
            for first in range(0, int(c.max()) if len(a) == 1 else 1, pairs if len(a) == 1 else 1):
                if len(a) == 1:  # one q-gram of very many items
                    c = np.minimum(n[begin:end] - first, pairs)
                which = np.repeat(l + first, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                yield np.repeat(a, c), self.item[which], self.place[which]
            begin = end

    def regions(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first diagonal) of bands with enough shared q-grams."""
        kept: list[np.ndarray] = []
        for where, item, place in self.hits(text):
            doc = np.searchsorted(at, where, side="right") - 1
            inside = where + self.q <= at[doc + 1]
            where, item, place, doc = where[inside], item[inside], place[inside], doc[inside]
            if not len(where):
                continue
            e = self.edits[item]
            step = np.maximum(e + 1, 16)  # bands begin every ``step`` diagonals and are step + e wide
            diagonal = where - at[doc] - place + (1 << 20)  # over 0 for items under 2**20 bytes
            band = diagonal // step
            again = diagonal % step < e
            kept.append(_counted(*(np.concatenate((x, y[again])) for x, y in ((doc, doc), (item, item), (band, band - 1), (np.ones_like(doc), np.ones_like(doc))))))
            if len(kept) > 1 and sum(k.shape[1] for k in kept[1:]) > kept[0].shape[1]:
                kept = [_counted(*np.concatenate(kept, axis=1))]
        if not kept:
            return (np.zeros(0, np.int64),) * 3
        d, i, b, count = _counted(*np.concatenate(kept, axis=1)) if len(kept) > 1 else kept[0]
        use = count >= self.least[i]
        step = np.maximum(self.edits[i[use]] + 1, 16)
        return d[use], i[use], b[use] * step - (1 << 20)


def _counted(doc: np.ndarray, item: np.ndarray, band: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The different (doc, item, band), and the sum of their counts."""
    order = np.lexsort((band, item, doc))
    d, i, b = doc[order], item[order], band[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))))
    return np.stack([d[first], i[first], b[first], np.add.reduceat(count[order], first)])


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of ``item`` in ``text`` on diagonals first..last, or None over ``most`` edits.

    The band reaches ``most`` diagonals further on both sides. Of equal
    alignments the one that ends first counts.
    """
    low = first - most
    width = last - first + 2 * most + 1
    k = np.arange(width)
    big = len(item) + width + 1
    n = len(text)
    cost = np.where((low + k >= 0) & (low + k <= n), 0, big)
    begin = low + k
    for i in range(1, len(item) + 1):
        place = low + i + k  # characters of text used, on each diagonal
        inside = (place >= 1) & (place <= n)
        other = text[np.clip(place - 1, 0, max(n - 1, 0))] if n else np.zeros(width, np.uint8)
        diag = np.where(inside, cost + (other != item[i - 1]), big)
        up = np.append(cost[1:] + 1, big)
        take_up = up < diag
        new = np.where(take_up, up, diag)
        start = np.where(take_up, np.append(begin[1:], 0), begin)
        new = np.where((place >= 0) & (place <= n), new, big)
        run = np.minimum.accumulate(new - k)
        source = np.maximum.accumulate(np.where(new - k == run, k, 0))
        better = run + k < new
        begin = np.where(better, start[source], start)
        cost = np.minimum(np.where(better, run + k, new), big)
        cost = np.where((place >= 0) & (place <= n), cost, big)
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    return (int(cost[best]), int(begin[best]), int(low + len(item) + best)) if cost[best] <= most else None


def _matches(index: Index, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, start, end) with byte offsets in each document's own text; overlapping finds of an item count once, the best."""
    text, cut, came = normalise(raw, at)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, i, first in zip(*(x.tolist() for x in index.regions(text, cut))):
        body, e = index.texts[i], int(index.edits[i])
        step = max(e + 1, 16)
        own = text[cut[d] : cut[d + 1]]
        a = max(0, first - e)
        b = min(len(own), first + step + e + len(body) + e)
        exact = own[a:b].tobytes().find(body.tobytes())
        best = (0, a + exact, a + exact + len(body)) if exact >= 0 else align(body, own, first, first + step + e - 1, e)
        if best:
            found.setdefault((d, i), []).append(best)
    if index.short is not None:
        for d in range(len(cut) - 1):
            for i, a, b in index.words(text[cut[d] : cut[d + 1]]):
                found.setdefault((d, i), []).append((0, a, b))
    out = []
    for (d, i), several in found.items():
        taken: list[tuple[int, int, int]] = []
        for edits, a, b in sorted(several):
            if all(b <= x or a >= y for _, x, y in taken):
                taken.append((edits, a, b))
        for edits, a, b in sorted(taken, key=lambda t: t[1]):
            base = int(at[d])
            begin = int(came[cut[d] + a]) - base
            end = int(came[cut[d] + b - 1]) + 1 - base if b > a else begin
            out.append((d, i, edits, begin, end))
    return out


def blocks(benchmark: DataFrame, q: int = Q, budget: float = BUDGET, limit: int = BLOCK_TEXT) -> Iterator[Index]:
    """Indexes over the benchmark's items, ``limit`` bytes of text at a time (streamed, one block on the driver); null texts hold nothing."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"].encode("utf-8", "surrogatepass"))
        if size >= limit:
            yield Index.build(rows, q, budget)
            rows, size = [], 0
    if rows:
        yield Index.build(rows, q, budget)


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, edits, start, end of every benchmark passage in ``docs`` (byte offsets in the text's UTF-8).

    Null and empty texts hold no passage. Items in the benchmark twice are found
    twice; repeated documents each get their rows. Empty inputs give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in blocks(benchmark, q, budget):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows = _matches(held.value, *utf8(batch.column("text")))
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*((ids[d], held.value.items[i], e, a, b) for d, i, e, a, b in rows))) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "edits", "start", "end"])

        part = source.mapInArrow(trimmed(run), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op2: every benchmark passage found in the documents."""
    return find(docs, benchmark)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, a pass without a shuffle for each block of the benchmark.

    Null and empty texts hold none and stay; repeated rows and null doc_ids are
    judged by their text. An empty benchmark keeps all, an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    where = [n.lower() for n in docs.columns].index("text")
    name, schema = docs.columns[where], docs.schema
    for index in blocks(benchmark, q, budget):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, column=name):
                keep = np.ones(batch.num_rows, bool)
                keep[sorted({d for d, *_ in _matches(held.value, *utf8(batch.column(where)))})] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(run), schema)
    return docs
