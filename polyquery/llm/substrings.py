"""Removal of repeated word windows through prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. A word goes if a
window covers it whose word sequence also starts earlier in the corpus.

The suffixes are split by prefixes into groups that fit in memory:

1. *Sampled suffixes.* Of the ``window - prefix + 1`` word runs of length
   ``prefix`` in a window, the leftmost of least hash starts the window's suffix;
   equal windows choose the same run wherever they stand. So the tree needs only
   these suffixes, each with the few words on its left that its windows reach.
   Runs that occur once in the corpus start no repeat and are left out, which
   most are. Hashes serve as a sieve only: equal ones add work, never a repeat.
2. *Groups.* Suffixes that share a prefix meet in one group, groups have bounded
   size. Where a prefix occurs in a great part of all document groups, its
   suffixes first meet in groups of some document groups each (prefix and place:
   the longer key), which pass on only the first of equal suffixes.
3. *Trees.* In a group the suffixes are sorted by their words; the longest common
   prefixes of neighbours give the tree's inner nodes as intervals. A node of
   depth ``window - j``, parted by the ``j`` words on the left, is a repeat of a
   whole window; every place of it but the earliest is marked. Words are compared
   as words (numbered by a dictionary), not as hashes. Marks that follow one
   another merge to the maximal repeated passages.
4. *Cut.* Marks return to their documents, which drop the words they cover.

Texts travel once, compressed, to document groups. Each builds the tree of its
own suffixes first, so a passage that a third of all documents share costs the
other trees one record per document group and not one per occurrence.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import BYTE_A, SPACES, PrefixHash, materialise, mix64, ship, sliced, text_bytes, texts, trimmed, utf8, word_spans

#: Bytes of text in a document group, and in what a group of prefixes or of suffixes comes from.
GROUP_TEXT = 4 << 20
TREE_TEXT = 2 << 20
#: Bytes of text that are hashed in one go; the tables that this takes are many times as large.
HASH_TEXT = 1 << 20
#: Document groups whose suffixes of one prefix meet at once, at least; the square root of all groups if that is more.
FAN = 256
#: Records of a prefix among those from which it counts as hot.
HOT = 64

_BYTES = PrefixHash(0xD6E8FEB86659FD93)
_WORDS = PrefixHash(0xE7037ED1A0B428DB)


class Windows:
    """The sampled suffixes of the windows of the texts ``raw[at[i]:at[i+1]]``."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, window: int, prefix: int):
        self.starts, self.ends, self.owner = word_spans(raw, at)
        n = len(self.starts)
        self.count = np.bincount(self.owner, minlength=len(at) - 1)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.width = window - prefix + 1
        runs = n - prefix + 1
        self.n = max(0, n - window + 1)
        self.least = np.zeros(self.n, np.uint64)
        self.valid = np.zeros(self.n, bool)
        self.is_prefix = np.zeros(max(0, runs), bool)
        self.run = np.zeros(0, np.uint64)
        if not self.n:
            return
        words = mix64(_BYTES.ranges(_BYTES.sums(BYTE_A[raw]), self.starts, self.ends))
        sums = _WORDS.sums(words)
        place = np.arange(n)
        self.run = mix64(_WORDS.ranges(sums, place[:runs], place[:runs] + prefix))
        self.valid = self.owner[: self.n] == self.owner[window - 1 :]
        self.least = _slide(np.minimum, self.run, self.width)
        # a run is a prefix if it is the least of some valid window around it
        held = np.where(self.valid, self.least, np.uint64(0))
        padded = np.concatenate((np.zeros(self.width - 1, np.uint64), held, np.zeros(self.width - 1, np.uint64)))
        self.is_prefix = (_slide(np.maximum, padded, self.width)[:runs] == self.run) & (self.run != 0)

    def suffixes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the sampled suffixes of the windows at words ``at`` (ascending), and the bits of their windows' offsets."""
        offset = np.full(len(at), -1)
        for j in range(self.width):
            offset[(offset < 0) & (self.run[at + j] == self.least[at])] = j
        first = at + offset
        new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        return first[new], np.bitwise_or.reduceat(np.int64(1) << offset, new)


def _slide(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the words, equal for equal words only."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    body = raw[~SPACES[raw]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int32) + 1


def table_of(numbers: np.ndarray, first: np.ndarray, bits: np.ndarray, window: int, width: int) -> np.ndarray:
    """A row of word numbers for each suffix: ``width - 1`` words on its left, ``window`` from its start; 0 where no window reaches."""
    low, high = reach(bits, window)
    column = np.arange(1 - width, window)
    use = (column >= -low[:, None]) & (column < high[:, None])
    place = np.clip(first[:, None] + column, 0, max(len(numbers) - 1, 0))
    return np.where(use, numbers[place], 0).astype(np.int32)


def reach(bits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words windows of the offsets ``bits`` take on the left of a suffix, and from its start on."""
    low = np.floor(np.log2(np.maximum(bits, 1))).astype(np.int64)
    least = np.floor(np.log2(np.maximum(bits & -bits, 1))).astype(np.int64)
    return low, window - least


def repeats(rows: np.ndarray, bits: np.ndarray, window: int, width: int) -> np.ndarray:
    """The offset bits of windows that are not the first of their class; suffixes come in order of place.

    ``rows`` as of :func:`table_of`. The sorted suffixes and their neighbours'
    common prefixes are the suffix tree: nodes of depth d are the intervals
    without a common prefix under d.
    """
    n = len(rows)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    right = np.ascontiguousarray(rows[:, width - 1 :].astype(">u4"))
    order = np.argsort(right.view(f"S{4 * window}").ravel(), kind="stable")
    some = right[order]
    common = np.zeros(n, np.int64)  # words that a suffix shares with the one before it in the tree
    common[1:] = np.logical_and.accumulate(some[1:] == some[:-1], axis=1).sum(axis=1)
    del right, some
    near = common > window - width  # what shares less with both neighbours is in no deep node
    kept = np.flatnonzero(near | np.append(near[1:], False))
    whole, common = np.sort(order[kept]), common[kept]
    order, rows, bits = np.searchsorted(whole, order[kept]), rows[whole], bits[whole]
    left = np.zeros(len(whole), np.int64)
    for j in range(width):
        if j:
            left = np.unique(left << 32 | rows[:, width - 1 - j], return_inverse=True)[1]
        node = np.empty(len(whole), np.int64)
        node[order] = np.cumsum(common < window - j)
        use = np.flatnonzero(bits >> j & 1)
        if len(use) < 2:
            continue
        code = node[use] << 32 | left[use]
        by = np.argsort(code, kind="stable")
        again = code[by[1:]] == code[by[:-1]]
        out[whole[use[by[1:][again]]]] |= 1 << j
    return out


def places(doc: np.ndarray, pos: np.ndarray, bits: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """(doc, first word, ...) of all windows of suffixes at word ``pos`` with the offsets ``bits``, in order of the columns in ``more``, doc and word."""
    parts = []
    for j in range(int(bits.max()).bit_length() if len(bits) else 0):
        use = np.flatnonzero(bits >> j & 1)
        parts.append([doc[use], pos[use] - j, *(m[use] for m in more)])
    if not parts:
        return [doc[:0], pos[:0], *(m[:0] for m in more)]
    found = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((found[1], found[0], *found[2:]))
    return [x[order] for x in found]


def _group_of(column: pa.Array, groups: int) -> np.ndarray:
    """Document group by doc_id; those without one have the group ``groups`` to themselves."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(none, groups, mix64(_ids(column).view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places) of each value of a small-integer array."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(key[part[0]]), part


def _pack(docs: DataFrame, groups: int) -> DataFrame:
    """(g, blob): documents by group, compressed; a blob holds rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, 4 << 20):
            g = _group_of(batch.column("doc_id"), groups)
            keys, blobs = [], []
            for key, rows in _split(g):
                sink = pa.BufferOutputStream()
                some = batch.take(pa.array(rows))
                with pa.ipc.new_stream(sink, some.schema) as out:
                    out.write_batch(some)
                keys.append(key)
                blobs.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["g", "blob"])

    return texts(docs).mapInArrow(trimmed(run), "g int, blob binary")


def _unpack(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """doc_ids and texts in (doc_id, text) order."""
    unpress = zstandard.ZstdDecompressor()
    parts = []
    for blob in table.column("blob"):
        with pa.ipc.open_stream(unpress.decompress(blob.as_py())) as stream:
            parts += list(stream)
    rows = pa.Table.from_batches(parts)
    ids = _ids(rows.column("doc_id").combine_chunks())
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        body = rows.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], body[i] or "")))
    return ids[order], rows.column("text").combine_chunks().take(pa.array(order))


def _offsets(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words of earlier rows with the same doc_id."""
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(ids))))


def _prefixes(docs: DataFrame, groups: int, trees: int, salts: int, window: int, prefix: int) -> DataFrame:
    """(t, salt, known, hash, g): by tree group, prefixes and the document groups they are in; known: repeated already in this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, HASH_TEXT):
            g_of = _group_of(batch.column("doc_id"), groups)
            salt = zlib.crc32(_ids(batch.column("doc_id")).tobytes()) % salts
            w = Windows(*utf8(batch.column("text")), window, prefix)
            at = np.flatnonzero(w.is_prefix)
            code, g = w.run[at], g_of[w.owner[at]]
            order = np.lexsort((g, code))
            code, g = code[order], g[order]
            if not len(code):
                continue
            new = np.concatenate(([True], code[1:] != code[:-1]))
            times = np.diff(np.append(np.flatnonzero(new), len(code)))
            often = np.repeat(times > 1, times)
            single = ~often | new  # a repeated prefix asks for no answer: one record tells of it
            pair = new | np.concatenate(([True], g[1:] != g[:-1]))
            out = []
            for known, use in ((0, single), (1, often & pair)):
                c, d = code[use], g[use].copy()
                if not known:
                    d[often[use]] = -1
                tree = (c % np.uint64(trees)).astype(np.int32)
                for t, rows in _split(tree):
                    out.append((t, salt, known, c[rows].tobytes(), d[rows].tobytes()))
            yield _rows(out, *ASKED)

    return texts(docs).mapInArrow(trimmed(run), _schema(ASKED))


ASKED = (("t", pa.int32()), ("salt", pa.int32()), ("known", pa.int32()), ("hash", pa.binary()), ("g", pa.binary()))
TOLD = (("g", pa.int32()), ("hash", pa.binary()), ("hot", pa.binary()))


def _schema(fields: tuple[tuple[str, pa.DataType], ...]) -> str:
    return ", ".join(f"{name} {'int' if kind == pa.int32() else 'long' if kind == pa.int64() else str(kind)}" for name, kind in fields)


def _rows(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])


def _join(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted prefixes, the document groups that ask (-1: none), whether each occurs twice or more, and its records."""
    known = np.repeat(table.column("known").to_numpy(), [len(x) // 8 for x in table.column("hash").to_pylist()])
    code, g = _join(table.column("hash"), "<u8"), _join(table.column("g"), "<i4")
    order = np.argsort(code, kind="stable")
    code, g, known = code[order], g[order], known[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    size = np.diff(np.append(first, len(code)))
    times = np.add.reduceat(np.where(known == 0, np.where(g < 0, 2, 1), 0), first)
    return code, g, np.repeat(times > 1, size), np.repeat(size, size)


def _told(code: np.ndarray, g: np.ndarray, hot: np.ndarray) -> list[tuple]:
    return [(d, code[rows].tobytes(), np.packbits(hot[rows]).tobytes()) for d, rows in _split(g)]


def _repeated(hot: int):
    """A tree group's prefixes to answers: those that occur twice or more, for each document group that asked."""

    def run(table: pa.Table) -> pa.Table:
        code, g, twice, size = _counted(table)
        use = twice & (g >= 0)
        return pa.Table.from_batches([_rows(_told(code[use], g[use], size[use] > hot), *TOLD)])

    return run


BOTH = (*ASKED, ("told", pa.int32()), ("hot", pa.binary()))


def _reduced(hot: int):
    """Prefixes of some batches to answers where they settle it, and one record a prefix for the rest."""

    def run(table: pa.Table) -> pa.Table:
        code, g, twice, size = _counted(table)
        use = twice & (g >= 0)
        out = [(d, 0, 0, h, b"", 1, flags) for d, h, flags in _told(code[use], g[use], size[use] > hot)]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        tree = table.column("t")[0].as_py()
        out.append((tree, 0, 0, code[new].tobytes(), np.where(twice[new], -1, g[new]).astype("<i4").tobytes(), 0, b""))
        return pa.Table.from_batches([_rows(out, *BOTH)])

    return run


def _ask(docs: DataFrame, groups: int, trees: int, salts: int, window: int, prefix: int, hot: int) -> DataFrame:
    """The answers of all tree groups to the document groups."""
    asked = _prefixes(docs, groups, trees, salts, window, prefix)
    if salts == 1:
        return asked.groupBy("t").applyInArrow(_repeated(hot), _schema(TOLD))
    both = materialise(asked.groupBy("t", "salt").applyInArrow(_reduced(hot), _schema(BOTH)), "substrings-asked")
    early = both.where("told = 1").select(F.col("t").alias("g"), "hash", "hot")
    late = both.where("told = 0").select(*(n for n, _ in ASKED)).groupBy("t").applyInArrow(_repeated(hot), _schema(TOLD))
    return early.unionAll(late)


#: Suffixes of a document group for a tree (known 0), or places that are settled (known 1: doc, pos, size).
SUFFIX = (("t", pa.int32()), ("salt", pa.int32()), ("known", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("size", pa.binary()), ("bits", pa.binary()), ("words", pa.binary()), ("g", pa.int32()))


def _sent(t: int, salt: int, g: int, code: np.ndarray, doc: np.ndarray, pos: np.ndarray, bits: np.ndarray, words: list[bytes]) -> tuple:
    return (t, salt, 0, code.astype("<u8").tobytes(), doc.tobytes(), pos.astype("<i4").tobytes(), b"", bits.astype("<i4").tobytes(), zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), g)


def _settled(t: int, g: int, doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    for d, p, n in _runs(doc, pos):
        yield (t, -1, 1, b"", d.tobytes(), p.tobytes(), n.tobytes(), b"", b"", g)


def _suffixes(trees: int, fan: int, salts: int, window: int, prefix: int):
    """A document group's texts and repeated prefixes to suffixes by tree group, and places that its own tree settles."""
    width = window - prefix + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_rows([], *SUFFIX)])
        g = left.column("g")[0].as_py()
        asked = _join(right.column("hash"), "<u8")
        hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(h) // 8) for b, h in zip(right.column("hot").to_pylist(), right.column("hash").to_pylist())]).astype(bool)
        order = np.argsort(asked)
        asked, hot = asked[order], hot[order]
        ids, text = _unpack(left)
        raw, at = utf8(text)
        starts, ends, owner = word_spans(raw, at)
        offset = _offsets(ids, np.bincount(owner, minlength=len(ids)))
        firsts, marks, codes, hots = [], [], [], []
        base = 0
        for part in sliced(iter([pa.RecordBatch.from_arrays([text], ["text"])]), HASH_TEXT):
            w = Windows(*utf8(part.column("text")), window, prefix)
            if w.n:
                found = np.minimum(np.searchsorted(asked, w.least), len(asked) - 1)
                some = np.flatnonzero(w.valid & (asked[found] == w.least))
                if len(some):
                    first, bits = w.suffixes(some)
                    firsts.append(first + base)
                    marks.append(bits)
                    codes.append(w.run[first])
                    hots.append(hot[np.searchsorted(asked, w.run[first])])
            base += len(w.starts)
            del w
        if not firsts:
            return pa.Table.from_batches([_rows([], *SUFFIX)])
        first, bits, code, is_hot = (np.concatenate(x) for x in (firsts, marks, codes, hots))
        begin = np.searchsorted(owner, np.arange(len(ids)))
        doc, pos = ids[owner[first]], first - begin[owner[first]] + offset[owner[first]]
        # texts are in order of doc_id and place, and so are the suffixes
        again = repeats(table_of(word_numbers(raw, starts, ends), first, bits, window, width), bits, window, width)
        out = list(_settled(int(mix64(np.array([g], np.uint64))[0] % np.uint64(trees)), g, *places(doc, pos, again)))
        bits = bits & ~again
        use = np.flatnonzero(bits)
        first, bits, code, is_hot, doc, pos = (x[use] for x in (first, bits, code, is_hot, doc, pos))
        low, high = reach(bits, window)
        lined, at = _lined(raw, starts, ends)
        a, b = at[first - low], at[first + high] - 1
        tree = (code % np.uint64(trees)).astype(np.int32)
        salt = np.where(is_hot, g // fan, -1) if salts > 1 else np.full(len(code), -1)
        for key, rows in _split(tree.astype(np.int64) << 32 | (salt + 1)):
            words = [lined[x:y] for x, y in zip(a[rows].tolist(), b[rows].tolist())]
            out.append(_sent(key >> 32, (key & 0xFFFFFFFF) - 1, g, code[rows], doc[rows], pos[rows], bits[rows], words))
        return pa.Table.from_batches([_rows(out, *SUFFIX)])

    return run


def _lined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one blank behind each, and where each begins (and the last ends)."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 32, np.uint8)
    blank = np.zeros(at[-1], bool)
    blank[at[1:] - 1] = True
    out[~blank] = raw[~SPACES[raw]]
    return out.tobytes(), at


def _runs(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive places of one document as (doc, place, number); nothing if there are none."""
    if len(doc):
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))))
        yield doc[first], pos[first].astype("<i4"), np.diff(np.append(first, len(doc))).astype("<i4")


def _trees(groups: int, window: int, prefix: int, last: bool):
    """A tree group's suffixes to settled places; unless it is the ``last`` tree for them, also to the suffixes that are the first of their kind."""
    width = window - prefix + 1

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(pc.equal(table.column("known"), 1))
        out = [tuple(r.values()) for r in done.select([n for n, _ in SUFFIX]).to_pylist()]
        own = table.filter(pc.equal(table.column("known"), 0))
        if own.num_rows:
            t = own.column("t")[0].as_py()
            unpress = zstandard.ZstdDecompressor()
            bits = _join(own.column("bits"), "<i4").astype(np.int64)
            doc, pos, code = _join(own.column("doc"), "<i8"), _join(own.column("pos"), "<i4").astype(np.int64), _join(own.column("hash"), "<u8")
            g = np.repeat(own.column("g").to_numpy(), [len(x) // 4 for x in own.column("bits").to_pylist()])
            body = b" ".join(unpress.decompress(x.as_py()) for x in own.column("words"))
            raw = np.frombuffer(body, np.uint8)
            starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
            low, high = reach(bits, window)
            begin = np.cumsum(low + high) - (low + high)
            order = np.lexsort((pos, doc, g == groups))  # those without a doc_id come last
            first = (begin + low)[order]
            bits, doc, pos, code, g = (x[order] for x in (bits, doc, pos, code, g))
            again = repeats(table_of(word_numbers(raw, starts, ends), first, bits, window, width), bits, window, width)
            d, p, where = places(doc, pos, again, g)
            for key, rows in _split(where):
                out += _settled(t, key, d[rows], p[rows])
            if not last:
                bits = bits & ~again
                use = np.flatnonzero(bits)
                first, bits, doc, pos, code, g = (x[use] for x in (first, bits, doc, pos, code, g))
                low, high = reach(bits, window)
                a, b = starts[first - low].tolist(), ends[first + high - 1].tolist()
                for key, rows in _split(g):
                    out.append(_sent(t, -1, key, code[rows], doc[rows], pos[rows], bits[rows], [body[a[i] : b[i]] for i in rows.tolist()]))
        return pa.Table.from_batches([_rows(out, *SUFFIX)])

    return run


def _cut(groups: int, window: int, with_text: bool):
    """A document group's texts and marks to results."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_passages", pa.int64()), ("kept_sha256", pa.string()), *((("text", pa.string()),) if with_text else ()))
        if not left.num_rows:
            return pa.Table.from_batches([_rows([], *fields)])
        none = left.column("g")[0].as_py() == groups
        ids, text = _unpack(left)
        words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in text]
        count = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(count)))
        cover = np.zeros(begin[-1] + 1, np.int64)
        if right.num_rows:
            doc, pos, size = _join(right.column("doc"), "<i8"), _join(right.column("pos"), "<i4").astype(np.int64), _join(right.column("size"), "<i4")
            # rows are in (doc_id, text) order: the first row of a doc_id, then on by the words of its rows
            start = begin[np.searchsorted(ids, doc)] + pos
            np.add.at(cover, start, 1)
            np.add.at(cover, start + size + window - 1, -1)
        gone = np.cumsum(cover)[:-1] > 0
        out = []
        for i, w in enumerate(words):
            mask = gone[begin[i] : begin[i + 1]]
            removed = int(mask.sum())
            passages = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
            if removed:
                w = [x for x, g in zip(w, mask.tolist()) if not g]
            kept = b" ".join(w)
            row = (None if none else int(ids[i]), int(count[i]), removed, passages, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "surrogatepass")) if with_text else row)
        return pa.Table.from_batches([_rows(out, *fields)])

    return run


def dedup(docs: DataFrame, window: int = 20, prefix: int = 8, with_text: bool = False, group_text: int = GROUP_TEXT, tree_text: int = TREE_TEXT, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, n_passages (removed runs), kept_sha256 (and the kept words as ``text``) of every row.

    Words are runs of other characters than space and 0x09-0x0D. Null and empty
    texts have no words. Rows with one doc_id count as one document, one after
    the other in the order of their texts (no window spans two); a null doc_id
    comes after all others. Other columns of ``docs`` are ignored. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    total = text_bytes(docs)
    groups, trees = max(1, -(-total // group_text)), max(1, -(-total // tree_text))
    fan = max(fan, int(np.ceil(np.sqrt(groups + 1))))
    salts = -(-(groups + 1) // fan)
    packed = _pack(docs, groups)
    told = _ask(docs, groups, trees, salts, window, prefix, hot)
    suffixes = packed.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_suffixes(trees, fan, salts, window, prefix), _schema(SUFFIX))
    if salts > 1:
        suffixes = materialise(suffixes, "substrings-suffixes")
        reduced = suffixes.where("salt >= 0").groupBy("t", "salt").applyInArrow(_trees(groups, window, prefix, False), _schema(SUFFIX))
        suffixes = suffixes.where("salt < 0").unionAll(reduced)
    marks = suffixes.groupBy("t").applyInArrow(_trees(groups, window, prefix, True), _schema(SUFFIX)).select("g", "doc", "pos", "size")
    schema = "doc_id long, n_words long, n_removed long, n_passages long, kept_sha256 string" + (", text string" if with_text else "")
    return packed.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(_cut(groups, window, with_text), schema)


def query(docs: DataFrame) -> DataFrame:
    """The op6 contract: windows of 20 words."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The contract in the SQL of an independent engine, by comparing whole windows.
ORACLE = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), places as (
  select doc_id, words, unnest(generate_series(1, len(words)::bigint)) as i from docs
), windows as (
  select doc_id, i, case when i + 19 <= len(words) then row_number() over (
    partition by case when i + 19 <= len(words) then array_to_string(words[i:i + 19], ' ') else doc_id || ' ' || i end, i + 19 <= len(words)
    order by doc_id, i) end as nth, words[i] as word
  from places
), covered as (
  select doc_id, i, word, coalesce(max(nth) over (partition by doc_id order by i rows between 19 preceding and current row), 1) > 1 as gone from windows
), kept as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as body
  from covered group by doc_id
)
select docs.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256
from docs left join kept on docs.doc_id = kept.doc_id
"""
