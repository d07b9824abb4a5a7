"""Observations of lines, counted for a whole batch of texts with vector operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from polyquery.llm.common import BYTE_A, PrefixHash, mix64, sliced, utf8, word_spans

#: Marks that prose seldom has in numbers.
_MARK = np.zeros(256, bool)
_MARK[list(b"!*&%$#|<>{}[]=~^@\\_")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Upper bounds of the classes of each share (of bytes or words) and of the word count.
SHARES = {"marks": (0.005, 0.03, 0.10), "upper": (0.06, 0.15, 0.40), "digits": (0.05, 0.15, 0.40), "repeats": (0.02, 0.10, 0.40)}
WORDS = (0, 3, 12, 40, 150)
SIZES = {"marks": 4, "upper": 4, "digits": 4, "repeats": 4, "words": 6}
HASH = PrefixHash(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """The non-empty lines of a batch of texts, in order."""

    owner: np.ndarray
    weight: np.ndarray
    obs: dict[str, np.ndarray]
    words: np.ndarray  # words of each text
    starts: np.ndarray  # first byte of each word, its end, its text and its hash (A-Z as a-z)
    ends: np.ndarray
    word_owner: np.ndarray
    word_hash: np.ndarray
    sums: np.ndarray  # running sums of HASH over the bytes

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([True], self.owner[1:] != self.owner[:-1])) if len(self.owner) else np.zeros(0, bool)

    @property
    def code(self) -> np.ndarray:
        """All observations of a line as one number."""
        out = np.zeros(len(self.owner), np.int64)
        for name, size in SIZES.items():
            out = out * size + self.obs[name]
        return out


CODES = int(np.prod(list(SIZES.values())))


#: The three tables side by side in one number, to count all of them in one pass; for lines under 2**21 bytes.
_FIELD = 21
_PACKED = _MARK.astype(np.int64) | _UPPER.astype(np.int64) << _FIELD | _DIGIT.astype(np.int64) << 2 * _FIELD
_LOW = BYTE_A[LOWER]


def hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, A-Z counting as a-z."""
    return mix64(HASH.ranges(sums, starts, ends))


def _counts(raw: np.ndarray, begins: np.ndarray, longest: int) -> dict[str, np.ndarray]:
    if longest < 1 << _FIELD:
        packed = np.add.reduceat(_PACKED[raw], begins)
        low = (1 << _FIELD) - 1
        return {"marks": packed & low, "upper": packed >> _FIELD & low, "digits": packed >> 2 * _FIELD}
    return {name: np.add.reduceat(table[raw].astype(np.int64), begins) for name, table in (("marks", _MARK), ("upper", _UPPER), ("digits", _DIGIT))}


def observe(raw: np.ndarray, at: np.ndarray) -> Lines:
    """The lines of the texts ``raw[at[i]:at[i+1]]`` (UTF-8)."""
    texts = len(at) - 1
    starts, ends, owner = word_spans(raw, at)
    sums = HASH.sums(_LOW[raw])
    codes = hashed(sums, starts, ends)
    words = np.bincount(owner, minlength=texts)
    # a line starts at each text's start and behind each line feed
    begins = np.unique(np.concatenate((at[:-1], np.flatnonzero(raw == 10) + 1)))
    begins = begins[begins < len(raw)]
    if not len(begins):
        empty = np.zeros(0, np.int64)
        return Lines(empty, empty.astype(float), {k: empty for k in SIZES}, words, starts, ends, owner, codes, sums)
    size = np.diff(np.append(begins, len(raw))).astype(float)
    share = {name: n / size for name, n in _counts(raw, begins, int(size.max())).items()}
    line_of = np.searchsorted(begins, starts, side="right") - 1
    count = np.bincount(line_of, minlength=len(begins))
    same = np.zeros(len(starts), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
    share["repeats"] = np.bincount(line_of, weights=same, minlength=len(begins)) / np.maximum(count, 1)
    obs = {name: np.searchsorted(np.array(SHARES[name]), x, side="right") for name, x in share.items()}
    obs["words"] = np.searchsorted(np.array(WORDS), count, side="left")
    full = count > 0
    line_owner = np.searchsorted(at, begins, side="right") - 1
    return Lines(line_owner[full], size[full], {k: v[full] for k, v in obs.items()}, words, starts, ends, owner, codes, sums)


def observe_all(texts: list[str], limit: int = 1 << 20) -> Lines:
    """The lines of many texts, hashed ``limit`` bytes at a time; words are counted and not kept."""
    parts, base = [], 0
    for batch in sliced(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]), limit):
        part = observe(*utf8(batch.column("text")))
        parts.append((part.owner + base, part.weight, part.obs, part.words))
        base += batch.num_rows
    none = np.zeros(0, np.uint64)
    owner, weight, words = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
    return Lines(owner, weight, {k: np.concatenate([p[2][k] for p in parts]) for k in SIZES}, words, none, none, none, none, none)
