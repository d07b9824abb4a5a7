"""A two-label linear-chain conditional random field over many short or long chains at once.

Every position has a few discrete observations; the score of label 1 at a
position is the sum of their weights (label 0 scores 0), and a 2 x 2 matrix
scores neighbouring labels. All chains of a batch lie behind one another in
flat arrays. The forward and backward recursions run over blocks side by side:
within a block the 2 x 2 steps multiply up, the blocks are then joined one
after the other. So the cost is a few vector operations per position of a
block, however the chains' lengths are spread, and memory is linear.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Extra weight decay of the fit.
RIDGE = 1e-3


@dataclass
class Crf:
    """Weights: ``unary[f][value]`` for observation f, ``pair[a, b]`` between labels, ``start`` of label 1."""

    sizes: tuple[int, ...]
    unary: list[np.ndarray] = field(default_factory=list)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def __post_init__(self) -> None:
        if not self.unary:
            self.unary = [np.zeros(n) for n in self.sizes]

    def scores(self, obs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(obs[0]))
        for w, o in zip(self.unary, obs):
            out += w[o]
        return out

    def marginals(self, obs: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """P(label 1) of every position; ``first`` marks the first positions of chains."""
        return _forward_backward(self.scores(obs), first, self.pair, self.start)[0]

    def fit(self, obs: list[np.ndarray], first: np.ndarray, labels: np.ndarray, steps: int = 40, rate: float = 0.2) -> Crf:
        """Maximum likelihood by Adam on whole-data gradients (labels known at every position)."""
        n = max(1, len(labels))
        y = labels.astype(float)
        inner = ~first
        prev, here = labels[:-1][inner[1:]], labels[1:][inner[1:]]
        seen_pair = np.bincount(2 * prev.astype(int) + here, minlength=4).reshape(2, 2).astype(float)
        seen = [np.bincount(o, weights=y, minlength=m) for o, m in zip(obs, self.sizes)]
        # start from each value's own odds; the steps then weigh observations and neighbours against each other
        base = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        for k, (o, m, s1) in enumerate(zip(obs, self.sizes, seen)):
            if not self.unary[k].any():
                self.unary[k] = np.log((s1 + 0.5) / (np.bincount(o, minlength=m) - s1 + 0.5)) if k == 0 else np.zeros(m)
        if not self.pair.any():
            self.pair = np.log((seen_pair + 0.5) / (seen_pair.sum(axis=1, keepdims=True) + 1)) - np.array([0.0, base])
        theta = np.concatenate([*self.unary, self.pair.ravel(), [self.start]])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        cuts = np.cumsum([*self.sizes, 4])
        # weights of rare values move as fast as others: gradients are per observation of the value
        weight = np.concatenate([*[np.bincount(o, minlength=m) for o, m in zip(obs, self.sizes)], [n] * 4, [max(1, first.sum())]]).astype(float)
        for t in range(1, steps + 1):
            p, pairs = _forward_backward(self.scores(obs), first, self.pair, self.start, want_pairs=True)
            parts = [s - np.bincount(o, weights=p, minlength=m) for s, o, m in zip(seen, obs, self.sizes)]
            grad = np.concatenate([*parts, (seen_pair - pairs).ravel(), [(y[first] - p[first]).sum()]]) / np.sqrt(weight + 1.0) - RIDGE * theta
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.99 * m2 + 0.01 * grad * grad
            theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8) / (1 + t / steps)
            cut = np.split(theta, cuts)
            self.unary, self.pair, self.start = cut[: len(self.sizes)], cut[-2].reshape(2, 2), float(cut[-1][0])
        return self


def _forward_backward(score: np.ndarray, first: np.ndarray, pair: np.ndarray, start: float, want_pairs: bool = False):
    """P(label 1) at every position, and the expected counts of label pairs inside chains."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    size = blocks * width
    s = np.zeros(size)
    s[:n] = np.clip(score, -50, 50)
    new = np.ones(size, bool)
    new[:n] = first
    e1 = np.exp(np.minimum(s, 0))  # emissions of labels 0 and 1, scaled to at most 1
    e1 = np.where(s > 0, 1.0, e1)
    e0 = np.where(s > 0, np.exp(-np.maximum(s, 0)), 1.0)
    trans = np.exp(pair - pair.max())
    begin = np.exp(np.array([0.0, start]) - max(0.0, start))
    # step[t][a][b]: from label a before t to label b at t
    step = np.empty((size, 2, 2))
    for b, e in ((0, e0), (1, e1)):
        for a in (0, 1):
            step[:, a, b] = np.where(new, begin[b], trans[a, b]) * e
    step = step.reshape(blocks, width, 2, 2).transpose(1, 0, 2, 3)  # position in block first

    def product(order: range, right: bool) -> np.ndarray:
        total = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
        for k in order:
            m = step[k]
            total = _mul(total, m) if right else _mul(m, total)
            total /= total.sum(axis=(1, 2), keepdims=True)
        return total

    whole = product(range(width), True)
    enter = np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        enter[b] = v
        v = v @ whole[b]
        v /= v.sum()
    leave = np.empty((blocks, 2))
    v = np.ones(2)
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = whole[b] @ v
        v /= v.sum()
    alpha = np.empty((width, blocks, 2))
    v = enter
    for k in range(width):
        m = step[k]
        v = v[:, 0:1] * m[:, 0] + v[:, 1:2] * m[:, 1]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[k] = v
    beta = np.empty((width, blocks, 2))
    v = leave
    for k in range(width - 1, -1, -1):
        beta[k] = v
        m = step[k]
        v = m[:, :, 0] * v[:, 0:1] + m[:, :, 1] * v[:, 1:2]
        v = v / v.sum(axis=1, keepdims=True)
    both = alpha * beta
    p = (both[:, :, 1] / both.sum(axis=2)).T.reshape(-1)[:n]
    if not want_pairs:
        return p, None
    before = np.concatenate((enter[None], alpha[:-1]))
    joint = before[:, :, :, None] * step * beta[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    flat = joint.transpose(1, 0, 2, 3).reshape(size, 2, 2)[:n]
    return p, flat[~first].sum(axis=0)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of 2 x 2 matrices."""
    out = np.empty_like(a)
    for i in (0, 1):
        for j in (0, 1):
            out[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
    return out


def shifted(obs: np.ndarray, first: np.ndarray, by: int, none: int) -> np.ndarray:
    """The observation of the neighbour ``by`` (1 or -1) positions ahead within the chain, else ``none``."""
    out = np.full(len(obs), none, dtype=obs.dtype)
    if by > 0:
        out[:-1] = np.where(first[1:], none, obs[1:])
    else:
        out[1:] = np.where(first[1:], none, obs[:-1])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression, by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + (ridge + 1e-9) * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w + np.clip(d, -4, 4)
        if np.abs(d).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
