"""Forward and backward recursions over many sequences of unequal length at once.

Tokens are laid out by time: first the first token of every sequence, then the second of those
that have one, and so on, longest sequences first. A step of a recursion is then one matrix
product over all sequences that are still running.
"""

from __future__ import annotations

import numpy as np


class TimeMajor:
    """The layout for sequences of the given lengths, all at least 1."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.lengths = lengths
        order = np.argsort(-lengths, kind="stable")
        ordered = lengths[order]
        self.order = order
        self.steps = int(ordered[0]) if len(ordered) else 0
        self.active = len(lengths) - np.searchsorted(ordered[::-1], np.arange(self.steps), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        total = int(lengths.sum())
        step = np.arange(total) - np.repeat(self.starts, lengths)
        #: For each token in the order of the sequences, its place in the layout.
        self.place = self.offset[step] + np.repeat(rank, lengths) if total else np.zeros(0, np.int64)

    def lay(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.place] = flat
        return out

    def sums(self, laid: np.ndarray) -> np.ndarray:
        """Sums for each sequence of values in the layout."""
        if not len(self.lengths):
            return np.zeros((0, *laid.shape[1:]), laid.dtype)
        return np.add.reduceat(laid[self.place], self.starts, axis=0)


def forward(first: np.ndarray, trans: np.ndarray, emit: np.ndarray, tm: TimeMajor) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward messages in place of ``emit``, and the scales, whose product for a sequence is its likelihood.

    first: the distribution of first states, or a row of it for each sequence.
    """
    scale = np.empty(len(emit), emit.dtype)
    ones = np.ones(emit.shape[1], emit.dtype)
    before = None
    offset = tm.offset.tolist()
    for t in range(tm.steps):
        lo, hi = offset[t], offset[t + 1]
        now = emit[lo:hi]
        if before is None:
            now *= first if first.ndim == 1 else first[tm.order]
        else:
            now *= before[: hi - lo] @ trans
        s = now @ ones
        scale[lo:hi] = s
        now /= s[:, None]
        before = now
    return emit, scale


def forward_backward(first: np.ndarray, trans: np.ndarray, emit: np.ndarray, tm: TimeMajor, after_end: np.ndarray | None = None, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each state at each token, expected counts of transitions, and the scales.

    after_end: for each sequence the backward message at its last token, if it isn't all ones.
    goes_on: for each sequence whether the next one is its continuation, the transition to which counts too.
    """
    alpha, scale = forward(first, trans, emit.copy(), tm)
    pairs = np.zeros((emit.shape[1], emit.shape[1]), np.float64)
    back = np.ascontiguousarray(trans.T)
    emit = emit / scale[:, None]
    if after_end is not None:
        last = tm.place[tm.starts + tm.lengths - 1]
        ends = alpha[last]
        after_end = (after_end / (ends * after_end).sum(1, keepdims=True)).astype(emit.dtype)
        emit[last] *= after_end
        alpha[last] *= after_end
    offset = tm.offset.tolist()
    for t in range(tm.steps - 2, -1, -1):
        lo, mid, hi = offset[t], offset[t + 1], offset[t + 2]
        after = emit[mid:hi]  # emission times the backward message of the next step
        n = hi - mid
        pairs += alpha[lo : lo + n].T @ after
        beta = after @ back
        emit[lo : lo + n] *= beta
        alpha[lo : lo + n] *= beta
    if goes_on is not None and goes_on.any():
        at = np.flatnonzero(goes_on)
        pairs += ends[at].T @ emit[tm.place[tm.starts[at + 1]]]
    return alpha, pairs * trans, scale


def messages(first: np.ndarray, trans: np.ndarray, emit: np.ndarray, blocks: list[np.ndarray], goes_on: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of sequences, in order, what comes into each from the left (the distribution of its first state before its
    first token is seen) and from the right (the backward message at its last token), exactly as if no sequence were cut.

    goes_on: for each block whether the next is its continuation. A block that is one of several is run from
    each state; that gives its matrix from the state before it to its last state, and the matrices of a
    sequence are multiplied on in both directions.
    """
    k = len(trans)
    into, back = np.tile(first.astype(np.float64), (len(blocks), 1)), np.ones((len(blocks), k))
    comes_on = np.concatenate([[False], goes_on[:-1]])
    parts = np.flatnonzero(goes_on | comes_on)
    matrices = {}
    while len(parts):
        n = max(1, int(np.searchsorted(np.cumsum([k * len(blocks[i]) for i in parts]), at_once)))
        some, parts = parts[:n], parts[n:]
        runs = [blocks[i] for i in some for _ in range(k)]
        tm = TimeMajor(np.array([len(r) for r in runs]))
        starts = np.concatenate([trans if comes_on[i] else np.tile(first, (k, 1)) for i in some]).astype(emit.dtype)
        alpha, scale = forward(starts, trans, emit[tm.lay(np.concatenate(runs))], tm)
        size = tm.sums(np.log(scale.astype(np.float64))).reshape(-1, k)
        ends = alpha[tm.place[tm.starts + tm.lengths - 1]].astype(np.float64).reshape(-1, k, k)
        weighed = ends * np.exp(size - size.max(1, keepdims=True))[:, :, None]
        matrices |= dict(zip(some.tolist(), weighed, strict=True))
    for i in np.flatnonzero(comes_on).tolist():
        end = into[i - 1] @ matrices[i - 1] if comes_on[i - 1] else matrices[i - 1][0]
        end = into_state(end)
        into[i] = end  # the distribution of the last state before this block
    for i in np.flatnonzero(goes_on)[::-1].tolist():
        back[i] = into_state(matrices[i + 1] @ back[i + 1])
    into[comes_on] = into[comes_on] @ trans
    return into, back


def into_state(v: np.ndarray) -> np.ndarray:
    return v / v.sum()
