"""A linear-chain conditional random field over words, computed on many chains at once."""

from __future__ import annotations

import io

import numpy as np

BLOCK = 32
"""Words that are walked one after the other; blocks of all chains are walked side by side."""


def _blocks(lengths: np.ndarray):
    """For chains of these lengths (all > 0): chain, place in the chain, first word and size of each block."""
    per_chain = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), per_chain)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(per_chain) - per_chain, per_chain)
    first = (np.cumsum(lengths) - lengths)[chain] + place * BLOCK
    return chain, place, first, np.minimum(BLOCK, lengths[chain] - place * BLOCK)


def transfer_of(scores: np.ndarray, transitions: np.ndarray, starts: bool) -> np.ndarray:
    """The matrix that carries a chain's state across a stretch of it, up to a factor; ``starts`` where the chain begins there."""
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    parts = weights[:, None, :] * move
    if starts:
        parts[0] = np.diag(weights[0])
    while len(parts) > 1:  # neighbours are multiplied, a level at a time
        even = parts[:-1:2] @ parts[1::2]
        even /= even.max(axis=(1, 2), keepdims=True)
        parts = np.concatenate([even, parts[-1:]]) if len(parts) % 2 else even
    return parts[0] / parts[0].max()


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False, before=None, after=None):
    """Label probabilities of every word by forward-backward; with ``pairs`` also expected transitions and log Z.

    ``scores`` are the label scores of the words of all chains one after the other. Chains of any length are
    exact: each block's transfer matrix carries the chain's state across it, then blocks are walked in parallel.
    A stretch of one chain takes the state ``before`` its first word (None where the chain begins) and the weights
    ``after`` its last (None where it ends).
    """
    n, labels = scores.shape
    top = scores.max(axis=1, keepdims=True)
    weights = np.exp(scores - top)
    move = np.exp(transitions - transitions.max())
    chain, place, first, size = _blocks(lengths)
    padded = np.minimum(first[:, None] + np.arange(BLOCK), n - 1)
    inside = np.arange(BLOCK) < size[:, None]
    x = np.where(inside[:, :, None], weights[padded], 1.0)
    starts = (place == 0) & (before is None)

    transfer = np.broadcast_to(np.eye(labels), (len(first), labels, labels)).copy()
    for t in range(BLOCK):
        moved = (transfer.reshape(-1, labels) @ move).reshape(transfer.shape)
        if t == 0:
            moved[starts] = np.eye(labels)  # a chain starts without a transition
        new = moved * x[:, t, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        transfer = np.where(inside[:, t, None, None], new, transfer)

    begin = np.ones((len(first), labels))
    finish = np.ones((len(first), labels))
    if before is not None:
        begin[0] = before
    if after is not None:
        finish[-1] = after
    by_place = np.argsort(place, kind="stable")
    cuts = np.cumsum(np.bincount(place))
    for at in range(1, len(cuts)):
        now = by_place[cuts[at - 1]:cuts[at]]
        state = (begin[now - 1][:, None, :] @ transfer[now - 1])[:, 0]
        begin[now] = state / state.sum(axis=1, keepdims=True)
    for at in range(len(cuts) - 1, 0, -1):
        now = by_place[cuts[at - 1]:cuts[at]]
        state = (transfer[now] @ finish[now][:, :, None])[:, :, 0]
        finish[now - 1] = state / state.sum(axis=1, keepdims=True)

    forward, log_z = np.empty_like(x), np.zeros(len(first))
    state = begin
    for t in range(BLOCK):
        moved = state @ move
        if t == 0:
            moved[starts] = 1.0
        new = moved * x[:, t]
        total = new.sum(axis=1, keepdims=True)
        log_z += np.where(inside[:, t], np.log(total[:, 0]), 0.0)
        state = np.where(inside[:, t, None], new / total, state)
        forward[:, t] = state
    backward = np.empty_like(x)
    state = finish
    for t in range(BLOCK - 1, -1, -1):
        backward[:, t] = state
        new = (x[:, t] * state) @ move.T
        state = np.where(inside[:, t, None], new / new.sum(axis=1, keepdims=True), state)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    out = both[inside]
    if not pairs:
        return out
    arrived = weights * backward[inside]
    left = forward[inside]
    joined = np.ones(n, bool)
    joined[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(joined)
    edge = left[at - 1][:, :, None] * move[None] * arrived[at][:, None, :]
    edge /= edge.sum(axis=(1, 2), keepdims=True)
    return out, edge.sum(axis=0)


class Adam:
    """Steps of the Adam rule for some arrays, in place."""

    def __init__(self, arrays, rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.mean = [np.zeros_like(a) for a in arrays]
        self.square = [np.zeros_like(a) for a in arrays]

    def __call__(self, gradients):
        self.step += 1
        for a, g, m, s in zip(self.arrays, gradients, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= self.rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.999 ** self.step)) + 1e-8)


def packed(**arrays) -> bytes:
    """Arrays as one file."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()
