"""A linear-chain conditional random field over hashed token features, in numpy.

Sequences are padded into batches; training maximises the log-likelihood with an L2 penalty by
gradient steps with per-weight scaling (forward-backward for the expected counts), decoding is Viterbi over a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """emit: features x labels (row 0 is unused, for padding), trans: labels x labels, start: labels."""

    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    index: dict[str, int]

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Emission scores of tokens given by padded rows of feature numbers."""
        return self.emit[features].sum(axis=-2)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def viterbi(crf: Crf, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels for padded scores (batch x time x labels); -1 beyond a sequence's end. Ties go to the smaller label."""
    n, steps, labels = scores.shape
    back = np.zeros((n, steps, labels), np.int8)
    best = crf.start + scores[:, 0] if steps else np.zeros((n, labels))
    for t in range(1, steps):
        both = best[:, :, None] + crf.trans[None]
        back[:, t] = both.argmax(axis=1)
        best = np.where((t < lengths)[:, None], both.max(axis=1) + scores[:, t], best)
    out = np.full((n, steps), -1, np.int8)
    at, rows = best.argmax(axis=1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        out[live, t] = at[live]
        at = np.where(live, back[rows, t, at], at) if t else at
    return out


def train(sequences: list[list[list[str]]], labels: list[list[int]], n_labels: int, steps: int = 120, l2: float = 2e-3, rate: float = 0.15) -> Crf:
    """Fit on sequences of tokens, each a list of feature names, and their labels."""
    index: dict[str, int] = {}
    width = max(len(token) for s in sequences for token in s)
    n, most = len(sequences), max(map(len, sequences))
    feats, gold = np.zeros((n, most, width), np.int64), np.zeros((n, most), np.int64)
    lengths = np.array([len(s) for s in sequences])
    for i, (s, y) in enumerate(zip(sequences, labels)):
        for t, token in enumerate(s):
            for k, name in enumerate(token):
                feats[i, t, k] = index.setdefault(name, len(index) + 1)
        gold[i, : len(y)] = y
    crf = Crf(np.zeros((len(index) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), index)
    mask = np.arange(most)[None] < lengths[:, None]
    one = np.eye(n_labels)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    gold_trans = np.zeros((n_labels, n_labels))
    np.add.at(gold_trans, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    params = [crf.emit, crf.trans, crf.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat = feats[mask].ravel()
    for step in range(1, steps + 1):
        s = crf.scores(feats)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = crf.start + s[:, 0]
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + crf.trans[None], 1) + s[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            nxt = _logsum(crf.trans[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
        z = _logsum(alpha[:, -1], 1)
        marg = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        two = np.exp(alpha[:, :-1, :, None] + crf.trans[None, None] + (s + beta)[:, 1:, None, :] - z[:, None, None, None])
        delta = (one - marg)[mask] / n
        grad_emit = np.zeros_like(crf.emit)
        rows = np.repeat(np.arange(len(delta)), width)
        for y in range(n_labels):
            grad_emit[:, y] = np.bincount(flat, delta[rows, y], len(crf.emit))
        grad_emit[0] = 0
        grads = [grad_emit - l2 * crf.emit, (gold_trans - (two * pairs[..., None, None]).sum(axis=(0, 1))) / n - l2 * crf.trans, (one[:, 0] - marg[:, 0]).sum(axis=0) / n - l2 * crf.start]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return crf
