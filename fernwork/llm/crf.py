"""Linear-chain conditional random field over items with hashed indicator features."""

from __future__ import annotations

import numpy as np


class Chain:
    """Emission weights (features, labels), transitions (labels, labels) and start weights."""

    def __init__(self, features: int, labels: int):
        self.emission = np.zeros((features, labels))
        self.step = np.zeros((labels, labels))
        self.start = np.zeros(labels)

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Emission scores of items given as rows of feature numbers (0 is the empty feature)."""
        return self.emission[feats].sum(axis=-2)

    def marginals(self, score: np.ndarray, lengths: np.ndarray, block: int = 64) -> np.ndarray:
        """Label probabilities of every item of sequences laid end to end, by forward-backward.

        Sequences are cut into blocks. All blocks multiply up their transfer
        matrices side by side; a pass over each sequence's blocks gives the
        messages at their borders, and all blocks finish side by side. The
        result is exact, and the number of steps is that of a block plus the
        blocks of the longest sequence.
        """
        n, k = score.shape
        if not n:
            return np.zeros((0, k))
        e = np.exp(score - score.max(axis=1, keepdims=True))
        step = np.exp(self.step - self.step.max())
        pieces = -(-lengths // block)
        seq_at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
        of = np.repeat(np.arange(len(lengths)), pieces)
        order = np.arange(len(of)) - first[of]
        begin = seq_at[of] + order * block
        size = np.minimum(block, lengths[of] - order * block)
        places = begin[:, None] + np.arange(block)
        inside = np.arange(block) < size[:, None]
        em = np.where(inside[:, :, None], e[np.minimum(places, n - 1)], 0.0)
        # transfer matrix of each block; no transition leads to the first item of a sequence
        lead = order == 0
        m = np.tile(np.eye(k), (len(of), 1, 1))
        for t in range(int(size.max())):
            on = inside[:, t]
            moved = m[on] @ step
            if t == 0:
                moved[lead[on]] = np.eye(k)
            m[on] = moved * em[on, t][:, None, :]
            m[on] /= m[on].max(axis=(1, 2), keepdims=True)
        # messages into and out of each block
        start = np.exp(self.start - self.start.max())
        alpha = np.empty((len(of), k))
        beta = np.empty((len(of), k))
        alpha[first] = start
        for j in range(1, int(pieces.max())):
            at = first[pieces > j] + j
            a = np.einsum("bi,bij->bj", alpha[at - 1], m[at - 1])
            alpha[at] = a / a.max(axis=1, keepdims=True)
        final = first + pieces - 1
        beta[final] = 1.0
        for j in range(1, int(pieces.max())):
            at = final[pieces > j] - j
            b = np.einsum("bij,bj->bi", m[at + 1], beta[at + 1])
            beta[at] = b / b.max(axis=1, keepdims=True)
        # within the blocks
        fwd = np.empty_like(em)
        a = alpha
        for t in range(int(size.max())):
            moved = a @ step
            if t == 0:
                moved[lead] = a[lead]
            a = moved * em[:, t]
            a = a / np.maximum(a.max(axis=1, keepdims=True), 1e-300)
            fwd[:, t] = a
        out = np.empty((n, k))
        b = beta.copy()
        for t in range(int(size.max()) - 1, -1, -1):
            on = inside[:, t]
            p = fwd[on, t] * b[on]
            out[places[on, t]] = p / p.sum(axis=1, keepdims=True)
            b[on] = (em[on, t] * b[on]) @ step.T
            b[on] /= b[on].max(axis=1, keepdims=True)
        return out

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """The best label sequence of one sequence."""
        n = len(score)
        best = self.start + score[0] if n else None
        back = np.zeros((n, score.shape[1]), np.int64)
        for t in range(1, n):
            through = best[:, None] + self.step
            back[t] = through.argmax(axis=0)
            best = through.max(axis=0) + score[t]
        out = np.zeros(n, np.int64)
        if n:
            out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def fit(self, feats: np.ndarray, item: np.ndarray, label: np.ndarray, rounds: int, rate: float = 0.2, decay: float = 1e-4) -> Chain:
        """Maximum likelihood by Adam. ``feats``: features of distinct items; ``item`` and ``label``: (sequences, length), -1 behind the end."""
        s, length = item.shape
        k = len(self.start)
        used, where = np.unique(feats, return_inverse=True)
        where = where.reshape(feats.shape)
        w = self.emission[used].copy()
        inside = item >= 0
        gold = np.zeros((s, length, k))
        at = np.nonzero(inside)
        gold[at[0], at[1], label[at]] = 1.0
        pairs = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
        params = [w, self.step, self.start]
        mean = [np.zeros_like(p) for p in params]
        var = [np.zeros_like(p) for p in params]
        total = inside.sum()
        empty = used == 0
        for r in range(1, rounds + 1):
            em = params[0][where].sum(axis=1)
            score = np.where(inside[:, :, None], em[np.maximum(item, 0)], 0.0)
            x = np.exp(score - score.max(axis=2, keepdims=True))
            step = np.exp(params[1])
            fwd, bwd = np.empty_like(x), np.ones_like(x)
            a = np.exp(params[2]) * x[:, 0]
            fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
            for t in range(1, length):
                a = (fwd[:, t - 1] @ step) * x[:, t]
                a /= a.sum(axis=1, keepdims=True)
                fwd[:, t] = np.where(inside[:, t, None], a, fwd[:, t - 1])
            for t in range(length - 2, -1, -1):
                b = (x[:, t + 1] * bwd[:, t + 1]) @ step.T
                b /= b.max(axis=1, keepdims=True)
                bwd[:, t] = np.where(inside[:, t + 1, None], b, 1.0)
            p = fwd * bwd
            p = np.where(inside[:, :, None], p / p.sum(axis=2, keepdims=True), 0.0)
            right = np.where(inside[:, 1:, None], x[:, 1:] * bwd[:, 1:], 0.0)
            norm = np.einsum("sti,ij,stj->st", fwd[:, :-1], step, right)
            share = np.where(norm > 0, 1.0 / np.where(norm > 0, norm, 1.0), 0.0)
            both = np.einsum("sti,st,stj->ij", fwd[:, :-1], share, right) * step
            slip = (gold - p)[at]
            by_item = np.stack([np.bincount(item[at], slip[:, j], len(feats)) for j in range(k)], 1)
            g = np.stack([np.bincount(where.ravel(), np.repeat(by_item[:, j], feats.shape[1]), len(used)) for j in range(k)], 1)
            g[empty] = 0.0
            grads = [g / total - decay * params[0], (pairs - both) / total - decay * params[1], (gold[:, 0] - p[:, 0]).sum(axis=0) / s - decay * params[2]]
            for q, grad, m1, m2 in zip(params, grads, mean, var):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                q += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        self.emission[used] = params[0]
        return self
