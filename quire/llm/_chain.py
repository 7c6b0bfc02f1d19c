"""Linear-chain conditional random fields over long token streams, in numpy.

A stream is the tokens of many texts, one after another. At the first token of a text the
transition matrix is replaced by the start scores, so one stream needs no padding. All passes
cut the stream into chunks that advance in step: first the transfer matrix of each
chunk, then the few chunk ends in order, then the inside of all chunks at once. The
results are those of the plain recursions over each whole text.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64


def _chunks(emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    n, k = emit.shape
    c = max(1, -(-n // CHUNK))
    e = np.zeros((c * CHUNK, k))
    e[:n] = emit
    f = np.ones(c * CHUNK, bool)                                 # padding restarts; nothing follows it
    f[:n] = first
    f[0] = True
    return e.reshape(c, CHUNK, k), f.reshape(c, CHUNK), n


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, full: bool = False):
    """Posterior of every token's state by forward-backward; with ``full`` also the sum of
    pair posteriors (k, k) within texts and the log likelihood's normaliser."""
    if not len(emit):
        return (emit, np.zeros_like(trans), 0.0) if full else emit
    e, f, n = _chunks(emit, first)
    c, _, k = e.shape
    top = e.max(2, keepdims=True)
    p = np.exp(e - top)
    shift = max(trans.max(), start.max())
    a, s = np.exp(trans - shift), np.exp(start - shift)
    m = np.tile(np.eye(k), (c, 1, 1))
    for t in range(CHUNK):
        begun = m[f[:, t]].sum(2, keepdims=True)
        m = (m.reshape(-1, k) @ a).reshape(c, k, k)
        m[f[:, t]] = begun * s
        m *= p[:, t, None, :]
        m /= m.max((1, 2), keepdims=True)
    into, out = np.empty((c, k)), np.empty((c, k))
    v = np.ones(k)
    for i in range(c):
        into[i] = v
        v = v @ m[i]
        v = v / v.sum()
    v = np.ones(k)
    for i in range(c - 1, -1, -1):
        out[i] = v
        v = m[i] @ v
        v = v / v.sum()
    alpha, scale = np.empty_like(e), np.empty((c, CHUNK))
    x = into
    for t in range(CHUNK):
        x = x @ a
        x[f[:, t]] = s
        x = x * p[:, t]
        scale[:, t] = z = x.sum(1)
        x = x / z[:, None]
        alpha[:, t] = x
    beta = np.empty_like(e)
    y = out
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = y
        w = p[:, t] * y
        y = w @ a.T
        y[f[:, t]] = 1.0
        y = y / y.max(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    post = post.reshape(-1, k)[:n]
    if not full:
        return post
    al, w = alpha.reshape(-1, k)[: n - 1], (p * beta).reshape(-1, k)[1:n]
    inner = ~f.reshape(-1)[1:n]
    al, w = al[inner], w[inner]
    z = ((al @ a) * w).sum(1, keepdims=True)
    pairs = a * (al.T @ (w / z))
    # a restart forgets what came before: its scale is taken against a normalised vector
    norm = np.log(scale.reshape(-1)[:n]).sum() + top.reshape(-1)[:n].sum() + shift * n
    return post, pairs, norm


def viterbi(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best state sequence of every text."""
    if not len(emit):
        return np.zeros(0, np.int8)
    e, f, n = _chunks(emit, first)
    c, _, k = e.shape
    # states lead, so that every step works on whole rows of chunks
    e = np.ascontiguousarray(e.transpose(1, 2, 0))
    f = np.ascontiguousarray(f.T)
    d = np.full((k, k, c), -1e30)
    d[np.arange(k), np.arange(k)] = 0
    for t in range(CHUNK):
        step = [[np.where(f[t], start[j], trans[i, j]) for j in range(k)] for i in range(k)]
        new = np.empty_like(d)
        for j in range(k):
            best = d[:, 0] + step[0][j]
            for i in range(1, k):
                np.maximum(best, d[:, i] + step[i][j], out=best)
            new[:, j] = best + e[t, j]
        d = new
    d = d.transpose(2, 0, 1)
    into = np.empty((c, k))
    v = np.zeros(k)
    for i in range(c):
        into[i] = v
        v = (v[:, None] + d[i]).max(0)
        v = v - v.max()
    back = np.empty((CHUNK, k, c), np.int8)
    x = into.T.copy()
    for t in range(CHUNK):
        new = np.empty_like(x)
        for j in range(k):
            best = x[0] + np.where(f[t], start[j], trans[0, j])
            came = np.zeros(c, np.int8)
            for i in range(1, k):
                s = x[i] + np.where(f[t], start[j], trans[i, j])
                came[s > best] = i
                np.maximum(best, s, out=best)
            back[t, j] = came
            new[j] = best + e[t, j]
        x = new
    # where each end state of a chunk came from, then the chunk ends in order
    came = np.tile(np.arange(k, dtype=np.int8)[:, None], (1, c))
    at = np.arange(c)
    for t in range(CHUNK - 1, -1, -1):
        came = back[t][came, at]
    end = np.empty(c, np.int64)
    state = int(x[:, -1].argmax())
    for i in range(c - 1, -1, -1):
        end[i] = state
        state = int(came[state, i])
    out = np.empty((c, CHUNK), np.int8)
    here = end
    for t in range(CHUNK - 1, -1, -1):
        out[:, t] = here
        here = back[t][here, at].astype(np.int64)
    return out.reshape(-1)[:n]


class Group:
    """Features of one kind: entry -> feature ids (flat with offsets), token -> entry (-1: none)."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, at: np.ndarray):
        self.flat, self.starts, self.at = flat, starts, at

    def scores(self, w: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((1, w.shape[1]))
        return np.vstack((np.add.reduceat(w[self.flat], self.starts, axis=0), np.zeros((1, w.shape[1]))))

    def add_to(self, grad: np.ndarray, g: np.ndarray) -> None:
        n = len(self.starts)
        if not n:
            return
        length = np.diff(np.append(self.starts, len(self.flat)))
        for j in range(g.shape[1]):
            per = np.bincount(np.where(self.at < 0, n, self.at), g[:, j], n + 1)[:n]
            grad[:, j] += np.bincount(self.flat, np.repeat(per, length), grad.shape[0])


class Crf:
    """Hashed feature weights (features, states), transitions and start scores."""

    def __init__(self, features: int, states: int):
        self.w = np.zeros((features, states), np.float32)
        self.trans = np.zeros((states, states))
        self.start = np.zeros(states)

    def emissions(self, groups: list[Group], n: int) -> np.ndarray:
        out = np.zeros((n, self.w.shape[1]))
        for g in groups:
            out += g.scores(self.w)[g.at]
        return out

    def fit(self, groups: list[Group], first: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3,
            decay: float = 1e-6) -> "Crf":
        """Maximum likelihood with L2 decay, full batch with adaptive steps (one step size per weight)."""
        n, k = len(y), self.w.shape[1]
        gold = np.zeros((n, k))
        gold[np.arange(n), y] = 1
        inner = ~first[1:]
        pair = np.zeros((k, k))
        np.add.at(pair, (y[:-1][inner], y[1:][inner]), 1)
        begin = np.bincount(y[first], minlength=k).astype(float)
        # only the features that occur are trained; the others stay at zero either way
        used = np.unique(np.concatenate([g.flat for g in groups])) if groups else np.zeros(0, np.int64)
        small = Crf(len(used), k)
        small.w[:], small.trans, small.start = self.w[used], self.trans, self.start
        groups = [Group(np.searchsorted(used, g.flat), g.starts, g.at) for g in groups]
        params = [small.w, small.trans, small.start]
        m1, m2 = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
        for r in range(1, rounds + 1):
            post, pairs, _ = marginals(small.emissions(groups, n), first, small.trans, small.start, True)
            gw = np.zeros(small.w.shape)
            for g in groups:
                g.add_to(gw, gold - post)
            grads = [gw / n - decay * small.w, (pair - pairs) / n, (begin - post[first].sum(0)) / n]
            for p, a, b, g in zip(params, m1, m2, grads):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += (rate * (a / (1 - 0.9 ** r)) / (np.sqrt(b / (1 - 0.99 ** r)) + 1e-8)).astype(p.dtype)
        self.w[used], self.trans, self.start = small.w, small.trans, small.start
        return self
