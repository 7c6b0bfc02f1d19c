"""Chain passes against enumeration of all state sequences."""

import itertools

import numpy as np

from quire.llm._chain import Crf, Group, marginals, viterbi


def test_passes_equal_enumeration():
    r = np.random.default_rng(0)
    for lengths in ([4, 1, 5], [6], [2, 2, 2, 2]):
        k, n = 3, sum(lengths)
        emit, trans, start = r.normal(size=(n, k)) * 2, r.normal(size=(k, k)), r.normal(size=k)
        first = np.zeros(n, bool)
        first[np.cumsum([0] + lengths[:-1])] = True
        post, pairs, norm = marginals(emit, first, trans, start, True)
        best = viterbi(emit, first, trans, start)
        want_pairs, want_norm, at = np.zeros((k, k)), 0.0, 0
        for m in lengths:
            e = emit[at:at + m]
            seqs = list(itertools.product(range(k), repeat=m))
            score = np.array([start[s[0]] + sum(e[i, s[i]] for i in range(m))
                              + sum(trans[s[i], s[i + 1]] for i in range(m - 1)) for s in seqs])
            p = np.exp(score - score.max())
            want_norm += np.log(p.sum()) + score.max()
            p /= p.sum()
            for i in range(m):
                for j in range(k):
                    assert abs(post[at + i, j] - sum(q for q, s in zip(p, seqs) if s[i] == j)) < 1e-9
            for q, s in zip(p, seqs):
                for i in range(m - 1):
                    want_pairs[s[i], s[i + 1]] += q
            assert tuple(best[at:at + m]) == seqs[int(score.argmax())]
            at += m
        assert np.allclose(pairs, want_pairs)
        assert abs(norm - want_norm) < 1e-8


def test_long_chain_equals_plain_recursion():
    r = np.random.default_rng(1)
    n, k = 1000, 4
    emit, trans, start = r.normal(size=(n, k)), r.normal(size=(k, k)), r.normal(size=k)
    first = r.random(n) < 0.01
    first[0] = True
    f = np.empty((n, k))
    for t in range(n):
        prev = start if first[t] else np.logaddexp.reduce(f[t - 1][:, None] + trans, axis=0)
        f[t] = prev + emit[t]
        f[t] -= f[t].max()
    b = np.zeros((n, k))
    for t in range(n - 2, -1, -1):
        if not first[t + 1]:
            b[t] = np.logaddexp.reduce(trans + emit[t + 1] + b[t + 1], axis=1)
            b[t] -= b[t].max()
    q = np.exp(f + b - (f + b).max(1, keepdims=True))
    assert np.allclose(marginals(emit, first, trans, start), q / q.sum(1, keepdims=True))


def test_training_learns_states_and_transitions():
    r = np.random.default_rng(2)
    y = np.repeat(r.integers(0, 2, 200), 10)
    x = np.where(r.random(2000) < 0.8, y, 1 - y)
    g = [Group(np.arange(2), np.arange(2), x)]
    first = np.zeros(2000, bool)
    first[::100] = True
    model = Crf(2, 2).fit(g, first, y, rounds=60)
    got = viterbi(model.emissions(g, 2000), first, model.trans, model.start)
    # as good as decoding with the process's own probabilities (a run of 10 keeps or changes its state evenly)
    true = np.log(np.where(np.arange(2)[:, None] == x, 0.8, 0.2)).T
    ideal = viterbi(true, first, np.log([[0.95, 0.05], [0.05, 0.95]]), np.log([0.5, 0.5]))
    assert (got == y).mean() >= (ideal == y).mean() - 0.01 > (x == y).mean()
