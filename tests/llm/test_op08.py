"""Subword toxicity: held-out quality, unseen endings, edge cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from quire.llm import _text as T
from quire.llm._subwords import word_features
from quire.llm.op08_subword_toxicity import GRAMS, fit, toxicity


def corpus(seed, n, endings):
    r = random.Random(seed)
    syl = ["ba", "do", "ke", "mi", "nu", "ra", "so", "ti"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    texts, y = [], []
    for _ in range(n):
        w = [word() for _ in range(r.choice([10, 60, 300]))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(r.randrange(len(w)), r.choice(["vilequ", "grumpf"]) + r.choice(endings))
        texts.append(" ".join(w))
        y.append(int(bad))
    return texts, np.array(y)


def test_unseen_endings_are_found():
    texts, y = corpus(1, 600, ["a", "en", "ito", "ous"])
    model = fit(texts, y)
    texts, y = corpus(2, 300, ["ier", "xx", "ando", "0"])
    score = model.scores(*T.raw(pa.array(texts, pa.large_string())))
    assert ((score >= 0.5) == y).mean() > 0.93


def test_score_is_the_softmax_of_the_plain_average():
    texts, y = corpus(4, 200, ["a", "en"])
    model = fit(texts, y, epochs=3)
    buf, offs = T.raw(pa.array([t.lower() for t in texts[:40]] + ["", "?!"], pa.large_string()))
    got = model.scores(buf, offs)
    for i, t in enumerate(texts[:40]):
        odds = []
        for w in re.findall("[a-z0-9]+", t.lower()):
            b = np.frombuffer(w.encode(), np.uint8)
            ids, _ = word_features(b, np.array([0]), np.array([len(b)]), GRAMS, 0)
            odds.append(np.mean([float(model.odds[k]) for k in ids]))
        assert np.isclose(got[i], 1 / (1 + np.exp(-(np.mean(odds) + model.bias))), rtol=1e-6)
    assert np.allclose(got[40:], 1 / (1 + np.exp(-model.bias)))


def test_length_does_not_change_a_verdict():
    texts, y = corpus(5, 500, ["a", "en", "ous"])
    model = fit(texts, y)
    clean = [t for t, v in zip(*corpus(6, 300, ["a"])) if not v]
    r = random.Random(7)
    joined = []
    while len(joined) < 100:
        words = []
        while len(words) < 50_000 // (10 if len(joined) % 10 else 1):
            words += r.choice(clean).split()
        joined.append(" ".join(words))
    score = lambda xs: model.scores(*T.raw(pa.array(xs, pa.large_string())))
    assert (score(joined) < 0.5).mean() >= 0.99
    assert np.allclose(score([" ".join([t] * 30) for t in clean[:20]]), score(clean[:20]))


def test_query_shape_and_edge_cases(spark):
    texts, y = corpus(3, 200, ["a", "en"])
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "?!"), (None, "x"), (5, texts[5]),
                                                    (903, "so " * 100000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(v), 1) for i, v in enumerate(y)] + [(0, int(y[0]), 1), (None, 1, 1), (1, None, 1)],
                                   "doc_id long, toxic int, quality int")
    got = toxicity(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id < 200]
    assert np.mean([a == b for a, b in held]) > 0.8


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score < 1e-200, r.predicted) for r in toxicity(docs, none).collect()] == [(True, 0)]
    assert toxicity(docs.limit(0), none).count() == 0
