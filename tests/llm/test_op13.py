"""Hard negatives against brute force over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import quire.llm.op13_multi_index_negatives as op
from quire.llm.op13_multi_index_negatives import Index, hard_negatives, visits


def brute(rows):
    able = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        p = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e])
        able[i] = min(able.get(i, p), p)
    out = []
    for a, (la, qa) in able.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(qa, q)) for i, (_, q) in able.items()}
        order = sorted((i for i in able if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if able[i][0] == la][:5]:
            hard = [i for i in order if able[i][0] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard)]
    return sorted(out)


def made(spark, rows, extra=False):
    df = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], y) for i, e, y in rows],
                               "vec_id long, embedding array<float>, label int")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("cell", "bucket", "q", "block", "score", "rank")})
    return sorted(tuple(r) for r in hard_negatives(df).collect())


def test_many_buckets_and_rounds(spark, monkeypatch):
    """Clustered vectors, a third of all rows equal, small buckets and a small first round."""
    monkeypatch.setattr(op, "BUCKET", 64)
    monkeypatch.setattr(op, "FIRST", 40)
    monkeypatch.setattr(op, "CELL", 8)
    monkeypatch.setattr(op.search, "__defaults__", (40,))
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(12, 6))
    rows = []
    for k in range(900):
        v = heads[0] if k % 3 == 0 else heads[rng.integers(12)] + rng.normal(size=6) * 0.1
        rows.append((k, np.float32(v / np.linalg.norm(v)).tolist(), int(rng.integers(3))))
    assert made(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.float32(rng.normal(size=4)).tolist(), i % 4) for i in range(120)]
    rows += [(200, [1.0, 1.0, 1.0], 1), (201, [], 1), (202, None, 1), (203, [1.0, None], 1), (204, [1.0, float("nan")], 1),
             (205, [float("inf")], 1), (206, [1.0] * 4, None), (None, [1.0] * 4, 2), (100, [0.5] * 4, 0), (100, [0.5] * 4, 0),
             (300, [-3.0] * 4, 3), (400, [0.0] * 4, 2)]
    assert made(spark, rows, extra=True) == brute(rows)


def test_empty_and_single(spark):
    assert made(spark, []) == []
    assert made(spark, [(100, [1.0], 1)]) == []
    assert made(spark, [(i, [], 1) for i in (100, 101)] + [(102, [], 2)]) == [(100, 101, 1, 102, 0, 0)]


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in hard_negatives(df).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_visits_fall_in_bound_and_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-200, 200, (400, 6)).astype(float)
    centres = (op.codebook(x[:, :3], 5), op.codebook(x[:, 3:], 5))
    codes = [op._nearest(h, c) for h, c in zip((x[:, :3], x[:, 3:]), centres)]
    radii = tuple(np.array([np.sqrt(((h[c == k] - m[k]) ** 2).sum(1)).max(initial=0) for k in range(5)])
                  for h, c, m in zip((x[:, :3], x[:, 3:]), codes, centres))
    cell = codes[0] * 5 + codes[1]
    ix = Index(6, centres, radii, np.bincount(cell, minlength=25), np.zeros(25, int), np.ones(25, int))
    for q in x[:20]:
        seen, got, last = 0, [], np.inf
        while True:
            cells, seen, bound = visits(q, ix, seen, 50, -np.inf)
            got += cells
            assert bound <= last
            last = bound
            rest = ~np.isin(cell, got)
            assert not rest.any() or (x[rest] @ q).max() <= bound
            if bound == -np.inf:
                break
        assert sorted(got) == sorted(np.unique(cell))
