"""Importance resampling against a plain-Python version of its definition."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.op12_importance_resampling import RUN, bucket_array, collapsed, resample

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def buckets(text):
    return [zlib.crc32(g.encode()) % 10000 for g in grams(text)[1]]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for _, x in docs:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        rows.append([i, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(grams(x)[0])])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[:5 * len(able) // 100]
    ranks = [next((k + 1 for k, d in enumerate(drawn) if d is r), None) for r in rows]
    return sorted(((*r[:4], k) for r, k in zip(rows, ranks)), key=str)


def made(spark, docs, target, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("n_words", "buckets", "weight", "rank", "score", "_chunk")})
    out = resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "A-b, C", "a b c", "x " * 5, "Ünïcode ÉÀ漢字 über-all", "a\x00b c d",
                                  "w " * RUN, "w " * (RUN + 1), "w " * (RUN + 2) + "x", "\U0001F600 smile"])
def test_spans_are_all_runs_of_up_to_three_words(text):
    n, b = bucket_array(collapsed(text))
    assert n == len(grams(text)[0])
    assert sorted(b.tolist()) == sorted(buckets(text))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "漢字", "it's"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, " ".join(vocab[:40])), (203, docs[5][1]), (204, "long " * 30_000), (5, docs[5][1])]
    target = [" ".join(rng.choice(vocab[:40], 25)) for _ in range(10)] + [None, ""]
    assert made(spark, docs, target, extra=True) == brute(docs, target)


def test_empty_tables(spark):
    assert made(spark, [], ["a b"]) == []
    docs = [(i, "one two three " * 10) for i in range(40)]
    assert made(spark, docs, []) == brute(docs, [])


def test_given_tables_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [r.text for r in bench.select("text").collect()])
    assert sorted((tuple(r) for r in resample(docs, bench).collect()), key=str) == want
