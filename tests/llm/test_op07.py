"""Fixed-block dedup against a brute-force scan of all windows."""

import hashlib
import random
import re

import pytest

from quire.llm.op07_fixed_blocks import remove_repeats, repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is None:
            continue
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out, runs = [], []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - 19):
                if first[tuple(w[p:p + 20])] < (i, p):
                    gone[p:p + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        p = 0
        while p < len(w):
            q = p
            while q < len(w) and gone[q]:
                q += 1
            if q > p:
                runs.append((i, p, q - p))
            p = max(q, p + 1)
    return sorted(out, key=str), sorted(runs, key=str)


def made(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str), df


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed):
    r = random.Random(seed)
    word = lambda: "é" * r.randint(0, 2) + f"w{r.randint(0, 5000)}"
    shared = [[word() for _ in range(r.choice([19, 20, 21, 29, 33, 60, 140]))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(r.randint(1, 5)):
            w += [word() for _ in range(r.randint(0, 40))]
            if r.random() < .7:
                s = r.choice(shared)
                a = r.randint(0, 3)
                w += s[a:]
        if r.random() < .1:
            w += ["same"] * 50
        rows.append((r.randint(0, 10**6), "\n ".join(w) if r.random() < .5 else " ".join(w)))
    want, runs = brute(rows)
    got, df = made(spark, rows)
    assert got == want
    assert sorted((tuple(x) for x in repeated_spans(df).collect()), key=str) == runs


def test_edge_cases(spark):
    w = " ".join(f"x{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (None, w), (None, w), (9, w), (4, w), (4, w), (5, "a " + w + " b"),
            (6, "loop " * 70), (7, "z" * 300000), (8, w + " tail"), (10, w)]
    assert made(spark, rows)[0] == brute(rows)[0]


def test_empty_table(spark):
    assert made(spark, [])[0] == []


def test_whole_small_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    assert made(spark, rows)[0] == brute(rows)[0]
