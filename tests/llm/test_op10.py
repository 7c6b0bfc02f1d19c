"""Prefix-tree join against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm.op10_prefix_tree_join import classes_and_components, tree_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = {}
    for x, (i, s) in enumerate(sets):
        if i is None or not s:
            continue
        for y in {y for g in s for y in by.get(g, ())}:
            both = len(s & sets[y][1])
            if 100 * both >= 85 * len(s | sets[y][1]):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        for g in s:
            by.setdefault(g, []).append(x)
    small = {}
    for x, (i, s) in enumerate(sets):
        r = find(x)
        if i is not None:
            small[r] = min(small.get(r, i), i)
    return sorted(((i, len(s), None if i is None else small[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes_and_components(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_copies_match_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(12)]
    rows = []
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 7, 8, 12, 30, 60, 200]))]
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < .3:
                t += passage
            rows.append(" ".join(t).title() if r.random() < .2 else "  ".join(t))
    r.shuffle(rows)
    rows = [(i * 7, t) for i, t in enumerate(rows)]
    assert made(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e"), (5, "a b c"), (4, "A B\tC"), (4, "a b c"),
            (7, "x" * 5000), (8, "x" * 5000), (9, "a b c"), (2**62, "a b c d e f g h"), (2**62 + 1, "a b c d e f g h"),
            (6, "q r s t u v w"), (6, "other words here for it")]
    assert made(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert classes_and_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 5, "z"), (2, "a b c d", 6, "z")], "doc_id long, text string, n long, h string")
    assert {tuple(r) for r in classes_and_components(df).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_whole_small_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    assert made(spark, rows) == brute(rows)


def test_tree_walk_equals_set_arithmetic():
    import numpy as np
    r = random.Random(3)
    for _ in range(40):
        base = set(r.sample(range(200), r.randint(5, 80)))

        def variant():
            m = set(base)
            for x in r.sample(sorted(m), min(len(m) - 1, r.choice([0, 1, 3, 20]))):
                m.discard(x)
            return m | set(r.sample(range(200, 400), r.choice([0, 1, 4, 30])))
        probes, members = [variant() for _ in range(r.choice([1, 7]))], [variant() for _ in range(30)]
        want = [(p, i) for p, x in enumerate(probes) for i, m in enumerate(members) if 100 * len(m & x) >= 85 * len(m | x)]
        got = tree_links([np.array(sorted(x)) for x in probes], [np.array(sorted(m)) for m in members], 85)
        assert sorted(zip(*(x.tolist() for x in got))) == want


def test_large_buckets_in_blocks(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(r.choice([0, 1, 3, 4, 6, 9])):
            t[r.randrange(len(t))] = f"n{r.randint(0, 40)}"
        rows.append((1000 - i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in classes_and_components(df, block=7, few=3).collect()), key=str)
    assert got == brute(rows)
