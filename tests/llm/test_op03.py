"""Containment search against exact containment of every item in every document."""

import random
import re

import pytest

from quire.llm.op03_containment import contaminated, drop_contaminated, hash_count

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def shingles(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(docs, items):
    ds = [(i, shingles(t)) for i, t in docs]
    out = []
    for q, t in items:
        s = shingles(t)
        out += [(i, q, len(s), len(s & d)) for i, d in ds if s and 100 * len(s & d) >= 80 * len(s)]
    return sorted(out, key=str)


def made(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    rows = contaminated(d, q, **kw).collect()
    assert all(abs(r.containment - r.n_shared / r.n_item) < 1e-12 for r in rows)
    gone = {r.doc_id for r in rows}
    left = drop_contaminated(d, q, **kw)
    assert left.schema == d.schema
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(
        i for i, _ in docs if i is not None and i not in gone)
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)] + ["été", "Straße"]
    items = [(q, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 9, 20, 40, 90])))) for q in range(60)]
    docs = []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 400, 6000]))]
        if r.random() < .6:
            it = r.choice(items)[1].split()
            if r.random() < .4:
                it[r.randrange(len(it))] = "changed"
            a = r.randint(0, len(w))
            w[a:a] = [x.upper() if r.random() < .3 else x + r.choice(["", ",", ".\n"]) for x in it]
        docs.append((i, " ".join(w)))
    docs.append((900, items[0][1]))
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 2_000_000), (2, 300)])
def test_recall_against_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    want, got = brute(docs, items), made(spark, docs, items, block=block)
    assert set(got) <= set(want)                     # verified exactly: nothing false
    assert len(got) >= 0.99 * len(want)


def test_edge_cases(spark):
    items = [(1, "a b c d e f"), (2, None), (3, ""), (4, "?!"), (None, "one two three four five"), (5, "hi there")]
    docs = [(1, None), (2, ""), (3, "A, B; c d\ne f"), (None, "x one two three four five y"), (4, "hi  there!"),
            (5, "well hi there you all"), (3, "A, B; c d\ne f")]
    assert made(spark, docs, items) == brute(docs, items)
    assert made(spark, [], items) == []
    assert made(spark, docs, []) == []


def test_hash_count_grows_with_the_guarantee():
    assert hash_count(1e-2) < hash_count(1e-4) <= 44


def test_small_table(spark):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(k, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    want = brute(docs, items)
    assert want and made(spark, docs, items) == want
