"""near_copies: what it stores and moves, and that its sketches and blocks lose no link."""

import random

from pyspark.sql import functions as F

from quire.operators.scoring import near_copies


def _brute(rows):
    sets = {}
    for i, (key, t) in enumerate(rows):
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    name, changed = {k: k for k, _ in rows}, True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                x, y = rows[i][0], rows[j][0]
                if name[y] < name[x] and 100 * len(a & b) >= 80 * len(a | b) > 0:
                    name[x], changed = name[y], True
    return name


def _got(spark, rows):
    return {r["doc_id"]: r["cluster"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_most_hashes_are_neither_stored_nor_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(100000)}" for _ in range(400)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(texts[i][:390])) for i in range(3)]
    kind, stored = type(spark.range(0)), []
    plain = kind.checkpoint

    def counted(self, *args, **kw):
        out = plain(self, *args, **kw)
        stored.append(sum(out.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] for c, t in out.dtypes if t == "array<bigint>"))
        return out
    monkeypatch.setattr(kind, "checkpoint", counted)
    assert _got(spark, rows) == {**{i: i for i in range(60)}, **{100 + i: i for i in range(3)}}
    assert sum(stored) < 63 * 396 * 0.45                         # twice all hashes before


def test_sketches_lose_no_link(spark):
    """Sizes of 1 to 1,200 shingles, each with variants on both sides of the limit; a word added to short texts."""
    rng = random.Random(6)
    rows = []
    for size in [*range(4, 13), 29, 30, 31, 60, 124, 125, 300, 1200]:
        base = [f"s{size}w{i}" for i in range(size)]
        rows.append(base)
        rows.append(base + ["end"])
        rows.append(["start"] + base)
        for share in (.70, .79, .80, .81, .9):                   # a piece of the text, and words changed at its end
            rows.append(base[:int(size * share) + 1])
            rows.append(base[:int(size * (1 + share) / 2) + 1] + [f"x{rng.random()}" for _ in range(int(size * (1 - share) / 2))])
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    assert _got(spark, rows) == _brute(rows)


def test_a_family_of_texts_that_hardly_link(spark):
    """120 variants of one text, most pairs at 0.6 to 0.8: buckets of many components meet in blocks."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rng.sample(range(200), rng.randrange(2, 6)):
            t[k] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    want = _brute(rows)
    assert 10 < len(set(want.values())) < 110
    assert _got(spark, rows) == want


def test_rows_that_share_a_key(spark):
    """A key with several texts links whatever one of its texts links to; rows that come twice change nothing."""
    rng = random.Random(8)
    t = [[f"k{j}w{i}" for i in range(50)] for j in range(4)]
    rows = [(1, t[0]), (1, t[1]), (2, t[1] + ["z"]), (3, t[2]), (3, t[2]), (4, t[2] + ["z"]), (5, t[3]), (6, t[0] + ["y"])]
    rows = [(k, " ".join(w)) for k, w in rows]
    rng.shuffle(rows)
    assert _got(spark, rows) == _brute(rows)
