"""repost_corpus: what it moves between tasks, and its rows against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.articles import repost_corpus


@pytest.fixture
def planned(spark):
    """Plans as they are made: one exchange for each shuffle."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _moved(node) -> int:
    """Bytes of the rows that the exchanges of an executed plan have shuffled; what comes before a checkpoint has no text."""
    below = sum(_moved(node.children().apply(i)) for i in range(node.children().size()))
    return below + (node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0)


def _corpus(spark, asked, links, pages):
    return repost_corpus(spark.createDataFrame(asked, "message_id string, title string, text string"),
                         spark.createDataFrame(links, "message_id string, link_pos long, link string"),
                         spark.createDataFrame(pages, "link string, scraped string"))


def _walk(asked, links, pages):
    text, out = {}, []
    for u, t in pages:
        text[u] = max((x for x in (text.get(u), t) if x is not None), default=None)
    for m, title, body in asked:
        at = {}
        for k, p, u in links:
            if m is not None and k == m and u in text and u is not None:
                at[u] = min((x for x in (at.get(u), p) if x is not None), default=None)
        found = sorted((p is not None, p or 0, text[u] or "", text[u] is not None) for u, p in at.items())
        out.append((m, f"{title or ''}\n\n{body or ''}\n\n" + "\n\n".join(t for _, _, t, known in found if known)))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r["message_id"], r["corpus"]) for r in df.collect()), key=str)


def test_text_moves_once_for_messages_with_equal_links(spark, planned):
    rng = random.Random(1)
    pages = [(f"u{i}", f"{i} " + "".join(rng.choices("abcdefgh", k=20000))) for i in range(3)]
    links = [(f"m{m}", p, f"u{p}" if p < 3 else f"gone{m}") for m in range(300) for p in range(4)]
    asked = [(f"m{m}", "t", "b") for m in range(0, 300, 5)]
    out = _corpus(spark, asked, links, pages)
    assert _rows(out) == _walk(asked, links, pages)
    # 18.4 MB before, a text for each link of each message; now each of the 8 tasks that share the list's messages gets it
    assert _moved(out._jdf.queryExecution().executedPlan()) < 2_000_000


def test_text_of_other_messages_is_not_moved(spark, planned):
    rng = random.Random(2)
    pages = [(f"u{i}", f"{i} " + "".join(rng.choices("abcdefgh", k=5000))) for i in range(100)]
    links = [(f"m{m}", p, f"u{(m * 7 + p * 31) % 100}") for m in range(1000) for p in range(3)]
    asked = [(f"m{m}", "t", "b") for m in range(10)]
    out = _corpus(spark, asked, links, pages)
    assert _rows(out) == _walk(asked, links, pages)
    # the 100 pages, and 30 texts; 3,000 texts (16.3 MB in all) before
    assert _moved(out._jdf.queryExecution().executedPlan()) < 1_500_000


def test_rows_equal_a_walk(spark):
    """A list that most messages have, a url in most lists, messages without links or pages, ids twice or null, links twice
    or null, equal and null positions, urls fetched twice, pages without text."""
    rng = random.Random(3)
    pages = [(f"u{i}", rng.choice(["", None, f"text {i}"])) for i in range(30)] + [("u1", "later"), ("u2", None), (None, "x")]
    pages += [("hot", "hot text"), ("a", "same"), ("b", "same")]
    asked = [(f"m{i}", rng.choice(["t", None]), rng.choice([f"body {i}", None])) for i in range(400)]
    asked += [("m0", "t", "again"), ("m0", "t", "again"), (None, "t", "no id"), (None, None, None)]
    links = []
    for i in range(500):
        if i % 4:
            links += [(f"m{i}", 0, "hot"), (f"m{i}", 1, "a"), (f"m{i}", 1, "b"), (f"m{i}", 2, "gone")]
        elif i % 8:
            links += [(f"m{i}", rng.choice([0, 1, 2, 2, None]), rng.choice([f"u{rng.randrange(35)}", "hot", None])) for _ in range(rng.randrange(9))]
    links += [(None, 0, "hot"), ("m0", 3, "u3"), ("m0", 1, "u3"), ("m0", None, "u4")]
    assert _rows(_corpus(spark, asked, links, pages)) == _walk(asked, links, pages)


def test_messages_with_one_list_or_none_are_spread(spark, planned):
    asked = [(f"m{i}", "t", "b") for i in range(4000)]
    links = [(f"m{i}", 0, "u") for i in range(2000)]
    out = _corpus(spark, asked, links, [("u", "text")])
    where = out.withColumn("task", F.spark_partition_id()).groupBy("task", "corpus").count().collect()
    assert sum(r["count"] for r in where) == 4000
    for corpus in ("t\n\nb\n\ntext", "t\n\nb\n\n"):
        tasks = [r["count"] for r in where if r["corpus"] == corpus]
        assert sum(tasks) == 2000 and len(tasks) >= 3 and max(tasks) < 1200


def test_no_links_no_messages(spark):
    assert _rows(_corpus(spark, [("m", "t", None)], [], [])) == [("m", "t\n\n\n\n")]
    assert _rows(_corpus(spark, [], [("m", 0, "u")], [("u", "x")])) == []
