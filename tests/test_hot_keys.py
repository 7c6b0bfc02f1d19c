"""Hot groups: a url on most links, one mailbox with all send-now mail; results against plain walks, work spread."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import issues as iss
from quire.operators import scoring as S
from quire.operators.articles import attach_pages
from quire.operators.ordering import heavy_keys, running_count


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_url_is_spread_and_nothing_changes(spark, how):
    urls = ["hot"] * 4000 + [f"u{i % 50}" for i in range(2000)] + [None] * 3
    links = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "n int, link string")
    pages = spark.createDataFrame([("hot", "old", 1), ("hot", "new", 2), *[(f"u{i}", f"text {i}", 1) for i in range(25)]],
                                  "link string, scraped string, t int")
    text = {"hot": "new", **{f"u{i}": f"text {i}" for i in range(25)}}
    want = sorted((i, text.get(u, "[Failed to scrape this link]")) for i, u in enumerate(urls) if how == "left" or u in text)
    out = attach_pages(links, pages, how=how, fetched="t")
    assert sorted((r["n"], r["scraped"]) for r in out.collect()) == want
    assert set(out.columns) - {"scraped_ok"} == {"n", "link", "scraped"}
    assert [(r["link"], r["_copies"]) for r in heavy_keys(links, "link").collect()] == [("hot", 6)]      # 2/3 of 8 tasks
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")                      # the tasks as dealt, not coalesced
    try:
        tasks = attach_pages(links, pages, how=how, fetched="t").where("link = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 2400


def test_no_links_no_pages(spark):
    links = spark.createDataFrame([], "n int, link string")
    pages = spark.createDataFrame([], "link string, scraped string")
    assert attach_pages(links, pages).count() == 0
    one = spark.createDataFrame([(1, "a")], "n int, link string")
    assert [r["scraped_ok"] for r in attach_pages(one, pages).collect()] == [False]


def test_running_count_equals_a_walk(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.randrange(3)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int")
    so_far, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        so_far[g] = want[i] = so_far.get(g, 0) + v
    got = running_count(df, by=["g"], order=["i"], of=F.col("v"))
    assert {r["i"]: r["n"] for r in got.collect()} == want and set(got.columns) == {"g", "i", "v", "n"}


def test_send_now_equals_a_walk(spark):
    """Many requests over one hot mailbox, ties in time, a request twice, limits of 0, null and a few."""
    rng = random.Random(4)
    start = dt.datetime(2024, 3, 1)
    boxes = [0] * 8 + [1, 2, 3]
    mail = [(rng.choice(boxes), f"m{i:04d}", start + dt.timedelta(minutes=30 * rng.randrange(1500)),
             rng.choice([["INBOX"], ["INBOX"], ["INBOX", "ANALYZED"], ["SPAM"]])) for i in range(2500)]
    asked = [(rng.choice([*boxes, 4]), start + dt.timedelta(minutes=30 * rng.randrange(1600))) for _ in range(60)]
    asked += asked[:5]
    limits = {0: 12, 1: 3, 2: 0, 3: None}
    m = spark.createDataFrame([*mail, (0, "undated", None, ["INBOX"])], "mailbox_id int, message_id string, date timestamp_ntz, labels array<string>")
    q = spark.createDataFrame(asked, "mailbox_id int, as_of timestamp_ntz")
    s = spark.createDataFrame(list(limits.items()), "mailbox_id int, limit_newest int")
    want = []
    for b, t in set(asked):
        own = sorted(((d, i) for x, i, d, l in mail if x == b and l == ["INBOX"] and d <= t and (t.date() - d.date()).days <= 7), reverse=True)
        n = limits.get(b)
        want += [(b, t, k, i) for k, (_, i) in enumerate(own[:100 if n is None else n])]
    got = iss.send_now_issues(m, q, s)
    assert sorted((r["mailbox_id"], r["release_ts"], r["msg_rank"], r["message_id"]) for r in got.collect()) == sorted(want) and len(want) > 200


def test_trailing_rate_of_a_hot_user(spark):
    """One user holds most events inside one window, with ties; light users, null users and null times beside it."""
    rng = random.Random(6)
    start = dt.datetime(2024, 3, 1)
    rows = [(i, "hot", start + dt.timedelta(seconds=rng.randrange(50), microseconds=rng.randrange(3))) for i in range(3000)]
    rows += [(3000 + i, rng.choice(["a", "b", "c", None]), start + dt.timedelta(seconds=rng.randrange(400))) for i in range(600)]
    rows += [(9000, "hot", None), (9001, "a", None)]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp")
    assert [r["user_id"] for r in heavy_keys(df, "user_id").collect()] == ["hot"]
    span = dt.timedelta(seconds=20)
    times = {}
    for _, u, t in rows:
        times.setdefault(u, []).append(t)
    want = {i: sum((x is None) if t is None else (x is not None and t - span < x <= t) for x in times[u]) for i, u, t in rows}
    got = S.trailing_rate(df, window_s=20, limit=5).collect()
    assert {r["event_id"]: r["n_in_window"] for r in got} == want and len(got) == len(rows)
    assert all(r["over_limit"] == (r["n_in_window"] > 5) for r in got)
