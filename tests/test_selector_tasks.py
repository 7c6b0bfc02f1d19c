"""The memory of a task of selected_items: tasks follow the input, and few window orders hold a task's tokens."""

import re

from pyspark.sql import functions as F

from quire.operators import news

SITE = {"article": ".post", "title": "h2.entry-title", "link": "h2.entry-title a", "description": ".entry-content p"}
PAGE = '<div class="post"><h2 class="entry-title"><a href="/x">T</a></h2><div class="entry-content"><p>one<p>two</div></div>'


def _pages(spark):
    return spark.createDataFrame([(i, "http://h/", PAGE) for i in range(200)], "page_id int, url string, html string")


def test_tasks_follow_the_length_of_the_pages(spark, monkeypatch):
    monkeypatch.setattr(news, "TASK_CHARS", 5 * len(PAGE), raising=False)
    out = news.selected_items(_pages(spark), SITE)
    where = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in where) == 200
    assert max(r["count"] for r in where) <= 25                  # about 5 pages each; one task of all before


def test_few_sorts(spark):
    plan = news.selected_items(_pages(spark), SITE)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) <= 7              # 19 before


def test_items_of_an_open_paragraph_end_at_the_next_block(spark):
    html = '<p class="post">a<span>b</span><p class="post x"><span>c</span><div><span>d</span></div>'
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id int, url string, html string")
    got = news.selected_items(df, {"article": "p.post", "title": "span", "link": "a", "description": "p.x span"}).collect()
    assert sorted((r["item_no"], r["title"], r["description"]) for r in got) == [(1, "b", ""), (2, "c", "c")]
