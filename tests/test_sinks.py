"""Sinks and readers: round trips, defaults, idempotent rewrites."""

import json
import os

from pyspark.sql import functions as F

from conftest import SMALL
from quire.sources import readers, sinks


def test_outbox_idempotent_and_skips_empty(spark, scratch):
    rows = spark.createDataFrame([(0, "2024-01-03 12:00:00", "a@x", "Newsletter", None, "<p>1</p>"),
                                  (1, "2024-01-03 12:00:00", "", "Newsletter", None, "<p>2</p>")],
                                 "mailbox_id int, release_ts string, to string, subject string, sender string, html string")
    path = os.path.join(scratch, "outbox")
    sinks.append_outbox(rows, path)
    sinks.append_outbox(rows, path)
    got = spark.read.parquet(path)
    assert got.count() == 1 and got.first()["sender"] == "me"


def test_setup_defaults(spark, scratch):
    p = os.path.join(scratch, "setup.json")
    with open(p, "w") as f:
        json.dump({"mailbox_id": 3, "days": ["Monday"]}, f)
    r = readers.read_setup(spark, p).first()
    assert r["active"] is True and r["limit_newest"] == 10 and r["seconds_between_checks"] == 10
    assert r["release_time_str"] == "" and list(r["days"]) == ["Monday"]


def test_colors_and_selectors(spark, scratch):
    p = os.path.join(scratch, "colors.json")
    with open(p, "w") as f:
        json.dump({"category_colors": {"News": "#007BFF", "Other": "#6c757d"}}, f)
    assert {r["category"] for r in readers.read_category_colors(spark, p).collect()} == {"News", "Other"}
    s = os.path.join(scratch, "sel.json")
    with open(s, "w") as f:
        json.dump({"news_url": "http://h", "article_selector": ".post"}, f)
    r = readers.read_selectors(spark, s).first()
    assert r["article"] == ".post" and r["title"] == "h2" and r["description"] == "p"


def test_html_files_missing_folder(spark, scratch):
    assert readers.read_html_files(spark, os.path.join(scratch, "nope")).count() == 0
    d = os.path.join(scratch, "html_in")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "a.html"), "w") as f:
        f.write("<p>x</p>\n<p>y</p>")
    assert readers.read_html_files(spark, d).first()["html"] == "<p>x</p>\n<p>y</p>"


def test_text_and_json_sinks(spark, scratch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", F.col("url").alias("content"))
    sinks.write_page_text(pages, os.path.join(scratch, "page_text"), buckets=4)
    assert spark.read.text(os.path.join(scratch, "page_text")).count() == pages.count()
    sinks.write_news_json(pages, os.path.join(scratch, "news_json"))
    assert spark.read.json(os.path.join(scratch, "news_json")).count() == pages.count()


def test_issue_html_and_setup_rewrites(spark, scratch):
    docs = spark.createDataFrame([(0, "2024-01-03 12:00:00", "<html>a</html>"), (1, "2024-01-03 12:00:00", "<html>b</html>")],
                                 "mailbox_id int, release_ts string, html string")
    path = os.path.join(scratch, "issues_html")
    sinks.write_issue_html(docs, path)
    sinks.write_issue_html(docs.where("mailbox_id = 0"), path)   # a replay of one issue rewrites it only
    assert spark.read.text(path).count() == 2
    setup = spark.createDataFrame([(0, True, "09:00:00"), (1, False, "")], "mailbox_id int, active boolean, release_time_str string")
    sp = os.path.join(scratch, "setup_out")
    sinks.write_setup(setup, sp)
    sinks.write_setup(setup.where("mailbox_id = 1").withColumn("active", F.lit(True)), sp)
    got = {r["mailbox_id"]: r["active"] for r in spark.read.json(sp).collect()}
    assert got == {0: True, 1: True}


def test_outbox_from_files(spark, scratch):
    d = os.path.join(scratch, "html_out_in")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "n.html"), "w") as f:
        f.write("<html>n</html>")
    rows = sinks.outbox_from_files(spark, d, "a@x", "Newsletter").collect()
    assert len(rows) == 1 and rows[0]["html"] == "<html>n</html>" and rows[0]["sender"] == "me"
    assert sinks.outbox_from_files(spark, os.path.join(scratch, "none"), "a@x", "N").count() == 0
    assert sinks.outbox_from_files(spark, d, "", "N").count() == 0


def test_query_runner_writes_parquet(spark, scratch):
    from quire.plans.run import main
    out = os.path.join(scratch, "runner_out")
    assert main(["--tables", SMALL, "--out", out, "scan_pages", "safe_name"]) == 0
    assert spark.read.parquet(os.path.join(out, "scan_pages")).count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert spark.read.parquet(os.path.join(out, "safe_name")).columns == ["page_id", "name"]
