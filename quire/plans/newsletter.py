"""The flagship: every (mailbox, issue) newsletter, from raw messages to rendered HTML.

One DataFrame lineage: route messages (J1, R2), fold config mails into the setup (A5,
S3), pick the issue members (J8, T4, O1), attach their links (W1, W3) and page texts
(H1, J2), score (X4) and penalise copies (X3, W6), keep the top five (O2), describe
and classify them (X5), render (G1-G4), address the outbox (K4).

Shuffles: whitelist join, config fold, setup join (small), newest-N per issue (map-side
limited), link join on message id, page join on url (AQE splits popular urls), top-k
per issue (map-side limited), render per issue (five articles each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import preview_words
from quire.operators import digest as dg
from quire.operators import issues as iss
from quire.operators.articles import attach_pages, top_k
from quire.operators.scoring import classify, normalised, relevancy_score
from quire.sources import fixtures as fx

ISSUE = ["mailbox_id", "release_ts"]
EMAIL_RE = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


def scored_articles(spark: SparkSession, sf: str) -> DataFrame:
    from quire.plans.queries import page_texts, routed, setup
    r = routed(spark, sf)
    members = iss.issue_messages(r, setup(spark, sf, r), routes=r).select(*ISSUE, "message_id", "msg_rank")
    links = members.join(fx.msg_links_v(spark, sf), "message_id")
    # page text only for linked pages, joined on the url before anything is grouped by issue
    arts = attach_pages(links, page_texts(spark, sf, links, topical=True), split_heavy=False)
    # from here every step is partitioned by the issue (an issue holds at most max_results
    # messages, so the windows are bounded) and shares one exchange
    w = Window.partitionBy(*ISSUE).orderBy("msg_rank", "link_pos")
    arts = arts.withColumn("article_n", (F.row_number().over(w) - 1).cast("bigint"))
    arts = arts.withColumn("relevancy", F.when(F.col("scraped_ok"), relevancy_score("scraped")).otherwise(F.lit(0)))
    # the same page text twice in an issue: later copies keep a tenth of the score
    keep = F.min("article_n").over(Window.partitionBy(*ISSUE, "_h"))
    arts = arts.withColumn("_h", F.sha2(normalised("scraped"), 256)).withColumn("_keep", keep)
    arts = arts.withColumn("relevancy", F.when(F.col("article_n") != F.col("_keep"),
                                               (F.col("relevancy") / 10).cast("int")).otherwise(F.col("relevancy")))
    return arts.drop("_h", "_keep")


def kept_articles(spark: SparkSession, sf: str) -> DataFrame:
    top = top_k(scored_articles(spark, sf), k=5, by=ISSUE, pos="article_n")
    first_line = F.substring_index("scraped", "\n", 1)
    contact = F.regexp_extract("scraped", EMAIL_RE, 1)
    return top.select(
        *ISSUE, "top_rank", "link",
        first_line.alias("title"),
        F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1).alias("source"),
        F.lit("Online").alias("location"),
        F.when(contact != "", contact).alias("contact"),
        F.col("scraped").alias("description"),
        preview_words("scraped", 12).alias("summary"),
        classify("scraped").alias("category"))


def newsletter_issues(spark: SparkSession, sf: str) -> DataFrame:
    docs = dg.newsletter(kept_articles(spark, sf), by=ISSUE, pos="top_rank")
    return docs.select(*ISSUE, "n_sections", "html")


def newsletter_outbox(spark: SparkSession, sf: str) -> DataFrame:
    from quire.plans.queries import routed, setup
    docs = newsletter_issues(spark, sf)
    return dg.outbox(docs, setup(spark, sf, routed(spark, sf))).select(*ISSUE, "to", "subject", "sender", "html")
