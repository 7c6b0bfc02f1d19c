"""Sinks (K1-K7). Every write is idempotent for its key: partitioned outputs use dynamic
partition overwrite, so a retried task or a replayed batch rewrites the same partitions
instead of adding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dynamic(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write_news_json(items: DataFrame, path: str) -> None:
    """K1: news items as JSON lines, replaced on every run."""
    items.write.mode("overwrite").json(path)


def write_page_text(pages: DataFrame, path: str, *, text: str = "content", key: str = "page_id",
                    buckets: int = 64) -> None:
    """K2: page texts with their page key and url, one JSON line a page (a text may hold line
    ends), in a bounded number of directories by a hash of the key."""
    url = [F.col("url")] if "url" in pages.columns else []
    out = pages.select(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), F.col(key), *url, F.col(text).alias("content"))
    _dynamic(out).partitionBy("bucket").json(path)


def write_issue_html(docs: DataFrame, path: str, *, keys=("mailbox_id", "release_ts"), html: str = "html") -> None:
    """K3: one HTML document per issue, one partition per issue."""
    out = docs.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(html).alias("value"))
    _dynamic(out).partitionBy(*keys).text(path)


def append_outbox(rows: DataFrame, path: str, *, keys=("mailbox_id", "release_ts")) -> None:
    """K4: outbox rows ``(to, subject, html, sender)``; rows without an address are not
    written; replaying an issue replaces its rows."""
    out = rows.where(F.col("to").isNotNull() & (F.col("to") != "")) \
              .withColumn("sender", F.coalesce(F.col("sender"), F.lit("me")))
    out = out.select(*[F.col(k).cast("string").alias(k) for k in keys],
                     *[c for c in out.columns if c not in keys])
    _dynamic(out).partitionBy(*keys).parquet(path)


def write_setup(setup: DataFrame, path: str, *, key: str = "mailbox_id") -> None:
    """K5: the full setup per mailbox, replaced as a whole for the mailboxes written."""
    _dynamic(setup).partitionBy(key).json(path)


def split_dead_letter(df: DataFrame, *, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """K7: rows with an error go to the dead-letter output, the rest go on."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def write_dead_letter(bad: DataFrame, path: str, *, batch: int | None = None) -> None:
    out = bad if batch is None else bad.withColumn("batch_id", F.lit(batch))
    if batch is None:
        out.write.mode("append").parquet(path)
    else:
        _dynamic(out).partitionBy("batch_id").parquet(path)


def outbox_from_files(spark, path: str, to: str, subject: str, sender: str | None = None) -> DataFrame:
    """K6: one outbox row per HTML file in a folder; a missing folder or an empty address
    gives no rows."""
    from quire.sources.readers import read_html_files
    files = read_html_files(spark, path)
    rows = files.select(F.lit(to).alias("to"), F.lit(subject).alias("subject"), F.col("html"),
                        F.lit(sender or "me").alias("sender"), "path")
    return rows.where(F.col("to") != "")
