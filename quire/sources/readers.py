"""Readers with declared schemas (S1, S3, S4, S5). Defaults are applied as column
expressions, so a missing key and a missing file field behave alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.operators.issues import SETUP_DEFAULTS
from quire.operators.news import DEFAULT_SELECTORS


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Exported parsed messages."""
    return spark.read.schema(schemas.MESSAGE).format(fmt).load(path)


def read_setup(spark: SparkSession, path: str) -> DataFrame:
    """S3: setup JSON (one object per file, or one per line) with the reference's defaults."""
    d = SETUP_DEFAULTS
    raw = spark.read.schema(schemas.SETUP).option("multiLine", True).json(path)
    arr = "array<string>"
    return raw.select(
        F.coalesce("mailbox_id", F.lit(0)).alias("mailbox_id"),
        F.coalesce("active", F.lit(d["active"])).alias("active"),
        F.coalesce("days", F.array().cast(arr)).alias("days"),
        F.coalesce("release_time_str", F.lit(d["release_time_str"])).alias("release_time_str"),
        F.coalesce("seconds_between_checks", F.lit(d["seconds_between_checks"])).alias("seconds_between_checks"),
        F.coalesce("whitelisted_senders", F.array().cast(arr)).alias("whitelisted_senders"),
        F.coalesce("newsletter_email", F.lit(d["newsletter_email"])).alias("newsletter_email"),
        F.coalesce("limit_newest", F.lit(d["limit_newest"])).alias("limit_newest"))


def read_category_colors(spark: SparkSession, path: str) -> DataFrame:
    """``{"category_colors": {name: colour}}`` -> ``(category, color)``; small by nature."""
    raw = spark.read.option("multiLine", True).schema("category_colors map<string,string>").json(path)
    return raw.select(F.explode("category_colors").alias("category", "color"))


def read_selectors(spark: SparkSession, path: str) -> DataFrame:
    """Selector config with per-field defaults."""
    raw = spark.read.option("multiLine", True).schema(schemas.SELECTORS).json(path)
    return raw.select(
        "news_url",
        F.coalesce("article_selector", F.lit(DEFAULT_SELECTORS["article"])).alias("article"),
        F.coalesce("title_selector", F.lit(DEFAULT_SELECTORS["title"])).alias("title"),
        F.coalesce("link_selector", F.lit(DEFAULT_SELECTORS["link"])).alias("link"),
        F.coalesce("description_selector", F.lit(DEFAULT_SELECTORS["description"])).alias("description"))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """K6 input: whole HTML files as rows ``(path, html)``; a missing folder gives no rows."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], "path string, html string")
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
