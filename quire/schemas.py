"""Schemas of the data model, declared once so readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
ARR = T.ArrayType(T.StringType())

# D2 parsed message
MESSAGE = T.StructType([
    T.StructField("mailbox_id", I), T.StructField("message_id", S), T.StructField("sender", S),
    T.StructField("title", S), T.StructField("text", S), T.StructField("html", S),
    T.StructField("links", ARR), T.StructField("images", ARR), T.StructField("labels", ARR),
    T.StructField("date", T.TimestampType()),
])

# D13 setup, one row per mailbox
SETUP = T.StructType([
    T.StructField("mailbox_id", I), T.StructField("active", B), T.StructField("days", ARR),
    T.StructField("release_time_str", S), T.StructField("seconds_between_checks", I),
    T.StructField("whitelisted_senders", ARR), T.StructField("newsletter_email", S),
    T.StructField("limit_newest", I),
])

# D7 news item
NEWS_ITEM = T.StructType([T.StructField(n, S, False) for n in (
    "title", "description", "link", "source", "category", "location", "contact", "requirements",
    "imageVideosLinks")])

# D10 digest article
ARTICLE = T.StructType([T.StructField(n, S) for n in (
    "description", "title", "source", "location", "contact", "summary", "category", "link", "image")])

# D14 selector config
SELECTORS = T.StructType([T.StructField(n, S) for n in (
    "news_url", "article_selector", "title_selector", "link_selector", "description_selector")])
