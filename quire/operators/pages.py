"""Page side operators: long-form links and images (P6-P8, H5), page text (H1-H4),
image manifest (H7). Each page is one row and every step is narrow (no shuffle)
except the manifest's last-write-wins step, which groups by (page, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions.text import safe_name


def links(df: DataFrame, *, html: str = "html", key: str | list[str] = "page_id", base: str | None = None,
          filtered: bool = True, name: str = "link", pos: str = "link_pos") -> DataFrame:
    """P6/P7 long form: ``(key, link_pos, link)`` in document order; resolved when ``base`` is given."""
    keys = [key] if isinstance(key, str) else list(key)
    arr = H.filtered_links(html) if filtered else H.raw_links(html)
    cols = keys + ([base] if base else [])
    out = df.select(*cols, F.posexplode(arr).alias(pos, name))
    if base:
        out = out.withColumn(name, H.url_resolve(F.col(base), F.col(name))).drop(base)
    return out.withColumn(pos, F.col(pos).cast("bigint"))


def images(df: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """P8 long form: ``(key, img_pos, src)``; an empty ``src`` is kept."""
    return df.select(key, F.posexplode(H.image_sources(html)).alias("img_pos", "src")) \
             .withColumn("img_pos", F.col("img_pos").cast("bigint"))


def page_links_abs(df: DataFrame, *, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """H5: every ``a@href`` and ``img@src`` in document order, made absolute, unfiltered."""
    tags = F.regexp_extract_all(H.without_scripts(html), F.lit("(?i)" + H.tag_re("(?:a|img)")), 0)
    vals = F.transform(tags, lambda t: F.when(F.lower(t).startswith("<a"), H._value(t, "href")).otherwise(H._value(t, "src")))
    out = df.select(key, url, F.posexplode(F.filter(vals, lambda v: v.isNotNull())).alias("link_pos", "ref"))
    return out.select(key, F.col("link_pos").cast("bigint"), H.url_resolve(F.col(url), F.col("ref")).alias("link"))


def image_manifest(df: DataFrame, *, html: str = "html", url: str = "url", key: str = "page_id",
                   folder: str = "newsletter") -> DataFrame:
    """H7: where each page image would be saved. Index over all ``img`` tags, tags without
    a ``src`` skipped; a later image with the same path replaces an earlier one."""
    imgs = df.select(key, url, F.posexplode(H.all_img_sources(html)).alias("idx", "src")) \
             .where(F.col("src").isNotNull() & (F.col("src") != ""))
    img_url = H.url_resolve(F.col(url), F.col("src"))
    path = F.regexp_extract(img_url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    fname = F.when((base == "") | ~base.contains("."),
                   F.concat(F.lit("image_"), F.col("idx").cast("string"), F.lit(".jpg"))).otherwise(base)
    save = F.concat(F.lit(f"images/{folder}/"), safe_name(F.col(url)), F.lit("/"), fname)
    rows = imgs.select(key, img_url.alias("img_url"), save.alias("save_path"), "idx")
    return rows.groupBy(key, "save_path").agg(F.max_by("img_url", "idx").alias("img_url"),
                                              F.max("idx").cast("bigint").alias("idx"))
