"""Article corpus: numbering (W1, W3), link-page joins (J2, J3), corpora (A2-A4) with
their text blocks (X6-X8), evaluation parsing (X2), top-k (O2) and the late join back
to the article data (J4).

Corpora are kept in long form ``(group, piece_pos, piece)``: the ordered pieces of an
issue, whose concatenation is the issue text. Positions come from the skew-safe
position operator, so an issue that holds a third of all links is still spread over
many tasks. ``assemble`` turns pieces into one string only for groups with a proven
size bound (issues after newest-N, the top-k articles, one message).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import heavy_keys, positions
from quire.session import ensure_checkpoint_dir

# ---- fixed values ---------------------------------------------------------------------
FAILED_SCRAPE = "[Failed to scrape this link]"
RULE = "=" * 40
# ---------------------------------------------------------------------------------------


def number_articles(links: DataFrame, *, by: Sequence[str] = ("issue_id",),
                    order: Sequence[str] = ("msg_rank", "link_pos"), name: str = "article_n") -> DataFrame:
    """Global article number in message, link order, from 0, per issue; adds ``article_id``."""
    out = positions(links, by=list(by), order=list(order), name=name)
    return out.withColumn("article_id", F.concat(F.lit("ARTICLE_"), F.col(name).cast("string")))


def attach_pages(links: DataFrame, pages: DataFrame, *, on: str = "link", text: str = "scraped",
                 how: str = "left", placeholder: str | None = FAILED_SCRAPE,
                 fetched: str | None = None, split_heavy: bool = True) -> DataFrame:
    """J2 (left, failures get the placeholder) and J3 (inner, failures dropped).

    The page side is first reduced to one row per url (the latest fetch when ``fetched``
    is given), so a url fetched twice cannot double the links; that aggregate is on the
    join key, so the join reuses its partitioning.

    ``split_heavy``: a url that holds more than a task's share of the links is spread over tasks in that proportion.
    Its links are dealt by a hash of the row (the same on every attempt) and its page rows are copied to each part; the
    heavy urls are at most one a shuffle partition, so they are broadcast. All other urls have one part. The links are
    read twice for it; without it a heavy url is one task."""
    keys, cols = [on], [on, text, *([fetched] if fetched else [])]
    pages = pages.select(*cols)
    if split_heavy:
        heavy = F.broadcast(heavy_keys(links, on))
        hashed = [F.col(f.name) for f in links.schema if "map<" not in f.dataType.simpleString()]
        copies = F.coalesce("_copies", F.lit(1))
        links = links.join(heavy, on, "left").withColumn("_part", F.pmod(F.xxhash64(*hashed), copies).cast("int")).drop("_copies")
        pages = pages.join(heavy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
        keys = [on, "_part"]
    value = F.max(text) if fetched is None else F.max_by(text, fetched)
    out = links.join(pages.groupBy(*keys).agg(value.alias(text)), keys, how).drop("_part")
    if how == "left" and placeholder is not None:
        out = out.withColumn("scraped_ok", F.col(text).isNotNull()) \
                 .withColumn(text, F.coalesce(F.col(text), F.lit(placeholder)))
    return out


def email_header(rank: Column, msg_id: Column | None, subject: Column | None = None,
                 article_id: Column | None = None) -> Column:
    """X6: '=' rule, ``EMAIL i`` (1-based), `` (ID: …)`` and `` - Subject: …`` when present."""
    head = F.concat(F.lit("EMAIL "), (rank + 1).cast("string"))
    if article_id is not None:
        head = F.concat(article_id, F.lit(" - "), head)
    parts = [F.lit("\n" + RULE + "\n"), head]
    if msg_id is not None:
        parts.append(F.when(msg_id.isNotNull(), F.concat(F.lit(" (ID: "), msg_id, F.lit(")"))).otherwise(F.lit("")))
    if subject is not None:
        parts.append(F.when(subject.isNotNull(), F.concat(F.lit(" - Subject: "), subject)).otherwise(F.lit("")))
    parts.append(F.lit("\n" + RULE + "\n"))
    return F.concat(*parts)


def email_content(content: Column | None = None, body: Column | None = None, text: Column | None = None) -> Column:
    """``Content:``, else ``Body:``, else ``Text:`` with its value; '' when none is present."""
    out = F.lit("")
    for label, c in (("Text", text), ("Body", body), ("Content", content)):
        if c is not None:
            out = F.when(c.isNotNull(), F.concat(F.lit(f"{label}:\n"), c, F.lit("\n"))).otherwise(out)
    return out


def link_header(article_id: Column, link: Column, link_pos: Column | None = None) -> Column:
    """``--- ARTICLE_n - Link k: url ---`` (k 1-based), or the short form without k."""
    if link_pos is None:
        return F.concat(F.lit("\n--- "), article_id, F.lit(" - Link: "), link, F.lit(" ---\n"))
    return F.concat(F.lit("\n--- "), article_id, F.lit(" - Link "), (link_pos + 1).cast("string"),
                    F.lit(": "), link, F.lit(" ---\n"))


def issue_corpus(messages: DataFrame, articles: DataFrame, *, by: str = "issue_id", key: str = "message_id",
                 text: str = "text", scraped: str = "scraped") -> DataFrame:
    """A2 in long form. ``messages(by, key, msg_rank, text)``; ``articles`` = numbered links
    with page text attached (W1 + J2). Piece order: message block, then its links."""
    m = messages.select(by, "msg_rank", F.lit(-1).cast("bigint").alias("link_pos"),
                        F.concat(email_header(F.col("msg_rank"), F.col(key)),
                                 email_content(text=F.col(text))).alias("piece"))
    a = articles.select(by, "msg_rank", "link_pos",
                        F.concat(link_header(F.col("article_id"), F.col("link"), F.col("link_pos")),
                                 F.col(scraped), F.lit("\n")).alias("piece"))
    pieces = m.unionByName(a)
    # (issue, msg_rank, link_pos) is unique: number the narrow key table, then join the
    # text back, so the checkpoint never holds page text
    keys = [by, "msg_rank", "link_pos"]
    numbered = positions(pieces.select(*keys), by=[by], order=["msg_rank", "link_pos"], name="piece_pos")
    return pieces.join(numbered, keys).select(by, "piece_pos", "piece")


def assemble(pieces: DataFrame, *, by: str | Sequence[str] = "issue_id", pos: str = "piece_pos",
             piece: str = "piece", name: str = "corpus") -> DataFrame:
    """Ordered concatenation of pieces, for groups whose size is bounded."""
    by = [by] if isinstance(by, str) else list(by)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(piece).alias("t"))))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias(name))


def repost_corpus(messages: DataFrame, links: DataFrame, pages: DataFrame, *, key: str = "message_id",
                  on: str = "link", scraped: str | Column = "scraped") -> DataFrame:
    """A4: ``title\\n\\ntext\\n\\n`` + texts of the distinct links that were scraped, in
    first-position order, joined by a blank line (one message is bounded).

    ``scraped``: the text column of ``pages``, or an expression over its columns that is worked out for linked pages only.
    Page text moves last and as seldom as it can: only links of ``messages`` to a page count, and messages with equal
    lists of these (positions and links) share one joined text. So a text is shuffled once for each list that holds its
    page, at most once a link of a message. A list that more than a task's share of the messages have is spread as heavy
    urls are in ``attach_pages``, and so are the messages without a list."""
    first = links.join(messages.select(key), key, "left_semi").groupBy(key, on).agg(F.min("link_pos").alias("link_pos"))
    found = first.join(pages.select(on), on, "left_semi")
    own = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("link_pos", on))).alias("_links"))
    # a list goes by its hash; links are hashed first, so what is written out for it is plain ASCII and exact
    digest = F.to_json(F.transform("_links", lambda x: F.struct(x["link_pos"].alias("p"), F.sha2(x[on], 256).alias("l"))))
    ensure_checkpoint_dir(messages.sparkSession)
    own = own.withColumn("_list", F.sha2(digest, 256)).checkpoint(eager=True)      # read several times; holds no text
    heavy = F.broadcast(heavy_keys(own, "_list"))

    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    lists = own.select("_list", F.explode("_links").alias("_l")).select("_list", "_l.*").distinct()
    lists = lists.join(heavy, "_list", "left").withColumn("_share", F.explode(copies)).drop("_copies")
    needed = pages.join(own.select(F.explode(F.col("_links")[on]).alias(on)).distinct(), on, "left_semi")
    text = F.col(scraped) if isinstance(scraped, str) else scraped
    got = attach_pages(lists, needed.select(on, text.alias("_text")), on=on, text="_text", how="inner")
    joined = got.groupBy("_list", "_share").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("link_pos", "_text"))), lambda x: x["_text"]), "\n\n").alias("_pages"))

    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(key, "title", "text"), F.when(F.col("_list").isNull(), tasks).otherwise(F.coalesce("_copies", F.lit(1))))
    out = messages.select(key, "title", "text").join(own.select(key, "_list"), key, "left").join(heavy, "_list", "left")
    out = out.withColumn("_share", share.cast("int")).join(joined, ["_list", "_share"], "left")
    return out.select(key, F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")),
                                    F.lit("\n\n"), F.coalesce("_pages", F.lit(""))).alias("corpus"))


# ---- evaluation responses (X2), top-k (O2), late join (J4), second corpus (A3) ----------------
EVAL_SCHEMA = ("struct<news: array<struct<ID: string, source: string, `brief description`: string, "
               "reasoning: string, relevancy: int>>>")


def parse_response(df: DataFrame, *, col: str = "response", schema: str = EVAL_SCHEMA,
                   keep: Sequence[str] = ()) -> DataFrame:
    """One row per ``news`` item with its ``resp_pos``; malformed text or no ``news`` -> no rows."""
    parsed = df.select(*keep, F.from_json(F.col(col), schema).alias("_r"))
    items = parsed.select(*keep, F.posexplode(F.coalesce(F.col("_r.news"), F.array())).alias("resp_pos", "_i"))
    return items.select(*keep, F.col("resp_pos").cast("bigint"), "_i.*")


def top_k(evals: DataFrame, *, k: int = 5, by: str | Sequence[str] = "issue_id", score: str = "relevancy",
          pos: str = "resp_pos", name: str = "top_rank") -> DataFrame:
    """O2: top k by score (missing = 0), descending, stable on response order. Plans a
    WindowGroupLimit: at most k rows per group leave each map task."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), F.col(pos).asc())
    out = evals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumn(name, (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def top_articles(evals: DataFrame, articles: DataFrame, *, k: int = 5, by: str | Sequence[str] = "issue_id",
                 eval_id: str = "ID", article_id: str = "article_id") -> DataFrame:
    """The top k evaluations joined to the article data on the id, after the limit,
    so unmatched ids drop out and fewer than k can remain."""
    by = [by] if isinstance(by, str) else list(by)
    top = top_k(evals, k=k, by=by)
    a = articles.withColumnRenamed(article_id, eval_id)
    return top.join(a, by + [eval_id], "inner")


def top_corpus_pieces(top: DataFrame, *, by: str = "issue_id") -> DataFrame:
    """A3 pieces for each top article: second header form, content, evaluation lines, short
    link header, page text."""
    evl = F.concat(
        F.lit("Source: "), F.coalesce(F.col("source"), F.lit("")), F.lit("\n"),
        F.lit("Brief Description: "), F.coalesce(F.col("`brief description`"), F.lit("")), F.lit("\n"),
        F.lit("Reasoning: "), F.coalesce(F.col("reasoning"), F.lit("")), F.lit("\n"),
        F.lit("Relevancy: "), F.coalesce(F.col("relevancy"), F.lit(0)).cast("string"), F.lit("\n"))
    piece = F.concat(email_header(F.col("msg_rank"), F.col("message_id"), article_id=F.col("ID")),
                     email_content(text=F.col("text")), evl,
                     link_header(F.col("ID"), F.col("link")), F.col("scraped"), F.lit("\n"))
    return top.select(by, F.col("top_rank").alias("piece_pos"), piece.alias("piece"))
