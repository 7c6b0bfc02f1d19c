"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (through the fixture views) so its work grows
with the data. Column names equal those of the matching oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import issues as iss
from quire.operators import mailbox as mb
from quire.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- shared pipeline pieces --------------------------------------------------------------
def routed(spark: SparkSession, sf: str) -> DataFrame:
    return mb.route_messages(fx.messages_v(spark, sf), fx.whitelist_v(spark, sf))


def checked(r: DataFrame) -> DataFrame:
    """The routed mail that a mail check acts on."""
    return r.where(mb.mail_check_scope())


def folded_config(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    r = checked(r if r is not None else routed(spark, sf))
    return mb.config_fold(r.where(F.col("route") == mb.ROUTE_CONFIG), poll=F.to_date("date"))


def setup(spark: SparkSession, sf: str, r: DataFrame | None = None) -> DataFrame:
    r = r if r is not None else routed(spark, sf)
    return iss.setup_from_configs(folded_config(spark, sf, r), r.select("mailbox_id"))


def issue_messages(spark: SparkSession, sf: str) -> DataFrame:
    r = routed(spark, sf)
    return iss.issue_messages(r, setup(spark, sf, r), routes=r)


# ---- 2.13 issue timing --------------------------------------------------------------------
@register("issue_messages")
def q_issue_messages(spark, sf):
    return issue_messages(spark, sf).select("mailbox_id", "release_ts", "msg_rank", "message_id", "date",
                                            "address", "route")


def _labels_str(c: str = "labels"):
    return F.array_join(F.array_sort(F.col(c)), ",").alias("labels_str")


# ---- 2.1 scans ---------------------------------------------------------------------------
@register("scan_messages")
def q_scan_messages(spark, sf):
    return fx.messages_v(spark, sf).select("message_id", "mailbox_id", "date", "sender", "title", "text",
                                           _labels_str())


@register("scan_setup")
def q_scan_setup(spark, sf):
    return setup(spark, sf).select("mailbox_id", "active", F.array_join("days", ",").alias("days_str"),
                                   "release_time_str", "seconds_between_checks", "newsletter_email",
                                   "limit_newest")


# ---- 2.3 message-side scalar functions ------------------------------------------------------
@register("header_map")
def q_header_map(spark, sf):
    from quire.operators.mime import header_map
    h = fx.headers_v(spark, sf).withColumn("m", header_map("headers"))
    return h.select("message_id", F.try_element_at("m", F.lit("from")).alias("sender"),
                    F.try_element_at("m", F.lit("subject")).alias("subject"),
                    F.try_element_at("m", F.lit("date")).alias("date_header"))


@register("mail_date")
def q_mail_date(spark, sf):
    from quire.functions.text import mail_date
    from quire.operators.mime import header_map
    h = fx.headers_v(spark, sf).withColumn("date_header", F.try_element_at(header_map("headers"), F.lit("date")))
    return h.select("message_id", "date_header", mail_date("date_header").cast("timestamp_ntz").alias("mail_date"))


@register("body_decode")
def q_body_decode(spark, sf):
    from quire.functions.text import body_decode
    return fx.parts_v(spark, sf).select("message_id", "path", "mime_type", body_decode("data").alias("text"))


@register("body_concat")
def q_body_concat(spark, sf):
    from quire.operators.mime import bodies, decode_leaves
    return bodies(decode_leaves(fx.parts_v(spark, sf)))


@register("mime_leaves")
def q_mime_leaves(spark, sf):
    from quire.operators.mime import decode_leaves, mime_leaves
    leaves = decode_leaves(mime_leaves(fx.payload_v(spark, sf)))
    return leaves.select("message_id", F.array_join("path", ".").alias("path_str"), "mime_type", "text")


@register("sender_address")
def q_sender_address(spark, sf):
    from quire.functions.text import sender_address
    return fx.messages_v(spark, sf).select("message_id", "sender", sender_address("sender").alias("address"))


@register("preview_words")
def q_preview_words(spark, sf):
    from quire.functions.text import preview_words
    from quire.sources.tables import read_table
    return read_table(spark, sf, "documents").select("doc_id", preview_words("text").alias("preview"))


@register("preview_chars")
def q_preview_chars(spark, sf):
    from quire.functions.text import preview_chars
    from quire.sources.tables import read_table
    return read_table(spark, sf, "documents").select("doc_id", preview_chars("text").alias("head"))


@register("safe_name")
def q_safe_name(spark, sf):
    from quire.functions.text import safe_name
    from quire.sources.tables import read_table
    return read_table(spark, sf, "pages").select("page_id", safe_name("url").alias("name"))


# ---- 2.6 filters ---------------------------------------------------------------------------
@register("filter_dates")
def q_filter_dates(spark, sf):
    m = fx.messages_v(spark, sf)
    return m.where(mb.date_range(m, "2024-01-08", "2024-01-14")).select("message_id", "date")


@register("filter_read")
def q_filter_read(spark, sf):
    m = fx.messages_v(spark, sf)
    unread = m.where(mb.read_state(0)).select("message_id", F.lit("unread").alias("state"))
    read = m.where(mb.read_state(1)).select("message_id", F.lit("read").alias("state"))
    return unread.unionByName(read)


@register("filter_archived")
def q_filter_archived(spark, sf):
    m = fx.messages_v(spark, sf)
    inbox = m.where(mb.archive_state(0)).select("message_id", F.lit("inbox").alias("state"))
    arch = m.where(mb.archive_state(1)).select("message_id", F.lit("archived").alias("state"))
    return inbox.unionByName(arch)


@register("filter_sender")
def q_filter_sender(spark, sf):
    m = fx.messages_v(spark, sf)
    return m.where(mb.sender_is("user10@example.com")).select("message_id", "sender")


@register("filter_labels_all")
def q_filter_labels_all(spark, sf):
    m = fx.messages_v(spark, sf)
    return mb.mailbox_query(m, archived=2, include=["inbox", "Unread"], max_results=None) \
             .select("message_id")


@register("filter_labels_none")
def q_filter_labels_none(spark, sf):
    m = fx.messages_v(spark, sf)
    reg = label_registry(spark, sf)
    return mb.mailbox_query(m, archived=2, exclude=["Analyzed", "spam", "no_such_label"], registry=reg,
                            max_results=None).select("message_id")


@register("mailbox_query")
def q_mailbox_query(spark, sf):
    m = fx.messages_v(spark, sf)
    return mb.mailbox_query(m, start="2024-01-03", end="2024-01-20", archived=0, read=2, include=["INBOX"],
                            exclude=["ANALYZED"], newest=30).select("mailbox_id", "message_id", "date")


@register("newest_n")
def q_newest_n(spark, sf):
    return mb.newest_n(fx.messages_v(spark, sf), 25).select("mailbox_id", "message_id")


@register("message_rank")
def q_message_rank(spark, sf):
    return mb.message_rank(fx.messages_v(spark, sf).select("mailbox_id", "message_id", "date")) \
             .select("mailbox_id", "message_id", "msg_rank")


# ---- 2.7 joins / routing -----------------------------------------------------------------------
@register("whitelist_split")
def q_whitelist_split(spark, sf):
    return mb.whitelist_split(fx.messages_v(spark, sf), fx.whitelist_v(spark, sf)) \
             .select("message_id", "address", "is_whitelisted")


@register("whitelist_own")
def q_whitelist_own(spark, sf):
    """Every mailbox trusts the senders of its own setup only."""
    wl = mb.setup_whitelist(fx.sender_setup_v(spark, sf))
    return mb.whitelist_split(fx.messages_v(spark, sf), wl).select("mailbox_id", "message_id", "address", "is_whitelisted")


@register("whitelist_semi")
def q_whitelist_semi(spark, sf):
    return mb.whitelist_semi(fx.messages_v(spark, sf), fx.whitelist_v(spark, sf)).select("message_id")


@register("whitelist_anti")
def q_whitelist_anti(spark, sf):
    return mb.whitelist_semi(fx.messages_v(spark, sf), fx.whitelist_v(spark, sf), anti=True).select("message_id")


@register("route_messages")
def q_route_messages(spark, sf):
    return checked(routed(spark, sf)).select("message_id", "route")


@register("config_fold")
def q_config_fold(spark, sf):
    return folded_config(spark, sf).select("mailbox_id", "key", "value")


@register("dead_letter")
def q_dead_letter(spark, sf):
    r = checked(routed(spark, sf)).where(F.col("route") == mb.ROUTE_CONFIG)
    return mb.config_entries(r).where(F.col("error").isNotNull()).select("mailbox_id", "message_id", "error")


@register("mailbox_counts")
def q_mailbox_counts(spark, sf):
    return mb.mailbox_counts(fx.messages_v(spark, sf))


# ---- 2.11 label state -------------------------------------------------------------------------
@register("label_update")
def q_label_update(spark, sf):
    return mb.update_labels(fx.messages_v(spark, sf), fx.changes_v(spark, sf)).select("message_id", _labels_str())


@register("archive")
def q_archive(spark, sf):
    return mb.archive(fx.messages_v(spark, sf)).select("message_id", _labels_str())


@register("delete_messages")
def q_delete_messages(spark, sf):
    m = fx.messages_v(spark, sf)
    ids = m.where(F.col("message_id").cast("bigint") % 5 == 0).select("mailbox_id", "message_id")
    return mb.delete_messages(m, ids).select("mailbox_id", "message_id")


def label_registry(spark, sf):
    m = fx.messages_v(spark, sf)
    existing = (m.select("mailbox_id", F.explode("labels").alias("name"))
                 .where(~F.upper("name").isin(*mb.SYSTEM_LABELS)).distinct()
                 .withColumn("label_id", F.col("name")))
    wanted = m.select("mailbox_id", F.when(F.col("message_id").cast("bigint") % 2 == 0, F.upper("title"))
                      .otherwise(F.col("title")).alias("name")) \
              .unionByName(existing.select("mailbox_id", F.concat(F.upper(F.substring("name", 1, 1)),
                                                                  F.lower(F.substring("name", 2, 1 << 20)))
                                           .alias("name")))
    return mb.ensure_labels(existing, wanted)


@register("label_registry")
def q_label_registry(spark, sf):
    return label_registry(spark, sf).select("mailbox_id", "name", "label_id")


@register("label_resolve")
def q_label_resolve(spark, sf):
    m = fx.messages_v(spark, sf)
    names = (m.select("mailbox_id", F.explode("labels").alias("name")).select("mailbox_id", F.lower("name").alias("name"))
              .unionByName(m.select("mailbox_id", F.col("title").alias("name"))).distinct())
    return mb.label_resolve(names, label_registry(spark, sf)).select("mailbox_id", "name", "label_id")


@register("unprocessed")
def q_unprocessed(spark, sf):
    m = fx.messages_v(spark, sf)
    ledger = m.where(F.array_contains("labels", "ANALYZED")).select("mailbox_id", "message_id")
    return mb.unprocessed(m, ledger).select("mailbox_id", "message_id")


# ---- 2.13 dates ----------------------------------------------------------------------------
@register("assign_issue")
def q_assign_issue(spark, sf):
    r = routed(spark, sf)
    return iss.assign_issue(r, setup(spark, sf, r)).select("mailbox_id", "message_id", "release_ts")


def _schedule(m):
    """A per-sender schedule for T1/T2: listed days and a release time from the user id."""
    uid = F.regexp_extract("sender", r"user(\d+)@", 1).cast("int")
    names = F.array(*[F.lit(n) for n in iss.WEEKDAYS])
    days = F.filter(names, lambda n, i: ((uid + i) % 3 == 0) & (i < uid % 8))
    rel = F.concat(F.lpad((uid % 24).cast("string"), 2, "0"), F.lit(":"),
                   F.lpad((uid % 60).cast("string"), 2, "0"), F.lit(":00"))
    return m.select("message_id", "date", days.alias("days"), rel.alias("release_time_str"),
                    (uid % 9 != 0).alias("active"))


@register("next_release")
def q_next_release(spark, sf):
    s = _schedule(fx.messages_v(spark, sf))
    return s.select("message_id", iss.next_release("date", "days", "release_time_str", "active").alias("release_ts"))


@register("release_delay")
def q_release_delay(spark, sf):
    s = _schedule(fx.messages_v(spark, sf))
    s = s.withColumn("release_ts", iss.next_release("date", "days", "release_time_str", "active"))
    return s.where(F.col("release_ts").isNotNull()).select(
        "message_id", iss.release_delay("date", "release_ts").alias("delay_sec"))


@register("issue_window")
def q_issue_window(spark, sf):
    im = issue_messages(spark, sf)
    first, last = iss.issue_window(F.col("release_ts"))
    return im.select("mailbox_id", "release_ts", first.alias("first_day"), last.alias("last_day")).distinct()


# ---- 2.4 page side -------------------------------------------------------------------------
def _pages(spark, sf):
    from quire.sources.tables import read_table
    return read_table(spark, sf, "pages")


@register("scan_pages")
def q_scan_pages(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@register("extract_links")
def q_extract_links(spark, sf):
    from quire.operators.pages import links
    return links(fx.pages_mixed_v(spark, sf), filtered=False)


@register("filter_links")
def q_filter_links(spark, sf):
    from quire.operators.pages import links
    return links(fx.pages_mixed_v(spark, sf), filtered=True)


@register("extract_images")
def q_extract_images(spark, sf):
    from quire.operators.pages import images
    return images(fx.pages_img_v(spark, sf))


@register("page_text_lines")
def q_page_text_lines(spark, sf):
    from quire.functions.html import page_text_lines
    return _pages(spark, sf).select("page_id", page_text_lines("html").alias("text"))


@register("neutralise_links")
def q_neutralise_links(spark, sf):
    from quire.functions.html import page_text_lines, problem_link_count
    p = fx.pages_mixed_v(spark, sf)
    return p.select("page_id", problem_link_count("html").cast("bigint").alias("n_neutralised"),
                    page_text_lines("html").alias("text"))


@register("collapse_blank_lines")
def q_collapse_blank_lines(spark, sf):
    from quire.functions.html import collapse_blank_lines
    from quire.sources.tables import read_table
    return read_table(spark, sf, "documents").select("doc_id", collapse_blank_lines("text").alias("text"))


@register("page_text_flat")
def q_page_text_flat(spark, sf):
    from quire.functions.html import page_text_flat
    return _pages(spark, sf).select("page_id", page_text_flat("html").alias("content"))


@register("page_links_abs")
def q_page_links_abs(spark, sf):
    from quire.operators.pages import page_links_abs
    return page_links_abs(fx.pages_img_v(spark, sf))


URL_VARIANTS = ("same", "relative", "parent", "dot", "query", "fragment", "netpath", "scheme", "empty")


@register("url_resolve")
def q_url_resolve(spark, sf):
    from quire.functions.html import raw_links, url_resolve
    # the page url rides along with the extraction: one scan, no join back to pages
    ls = _pages(spark, sf).select("page_id", "url", F.posexplode(raw_links("html")).alias("link_pos", "link")) \
        .withColumn("link_pos", F.col("link_pos").cast("bigint"))
    tail = F.substring("link", 2, 1 << 20)
    refs = F.array(F.col("link"), tail, F.concat(F.lit("../"), tail), F.concat(F.lit("./"), tail),
                   F.concat(F.lit("?q="), tail), F.concat(F.lit("#"), tail),
                   F.concat(F.lit("//cdn.example.com"), F.col("link")), F.concat(F.lit("mailto:"), tail), F.lit(""))
    v = ls.select("page_id", "link_pos", "url", F.posexplode(refs).alias("variant", "ref"))
    return v.select("page_id", "link_pos", F.col("variant").cast("bigint"), "ref",
                    url_resolve(F.col("url"), F.col("ref")).alias("resolved"))


@register("image_manifest")
def q_image_manifest(spark, sf):
    from quire.operators.pages import image_manifest
    return image_manifest(fx.pages_img_v(spark, sf)).select("page_id", "save_path", "img_url")


# ---- 2.7 / 2.9 / 2.12 corpus side -------------------------------------------------------------
def numbered_articles(spark, sf):
    from quire.operators.articles import attach_pages, number_articles
    nl = number_articles(fx.corpus_links(spark, sf))
    return attach_pages(nl, fx.scraped_v(spark, sf))


@register("article_ids")
def q_article_ids(spark, sf):
    from quire.operators.articles import number_articles
    return number_articles(fx.corpus_links(spark, sf)).select("issue_id", "message_id", "link_pos", "doc_id",
                                                              "article_n", "article_id")


@register("link_page_join")
def q_link_page_join(spark, sf):
    return numbered_articles(spark, sf).select("article_id", "link", "scraped_ok", "scraped")


@register("repost_links")
def q_repost_links(spark, sf):
    from quire.operators.articles import attach_pages
    return attach_pages(fx.links_v(spark, sf), fx.scraped_v(spark, sf), how="inner") \
        .select("message_id", "link_pos", "link", "scraped")


@register("issue_corpus")
def q_issue_corpus(spark, sf):
    from quire.operators.articles import issue_corpus
    arts = numbered_articles(spark, sf)
    msgs = fx.corpus_links(spark, sf).select("issue_id", "message_id", "msg_rank").distinct() \
        .withColumn("text", F.concat(F.lit("Digest of "), F.col("message_id")))
    return issue_corpus(msgs, arts)


def page_texts(spark, sf, needed: DataFrame | None = None, topical: bool = False):
    """H1 text per page url; with ``needed`` (a ``link`` column) only for those pages: the
    semi join runs first (AQE broadcasts a small link set), so text is extracted only
    where it is used. ``topical`` texts name themes and categories (the digest's fixture)."""
    from quire.functions.html import page_text_lines
    p = _pages(spark, sf).select("page_id", F.col("url").alias("link"), "html")
    if needed is not None:
        p = p.join(needed.select("link"), "link", "left_semi")
    text = page_text_lines("html")
    if topical:
        text = F.concat(F.expr(fx.topics("page_id")), text)
    return p.select("link", text.alias("scraped"))


@register("repost_corpus")
def q_repost_corpus(spark, sf):
    from quire.functions.html import page_text_lines
    from quire.operators.articles import repost_corpus
    reposts = checked(routed(spark, sf)).where(F.col("route") == mb.ROUTE_REPOST)
    pages = _pages(spark, sf).select(F.col("url").alias("link"), "html")
    return repost_corpus(reposts, fx.msg_links_v(spark, sf), pages, scraped=page_text_lines("html"))


@register("parse_evaluation")
def q_parse_evaluation(spark, sf):
    from quire.operators.articles import parse_response
    items = parse_response(fx.eval_json_v(spark, sf), keep=["message_id", "block"])
    return items.select("message_id", "block", "resp_pos", "ID", "source",
                        F.col("`brief description`").alias("brief_description"), "relevancy")


def _evals(spark, sf):
    return fx.evaluation_v(spark, sf).select("message_id", F.col("id").alias("ID"), "relevancy",
                                             F.col("doc_id").alias("resp_pos"))


@register("top5")
def q_top5(spark, sf):
    from quire.operators.articles import top_k
    return top_k(_evals(spark, sf), by="message_id").select("message_id", "ID", "relevancy", "top_rank")


def article_data(spark, sf):
    from quire.operators.articles import attach_pages
    cl = fx.corpus_links(spark, sf).where(F.col("doc_id") % 7 != 0) \
        .withColumn("article_id", F.concat(F.lit("ARTICLE_"), F.col("doc_id").cast("string")))
    return attach_pages(cl, fx.scraped_v(spark, sf))


def top_articles(spark, sf):
    from quire.operators.articles import top_articles as ta
    arts = article_data(spark, sf).select("message_id", "article_id", "msg_rank", "link", "scraped", "scraped_ok")
    return ta(_evals(spark, sf), arts, by="message_id")


@register("top_articles")
def q_top_articles(spark, sf):
    return top_articles(spark, sf).select("message_id", "top_rank", "ID", "relevancy", "link", "scraped_ok")


@register("top_corpus")
def q_top_corpus(spark, sf):
    from quire.operators.articles import assemble, top_corpus_pieces
    top = top_articles(spark, sf).withColumn("text", F.concat(F.lit("Digest of "), F.col("message_id"))) \
        .withColumn("source", F.lit(None).cast("string")).withColumn("brief description", F.lit(None).cast("string")) \
        .withColumn("reasoning", F.lit(None).cast("string"))
    return assemble(top_corpus_pieces(top, by="message_id"), by="message_id")


@register("email_header")
def q_email_header(spark, sf):
    from quire.operators.articles import email_content, email_header
    m = mb.message_rank(fx.messages_v(spark, sf))
    return m.select("message_id", email_header(F.col("msg_rank"), F.col("message_id")).alias("header"),
                    email_content(text=F.col("text")).alias("content"))


# ---- 2.12 / 2.9 scoring and text -------------------------------------------------------------
def _docs(spark, sf):
    from quire.sources.tables import read_table
    return read_table(spark, sf, "documents")


@register("text_blocks")
def q_text_blocks(spark, sf):
    from quire.operators.text import text_blocks
    return text_blocks(_docs(spark, sf), max_chars=1000)


@register("text_blocks_udf")
def q_text_blocks_udf(spark, sf):
    from quire.operators.text import text_blocks
    return text_blocks(_docs(spark, sf), max_chars=5000)


@register("relevancy_score")
def q_relevancy_score(spark, sf):
    from quire.operators.scoring import relevancy_score
    return fx.topical_v(spark, sf).select("doc_id", relevancy_score("text").alias("relevancy"))


@register("theme_filter")
def q_theme_filter(spark, sf):
    from quire.operators.scoring import theme_filter
    return fx.topical_v(spark, sf).where(theme_filter("text")).select("doc_id")


@register("classify_category")
def q_classify_category(spark, sf):
    from quire.operators.scoring import classify
    return fx.topical_v(spark, sf).select("doc_id", classify("text").alias("category"))


@register("future_only")
def q_future_only(spark, sf):
    from quire.operators.scoring import future_only
    return future_only(fx.messages_v(spark, sf), date="date", as_of="2024-01-20").select("message_id", "date")


@register("schema_violations")
def q_schema_violations(spark, sf):
    from quire.operators.scoring import check_articles
    _, bad = check_articles(fx.articles_v(spark, sf))
    return bad.select("pos", "error")


@register("dedup_exact")
def q_dedup_exact(spark, sf):
    from quire.operators.scoring import exact_copies
    return exact_copies(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "dup_of", "is_copy")


@register("dedup_penalty")
def q_dedup_penalty(spark, sf):
    from quire.operators.scoring import exact_copies, penalise_copies
    d = exact_copies(_docs(spark, sf).select("doc_id", "text"))  # (doc_id, dup_of, is_copy)
    ev = fx.evaluation_v(spark, sf).select("doc_id", F.col("relevancy").alias("score"))
    return penalise_copies(d.join(ev, "doc_id")).select("doc_id", "score")


@register("dedup_near")
def q_dedup_near(spark, sf):
    from quire.operators.scoring import near_copies
    return near_copies(_docs(spark, sf).select("doc_id", "text"))


@register("best_image")
def q_best_image(spark, sf):
    from quire.operators.pages import image_manifest
    from quire.operators.scoring import best_image
    imgs = image_manifest(fx.pages_img_v(spark, sf)).withColumn(
        "score", F.when(F.col("img_url").endswith(".png"), F.lit(2)).otherwise(F.lit(1)))
    return best_image(imgs).select("page_id", "img_url", "save_path")


@register("trailing_rate")
def q_trailing_rate(spark, sf):
    from quire.operators.scoring import trailing_rate
    from quire.sources.tables import read_table
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return trailing_rate(ev, window_s=86400, limit=3).select("event_id", "user_id", "n_in_window", "over_limit")


@register("conversation_history")
def q_conversation_history(spark, sf):
    from quire.operators.text import conversation_history
    from quire.sources.tables import read_table
    return conversation_history(read_table(spark, sf, "conversations"))


@register("turn_context")
def q_turn_context(spark, sf):
    from quire.operators.text import turn_context
    from quire.sources.tables import read_table
    return turn_context(read_table(spark, sf, "conversations"))


def block_stats(pdf):
    """A small vectorised scorer for the hook: words and full stops per block."""
    import pandas as pd
    return pd.DataFrame({"doc_id": pdf["doc_id"], "block_pos": pdf["block_pos"],
                         "n_words": pdf["block"].str.count(r"\S+").astype("int64"),
                         "n_stops": pdf["block"].str.count(r"\.").astype("int64")})


@register("scored_blocks")
def q_scored_blocks(spark, sf):
    from quire.operators.scoring import score_with
    from quire.operators.text import text_blocks
    blocks = text_blocks(_docs(spark, sf), max_chars=1000)
    return score_with(blocks, block_stats, schema="doc_id long, block_pos long, n_words long, n_stops long")


# ---- 2.14 digest ---------------------------------------------------------------------------
@register("category_color")
def q_category_color(spark, sf):
    from quire.operators.digest import category_color
    return fx.articles_v(spark, sf).select("pos", "category", category_color("category").alias("color"))


@register("articles_by_category")
def q_articles_by_category(spark, sf):
    from quire.operators.digest import category_of
    return fx.articles_v(spark, sf).groupBy("issue_id", category_of("category").alias("category")) \
        .agg(F.count(F.lit(1)).alias("n_articles"))


@register("article_html")
def q_article_html(spark, sf):
    from quire.operators.digest import article_html
    a = fx.articles_v(spark, sf)
    return a.select("pos", article_html(a).alias("html"))


def digest_articles(spark, sf):
    """The kept articles of each issue: top five by relevancy, stable on position."""
    from quire.operators.articles import top_k
    a = fx.articles_v(spark, sf)
    ev = fx.evaluation_v(spark, sf).select(F.col("doc_id").alias("pos"), "relevancy")
    return top_k(a.join(ev, "pos"), k=5, by="issue_id", pos="pos")


@register("category_section")
def q_category_section(spark, sf):
    from quire.operators.digest import category_sections
    return category_sections(digest_articles(spark, sf), by="issue_id", pos="top_rank")


@register("newsletter_html")
def q_newsletter_html(spark, sf):
    from quire.plans.newsletter import newsletter_issues
    return newsletter_issues(spark, sf)


@register("digest_html")
def q_digest_html(spark, sf):
    from quire.operators.digest import newsletter
    return newsletter(digest_articles(spark, sf), by="issue_id", pos="top_rank")


@register("repost_html")
def q_repost_html(spark, sf):
    from quire.operators.digest import repost
    return repost(digest_articles(spark, sf), by="issue_id", pos="top_rank", shared_by=F.col("issue_id"))


@register("outbox_rows")
def q_outbox_rows(spark, sf):
    from quire.plans.newsletter import newsletter_outbox
    return newsletter_outbox(spark, sf)


# ---- 2.5 news items --------------------------------------------------------------------------
@register("html_tokens")
def q_html_tokens(spark, sf):
    from quire.operators.news import html_tokens
    return html_tokens(fx.pages_news_v(spark, sf)).select("page_id", "pos", "kind", "tag", "text")


def _annotated(spark, sf):
    from quire.operators.news import annotated_tokens
    return annotated_tokens(fx.pages_news_v(spark, sf))


NEWS_COLS = ("page_id", "tier", "item_no", "title", "description", "link", "source", "category", "location",
             "contact", "requirements", "imageVideosLinks")


@register("news_tier1")
def q_news_tier1(spark, sf):
    from quire.operators.news import tier1
    return tier1(_annotated(spark, sf)).select(*NEWS_COLS)


@register("news_tier2")
def q_news_tier2(spark, sf):
    from quire.operators.news import tier2
    return tier2(_annotated(spark, sf)).select(*NEWS_COLS)


@register("news_tier3")
def q_news_tier3(spark, sf):
    from quire.operators.news import tier3
    return tier3(_annotated(spark, sf)).select(*NEWS_COLS)


@register("news_selected")
def q_news_selected(spark, sf):
    from quire.operators.news import selected_items
    return selected_items(fx.pages_posts_v(spark, sf), fx.SITE_SELECTORS).select(*NEWS_COLS)


@register("news_items")
def q_news_items(spark, sf):
    from quire.operators.news import news_items
    return news_items(fx.pages_news_v(spark, sf)).select(*NEWS_COLS)


@register("send_now_issue")
def q_send_now_issue(spark, sf):
    r = routed(spark, sf)
    cfg = mb.config_entries(checked(r).where(F.col("route") == mb.ROUTE_CONFIG)).where(F.col("_m").isNotNull())
    requests = cfg.where(F.lower(F.try_element_at("_m", F.lit("send_now"))) == "true") \
                  .select("mailbox_id", F.col("date").alias("as_of"))
    out = iss.send_now_issues(r, requests, setup(spark, sf, r))
    return out.select("mailbox_id", "release_ts", "msg_rank", "message_id")


@register("issue_carry_over")
def q_issue_carry_over(spark, sf):
    r = routed(spark, sf)
    out = iss.issue_carry_over(r, setup(spark, sf, r))
    return out.select("mailbox_id", "release_ts", "msg_rank", "message_id", "carried")


def _config_values(r: DataFrame) -> DataFrame:
    return mb.config_values(checked(r).where(F.col("route") == mb.ROUTE_CONFIG))


@register("setup_as_of")
def q_setup_as_of(spark, sf):
    r = routed(spark, sf)
    return iss.setup_as_of(r, _config_values(r)).select(
        "mailbox_id", "message_id", "active", F.array_join("days", ",").alias("days_str"), "release_time_str", "newsletter_email", "limit_newest")


@register("assign_issue_as_of")
def q_assign_issue_as_of(spark, sf):
    r = routed(spark, sf)
    return iss.assign_issue_as_of(r, _config_values(r)).select("mailbox_id", "message_id", "release_ts")


@register("issue_documents")
def q_issue_documents(spark, sf):
    """The mail table read as a stream; each issue that the watermark has passed, read back as documents.
    The setup is the folded one for the whole stream, so config mail is not applied."""
    from uuid import uuid4

    from quire.session import ensure_checkpoint_dir
    from quire.sources.tables import table_path
    from quire.streaming.issue_state import run_issue_documents
    from quire.streaming.mail import stream_messages
    st = setup(spark, sf)
    path = table_path(sf, "events")
    # as a pattern: a stream takes a plain path for a folder, and the table may be one file
    events = stream_messages(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema)
    mail = spark.sql(fx.MESSAGES_SQL, events=events)
    out = f"{ensure_checkpoint_dir(spark)}/issue-documents-{uuid4().hex}"
    run_issue_documents(mail, fx.whitelist_v(spark, sf), f"{out}/rows", checkpoint=f"{out}/stream", delay="1 day", setup=st,
                        config_mail=False).awaitTermination()
    schema = "mailbox_id int, release_ts timestamp, n_messages int, limit_newest int, message_ids array<string>"
    docs = spark.read.schema(schema).parquet(f"{out}/rows")
    return docs.select("mailbox_id", F.col("release_ts").cast("timestamp_ntz").alias("release_ts"), F.col("n_messages").cast("bigint").alias("n_messages"),
                       "limit_newest", F.array_join("message_ids", ",").alias("message_ids"))
