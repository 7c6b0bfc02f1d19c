"""Inline edge rows (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions.text import mail_date, preview_words, safe_name
from quire.operators import articles as A
from quire.operators import digest as D
from quire.operators import mailbox as mb
from quire.operators import mime
from quire.operators import scoring as S
from quire.operators.issues import next_release
from quire.operators.pages import image_manifest
from quire.operators.text import text_blocks


def one(df, col):
    return [r[col] for r in df.collect()]


def test_mail_date(spark):
    df = spark.createDataFrame([("Mon, 1 Jan 2024 10:00:00 +0200",), ("1 Jan 2024 10:00:00 GMT",), (None,),
                                ("junk",), ("Tue, 2 Jan 2024 09:30:00 +0000 (UTC)",)], "d string")
    got = one(df.select(mail_date("d").cast("timestamp_ntz").alias("t")), "t")
    assert got == [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 10), None, None,
                   dt.datetime(2024, 1, 2, 9, 30)]


def test_header_last_wins(spark):
    df = spark.createDataFrame([([("Subject", "a"), ("subject", "b")],)], "h array<struct<name:string,value:string>>")
    assert one(df.select(F.element_at(mime.header_map("h"), F.lit("subject")).alias("s")), "s") == ["b"]


def test_mime_leaves_nested(spark):
    leaf = lambda m, d: '{"mimeType":"%s","body":{"data":"%s"}}' % (m, d)
    nested = ('{"mimeType":"multipart/mixed","parts":[{"mimeType":"multipart/alternative","parts":[%s,%s]},%s,'
              '{"mimeType":"text/plain","parts":[]},{"mimeType":"text/plain"}]}'
              % (leaf("text/plain", "YQ"), leaf("text/html", "Yg"), leaf("text/plain", "Yw")))
    single = leaf("text/plain", "4oKsgP8")
    df = spark.createDataFrame([("n", nested), ("s", single)], "message_id string, payload string")
    leaves = mime.decode_leaves(mime.mime_leaves(df))
    rows = {(r["message_id"], tuple(r["path"])): (r["mime_type"], r["text"]) for r in leaves.collect()}
    assert rows[("n", (0, 0))] == ("text/plain", "a")
    assert rows[("n", (0, 1))] == ("text/html", "b")
    assert rows[("n", (1,))] == ("text/plain", "c")
    assert rows[("n", (2,))] == ("text/plain", None)   # empty parts list is a leaf
    assert rows[("n", (3,))] == ("text/plain", None)   # leaf without data
    assert rows[("s", ())] == ("text/plain", "€��")
    b = {r["message_id"]: (r["plain"], r["html"]) for r in mime.bodies(leaves).collect()}
    assert b["n"] == ("ac", "b")


def test_mime_depth_has_no_limit(spark):
    node = '{"mimeType":"text/plain","body":{"data":"YQ"}}'
    for _ in range(30):
        node = '{"mimeType":"multipart/mixed","parts":[%s]}' % node
    df = spark.createDataFrame([("d", node)], "message_id string, payload string")
    assert mime.bodies(mime.decode_leaves(mime.mime_leaves(df))).first()["plain"] == "a"


def test_link_filter(spark):
    html = ('<a href="MAILTO:x">1</a><a href="javascript:void(0)">2</a><a href="#">3</a><a href=" ">4</a>'
            '<a href="">5</a><a href="#top">6</a><a href=" mailto:x">7</a><a href="/d">8</a><a href="/d">9</a>')
    df = spark.createDataFrame([(html,)], "html string")
    assert one(df.select(H.filtered_links("html").alias("l")), "l")[0] == ["#top", " mailto:x", "/d", "/d"]


def test_safe_name(spark):
    df = spark.createDataFrame([('a/b:c*?"<>|\\',), ("x" * 300,)], "s string")
    got = one(df.select(safe_name("s").alias("n")), "n")
    assert got[0] == "a_b_c_______" and len(got[1]) == 255


def test_noscript_and_title(spark):
    html = "<html><head><title>T</title></head><body><noscript>N</noscript><p>B</p></body></html>"
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(H.page_text_lines("html").alias("a"), H.page_text_flat("html").alias("b")).collect()[0]
    assert r["a"] == "T\nB" and r["b"] == "N B"


def test_neutralise(spark):
    df = spark.createDataFrame([('<p>x</p><a href="tel:1">a <b>b</b>c</a><p>y</p>',)], "html string")
    r = df.select(H.page_text_lines("html").alias("t"), H.problem_link_count("html").alias("n")).collect()[0]
    assert r["t"] == "x\na bc\ny" and r["n"] == 1


def test_image_manifest_rules(spark):
    html = '<img src="/a/p.png"><img alt="x"><img src=""><img src="/pix"><img src="/b/p.png">'
    df = spark.createDataFrame([(1, "http://h/x/y", html)], "page_id long, url string, html string")
    got = {r["save_path"]: r["img_url"] for r in image_manifest(df).collect()}
    assert got == {"images/newsletter/http___h_x_y/p.png": "http://h/b/p.png",
                   "images/newsletter/http___h_x_y/image_3.jpg": "http://h/pix"}


def test_date_range_end_inclusive(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 14, 23, 59, 59, 999999),), (dt.datetime(2024, 1, 15),)],
                               "date timestamp_ntz")
    assert df.where(mb.date_range(df, "2024-01-08", "2024-01-14")).count() == 1


def _msgs(spark):
    rows = [(0, str(i), dt.datetime(2024, 1, 1 + i), ["INBOX"] + (["UNREAD"] if i % 2 else [])) for i in range(10)]
    return spark.createDataFrame(rows, "mailbox_id int, message_id string, date timestamp_ntz, labels array<string>")


def test_labels_unknown(spark):
    m = _msgs(spark)
    reg = spark.createDataFrame([(0, "Work", "L1")], "mailbox_id int, name string, label_id string")
    assert mb.mailbox_query(m, archived=2, include=["nope"], registry=reg, max_results=None).count() == 0
    assert mb.mailbox_query(m, archived=2, exclude=["nope"], registry=reg, max_results=None).count() == 10
    assert mb.mailbox_query(m, archived=2, include=["unread"], max_results=None).count() == 5


def test_newest_n(spark):
    m = _msgs(spark)
    assert mb.mailbox_query(m, archived=2, newest=0).count() == 0
    assert mb.mailbox_query(m, archived=2, newest=150, max_results=4).count() == 4
    assert one(mb.newest_n(m, 2).orderBy("message_id"), "message_id") == ["8", "9"]


def test_top_k_ties_and_late_join(spark):
    ev = spark.createDataFrame([("i", "A1", 5, 0), ("i", "A2", None, 1), ("i", "A3", 5, 2), ("i", "ZZ", 9, 3)],
                               "issue_id string, ID string, relevancy int, resp_pos long")
    top = A.top_k(ev, k=3)
    assert one(top.orderBy("top_rank"), "ID") == ["ZZ", "A1", "A3"]
    arts = spark.createDataFrame([("i", "A1"), ("i", "A3")], "issue_id string, article_id string")
    assert sorted(one(A.top_articles(ev, arts, k=3), "ID")) == ["A1", "A3"]   # unknown id dropped after the limit


def test_parse_response(spark):
    df = spark.createDataFrame([("nope",), ('{"x": 1}',),
                                ('{"news":[{"ID":"A","brief description":"d","relevancy":3}]}',)], "response string")
    rows = A.parse_response(df).collect()
    assert len(rows) == 1 and rows[0]["brief description"] == "d" and rows[0]["resp_pos"] == 0


def test_config_fold_oldest_in_poll_wins(spark):
    rows = [(0, "a", dt.datetime(2024, 1, 1, 9), '{"limit_newest": "5", "zzz": "1"}'),
            (0, "b", dt.datetime(2024, 1, 1, 10), '{"limit_newest": "7"}'),
            (0, "c", dt.datetime(2024, 1, 1, 11), "not json")]
    df = spark.createDataFrame(rows, "mailbox_id int, message_id string, date timestamp_ntz, text string")
    got = {(r["key"], r["value"]) for r in mb.config_fold(df, poll=F.lit(1)).collect()}
    assert got == {("limit_newest", "5")}
    assert mb.config_entries(df).where("error IS NOT NULL").count() == 1


def test_next_release_edges(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),)], "t timestamp_ntz")  # a Monday, noon
    def rel(days, at="12:00:00", active=True):
        arr = F.array(*[F.lit(d) for d in days]).cast("array<string>")
        return one(df.select(next_release("t", arr, F.lit(at), active).alias("r")), "r")[0]
    assert rel(["Monday", "Wednesday"]) == dt.datetime(2024, 1, 3, 12)
    assert rel(["Monday"]) == dt.datetime(2024, 1, 8, 12)
    assert rel([]) is None
    assert rel(["Monday"], active=False) is None


def test_label_update_rules(spark):
    m = spark.createDataFrame([(0, "1", ["INBOX", "UNREAD"])], "mailbox_id int, message_id string, labels array<string>")
    ch = spark.createDataFrame([(0, "1", ["inbox", "X"], ["X"], True)],
                               "mailbox_id int, message_id string, add array<string>, remove array<string>, read boolean")
    once = mb.update_labels(m, ch)
    assert sorted(one(once, "labels")[0]) == ["INBOX", "X"]
    twice = mb.update_labels(once, ch)
    assert sorted(one(twice, "labels")[0]) == ["INBOX", "X"]


def test_trailing_rate_edge(spark):
    rows = [(1, 7, dt.datetime(2024, 1, 1, 0, 0, 0)), (2, 7, dt.datetime(2024, 1, 1, 0, 1, 0)),
            (3, 7, dt.datetime(2024, 1, 1, 0, 0, 30))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["n_in_window"] for r in S.trailing_rate(df, window_s=60, limit=1).collect()}
    assert got == {1: 1, 3: 2, 2: 2}   # the entry exactly one window old is not counted


def test_blocks_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "abcdef"), (3, "a😀b.cd")], "doc_id long, text string")
    got = {(r["doc_id"], r["block_pos"]): r["block"] for r in text_blocks(df, max_chars=3).collect()}
    assert got == {(1, 0): "", (2, 0): "abc", (2, 1): "def", (3, 0): "a😀b", (3, 1): ".cd"}


def test_article_html_rules(spark):
    df = spark.createDataFrame([("AI", None, "http://i")], "category string, contact string, image string")
    df = df.select("*", *[F.lit(x).alias(x) for x in ("title", "source", "location", "description", "summary",
                                                      "link")])
    html = one(df.select(D.article_html(df).alias("h")), "h")[0]
    assert D.CATEGORY_COLORS["Other"] in html and "<dt>Ask</dt>" not in html and "<img" not in html
    html2 = one(df.select(D.article_html(df, skip_images=False).alias("h")), "h")[0]
    assert 'src="http://i"' in html2


def test_article_with_missing_fields_keeps_its_card(spark):
    df = spark.createDataFrame([("T", None, None)], "title string, link string, summary string")
    html = one(df.select(D.article_html(df).alias("h")), "h")[0]
    assert html is not None and "T" in html


def test_news_tiers(spark):
    from quire.operators.news import news_items
    page2 = ('<html><body><section><h2>Heading one</h2><div><a href="/x">go</a></div></section>'
             '<p>first</p><p>second</p></body></html>')
    page3 = '<html><body><a href="/a">ten chars!</a><a href="/b">eleven char</a></body></html>'
    df = spark.createDataFrame([(1, "http://h/", page2), (2, "http://h/", page3)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in news_items(df).collect()}
    assert got[1]["tier"] == 2 and got[1]["link"] == "http://h/x" and got[1]["description"] == "first"
    assert got[2]["tier"] == 3 and got[2]["title"] == "eleven char"


def test_preview_words(spark):
    df = spark.createDataFrame([("  a  b\tc\nd e f ",)], "t string")
    assert one(df.select(preview_words("t").alias("p")), "p") == ["a b c d e"]


def test_issue_membership_edges(spark):
    from quire.operators import issues as iss
    # release every Wednesday 12:00; 2024-01-10 is a Wednesday
    setup = spark.createDataFrame([(0, True, ["Wednesday"], "12:00:00", 2)],
                                  "mailbox_id int, active boolean, days array<string>, release_time_str string, limit_newest int")
    rows = [("a", dt.datetime(2024, 1, 9, 8), ["INBOX"], "not_whitelisted"),    # in: not whitelisted is kept
            ("b", dt.datetime(2024, 1, 9, 9), ["INBOX"], "repost"),              # out: a whitelisted repost
            ("c", dt.datetime(2024, 1, 8, 9), [], "not_whitelisted"),            # out: archived
            ("d", dt.datetime(2024, 1, 9, 10), ["INBOX", "ANALYZED"], "not_whitelisted"),  # out: analysed
            ("e", dt.datetime(2024, 1, 10, 11), ["INBOX"], "not_whitelisted"),   # in: same day, before the release
            ("f", dt.datetime(2024, 1, 10, 12), ["INBOX"], "not_whitelisted"),   # next issue: exactly at release time
            ("g", dt.datetime(2024, 1, 4, 9), ["INBOX"], "not_whitelisted")]     # earlier issue (2024-01-10 window starts 01-03)
    m = spark.createDataFrame([(0,) + r for r in rows],
                              "mailbox_id int, message_id string, date timestamp_ntz, labels array<string>, route string")
    got = {r["message_id"]: r["release_ts"] for r in iss.issue_messages(m, setup, routes=m).collect()}
    assert got["a"] == got["e"] == dt.datetime(2024, 1, 10, 12)
    assert got["f"] == dt.datetime(2024, 1, 17, 12)
    assert "b" not in got and "c" not in got and "d" not in got
    # newest two per issue: a, e and g fall in the same issue; g is the oldest and drops out
    assert "g" not in got


def test_attach_pages_one_row_per_url(spark):
    links = spark.createDataFrame([("m", 0, "u1"), ("m", 1, "u2")], "message_id string, link_pos long, link string")
    pages = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2)], "link string, scraped string, t int")
    got = {r["link"]: (r["scraped"], r["scraped_ok"]) for r in A.attach_pages(links, pages, fetched="t").collect()}
    assert got == {"u1": ("new", True), "u2": (A.FAILED_SCRAPE, False)}


def test_bare_href_counts_as_empty(spark):
    df = spark.createDataFrame([('<a href>x</a><a name="n">y</a><a href="/z">z</a>',)], "html string")
    r = df.select(H.raw_links("html").alias("raw"), H.filtered_links("html").alias("kept")).collect()[0]
    assert list(r["raw"]) == ["", "/z"] and list(r["kept"]) == ["/z"]


def test_scoring_fixture_means_something(spark):
    """Every theme and category occurs, scores differ, and the kept articles are not the first ones."""
    from conftest import MID, SMALL
    from quire.operators.scoring import CATEGORIES, THEMES, _any_contains, classify, relevancy_score
    from quire.plans.newsletter import ISSUE, kept_articles, scored_articles
    from quire.sources import fixtures as fx
    v = fx.topical_v(spark, MID)
    low = F.lower("text")
    seen = v.select(*[F.max(_any_contains(low, kws)).alias(f"t{i}") for i, (_, kws) in enumerate(THEMES)]).first()
    assert all(seen)
    rows = v.select(relevancy_score("text").alias("s"), classify("text").alias("c")).collect()
    assert {r["c"] for r in rows} == set(CATEGORIES) and len({r["s"] for r in rows}) > 4
    near = spark.createDataFrame([("the talking panelled reopened fairly jobless",)], "text string").select(classify("text").alias("c"))
    assert near.first()["c"] == "Other"
    kept = {(r[0], r[1], r["link"]) for r in kept_articles(spark, SMALL).select(*ISSUE, "link").collect()}
    first = {(r[0], r[1], r["link"]) for r in scored_articles(spark, SMALL).where("article_n < 5").select(*ISSUE, "link").collect()}
    assert kept != first
