"""Views with the reference's data shapes, derived from the driver tables.

Each view exists twice with the same meaning: here as Spark SQL over DataFrames, and
in ``quire.plans.oracle`` as DuckDB SQL. Both read whole tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import read_table

# Config mails carry a JSON text built from the event row; every 50th one is not JSON.
# (Braces are doubled: the text goes through spark.sql's {name} formatting.)
CONFIG_TEXT_SQL = """
CASE WHEN event_id % 50 = 0 THEN concat('config ', CAST(event_id AS STRING))
     ELSE concat('{{"limit_newest": ', CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE 5 + user_id % 40 END AS STRING),
                 ', "active": ', CASE WHEN user_id % 23 = 0 THEN 'false' ELSE 'true' END,
                 ', "release_time_str": "', lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':00:00"',
                 ', "days": ', CASE user_id % 3 WHEN 0 THEN '["Monday","Friday"]'
                                              WHEN 1 THEN '["Wednesday","Saturday"]'
                                              ELSE '["Tuesday","Thursday","Sunday"]' END,
                 ', "send_now": ', CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END,
                 ', "newsletter_email": "', CASE WHEN user_id % 11 = 0 THEN ''
                                                 ELSE concat('news', CAST(user_id % 4 AS STRING), '@example.com') END, '"',
                 ', "k": ', CAST(event_id % 97 AS STRING), '}}') END
"""

MESSAGES_SQL = f"""
SELECT CAST(event_id AS STRING) AS message_id,
       CAST(event_id % 4 AS INT) AS mailbox_id,
       ts AS date,
       CASE WHEN user_id % 5 = 0 THEN concat('user', CAST(user_id AS STRING), '@example.com')
            ELSE concat('User ', CAST(user_id AS STRING), ' <user', CAST(user_id AS STRING), '@example.com>')
       END AS sender,
       CASE WHEN event_type = 'signup' THEN 'Config' ELSE event_type END AS title,
       CASE WHEN event_type = 'signup' THEN {CONFIG_TEXT_SQL} ELSE props END AS text,
       CASE event_type WHEN 'view' THEN array('INBOX', 'UNREAD')
                       WHEN 'click' THEN array('INBOX')
                       WHEN 'purchase' THEN array('INBOX', 'ANALYZED')
                       WHEN 'signup' THEN array('INBOX', 'STARRED')
                       ELSE array('SPAM') END AS labels
FROM {{events}}
"""


def messages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 parsed messages (without html), one per event."""
    return spark.sql(MESSAGES_SQL, events=read_table(spark, sf_dir, "events"))


def whitelist_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT concat('user', CAST(c_custkey AS STRING), '@example.com') AS addr "
        "FROM {customer} WHERE c_mktsegment = 'BUILDING'",
        customer=read_table(spark, sf_dir, "customer"))


def sender_setup_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setup rows ``(mailbox_id, whitelisted_senders)``: a mailbox trusts a quarter of the customers, one named twice
    or not at all in a row."""
    return spark.sql(
        """SELECT CAST(c_custkey % 4 AS INT) AS mailbox_id,
                  CASE c_custkey % 3 WHEN 0 THEN array(a, a) WHEN 1 THEN array(a, CAST(NULL AS STRING)) ELSE array(concat('no', a)) END AS whitelisted_senders
           FROM (SELECT c_custkey, concat('user', CAST(c_custkey AS STRING), '@example.com') AS a FROM {customer})""",
        customer=read_table(spark, sf_dir, "customer"))


def parts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened MIME leaves: one leaf per conversation turn; data is base64url."""
    return spark.sql(
        """SELECT CAST(conv_id AS STRING) AS message_id, turn AS path,
                  CASE role WHEN 'user' THEN 'text/plain' WHEN 'assistant' THEN 'text/html'
                            ELSE 'application/pdf' END AS mime_type,
                  translate(base64(encode(text, 'UTF-8')), '+/', '-_') AS data
           FROM {conversations}""",
        conversations=read_table(spark, sf_dir, "conversations"))


def links_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 'message' per document source, one link per document, in doc_id order.

    The link position is computed by the skew-safe position operator, so a source
    holding a third of all documents does not end up in one task.
    """
    from quire.operators.ordering import positions

    docs = read_table(spark, sf_dir, "documents").select(
        "source", "doc_id", "text")
    linked = docs.selectExpr("source AS message_id", "doc_id",
                             "concat('https://example.com/', CAST(doc_id AS STRING)) AS link")
    return positions(linked, by=["message_id"], order=["doc_id"], name="link_pos")


def scraped_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT concat('https://example.com/', CAST(doc_id AS STRING)) AS link, text AS scraped "
        "FROM {documents} WHERE doc_id % 3 <> 0",
        documents=read_table(spark, sf_dir, "documents"))


def evaluation_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat D9 evaluation rows; ties and NULL relevancy on purpose."""
    return spark.sql(
        """SELECT source AS message_id, doc_id, concat('ARTICLE_', CAST(doc_id AS STRING)) AS id,
                  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars % 101 AS INT) END AS relevancy
           FROM {documents}""",
        documents=read_table(spark, sf_dir, "documents"))


ARTICLES_SQL = r"""
SELECT doc_id AS pos, source AS issue_id, split_part(text, '\n', 1) AS title, source, 'Online' AS location,
       CASE WHEN doc_id % 4 = 0 THEN concat('c', CAST(doc_id AS STRING), '@example.com') END AS contact,
       text AS description, concat('A text of ', CAST(n_chars AS STRING), ' characters') AS summary,
       concat('https://example.com/', CAST(doc_id AS STRING)) AS link,
       CASE doc_id % 8 WHEN 0 THEN 'News' WHEN 1 THEN 'Talks' WHEN 2 THEN 'Events' WHEN 3 THEN 'Workshops'
                       WHEN 4 THEN 'Opportunity' WHEN 5 THEN 'Other' WHEN 6 THEN 'Podcast' END AS category
FROM {documents}
"""


#: Words that some texts get by their id: theme and category words, plurals, and near misses.
TOPICS = ("robot", "Cyber-physical", "digital twin", "user interface", "machine learning", "automated", "blockchain", "ethics",
          "research", "innovation", "talks", "Seminar", "conference", "fairs", "workshop", "hands-on", "job", "grants", "announced",
          "award", "talking", "reopened", "jobless", "cybernetic", "panelled", "ethnic", "call for papers", "fairly")


def topics(k: str) -> str:
    """SQL text of the words a row with the id ``k`` gets in front of its text."""
    words = "array(" + ", ".join(f"'{w}. '" for w in TOPICS) + ")"
    pick = lambda n: f"coalesce(get({words}, CAST({n} % 41 AS INT)), '')"
    return f"concat({pick(k)}, " + ", ".join(pick(f"({k} DIV {d})") for d in (41, 3, 5, 7)) + ")"


def topical_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts name themes and categories."""
    return spark.sql(f"SELECT doc_id, concat({topics('doc_id')}, text) AS text FROM {{documents}}",
                     documents=read_table(spark, sf_dir, "documents"))


def articles_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 digest articles; one unknown category and one NULL category on purpose."""
    return spark.sql(ARTICLES_SQL, documents=read_table(spark, sf_dir, "documents"))


def pages_img_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """SELECT page_id, url, replace(html, '<article>',
                  concat('<article><img src="/img/', CAST(page_id AS STRING),
                         '.png"><img alt="x"><img src=""><img src="/pix"><img alt="a>b" src="/p?a=1&amp;b=2">')) AS html
           FROM {pages}""",
        pages=read_table(spark, sf_dir, "pages"))


def pages_news_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id % 3: 0 keeps articles (tier 1), 1 has headings only (tier 2), 2 neither (tier 3)."""
    return spark.sql(
        """SELECT page_id, url,
                  CASE page_id % 3 WHEN 0 THEN html
                       WHEN 1 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
                       ELSE replace(replace(replace(replace(html, '<article>', '<section>'), '</article>', '</section>'),
                                            '<h1>', '<div>'), '</h1>', '</div>') END AS html
           FROM {pages}""",
        pages=read_table(spark, sf_dir, "pages"))


#: Selectors in the shape of a news site's config: class-only, tag with class, descendant steps.
SITE_SELECTORS = {"article": ".post", "title": "h2.entry-title", "link": "h2.entry-title a", "description": ".entry-content p"}


def pages_posts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with posts around their own text: page_id % 3: 0 a post before the page, 1 a post in a post, 2 the page's
    articles as posts. Some paragraphs stay open, some attributes hold a '>'."""
    return spark.sql(
        """SELECT page_id, url, CASE page_id % 3
                  WHEN 2 THEN replace(replace(html, '<article>', '<div class="post"><div class="entry-content">'), '</article>', '</div></div>')
                  ELSE concat('<div class="post hentry" id="p1"><h2 class=\\'entry-title big\\'><a href="/post/', page_id, '">Post <b>', page_id,
                              '</b></a></h2><a href="/no">other</a><div class="entry-content"><p>First of ', page_id,
                              '<p class=x>Second <i>part</i><div>no paragraph</div></div>',
                              CASE WHEN page_id % 3 = 1 THEN '<div class="post"><h2 class="entry-title"><a title="x>y" href="inner">Inner</a></h2></div>' ELSE '' END,
                              '<p>outside</p></div>', html, '<p class="post">tail <a href="#z">z</a>') END AS html
           FROM {pages}""",
        pages=read_table(spark, sf_dir, "pages"))


def headers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw header lists (D4): From, Subject, Date as RFC 2822 text; every 7th message has a
    second subject header (the last one wins); every 13th has a date that is not a date."""
    return spark.sql(
        """SELECT CAST(event_id AS STRING) AS message_id,
                  concat(array(named_struct('name', 'From', 'value',
                                  CASE WHEN user_id % 5 = 0 THEN concat('user', CAST(user_id AS STRING), '@example.com')
                                       ELSE concat('User ', CAST(user_id AS STRING), ' <user', CAST(user_id AS STRING),
                                                   '@example.com>') END),
                               named_struct('name', 'Subject', 'value', event_type),
                               named_struct('name', 'Date', 'value',
                                  CASE WHEN event_id % 13 = 0 THEN 'someday'
                                       ELSE concat(date_format(ts, 'EEE, d MMM yyyy HH:mm:ss'),
                                                   CASE user_id % 3 WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0200'
                                                                    ELSE ' GMT' END) END)),
                         CASE WHEN event_id % 7 = 0
                              THEN array(named_struct('name', 'SUBJECT', 'value', concat('Re: ', event_type)))
                              ELSE array() END) AS headers
           FROM {events}""",
        events=read_table(spark, sf_dir, "events"))


def changes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label changes for every third message: add names (some lower-case system names),
    remove some, and set the read flag for some. Every sixth message has a second change after it."""
    return spark.sql(
        """SELECT CAST(event_id % 4 AS INT) AS mailbox_id, CAST(event_id AS STRING) AS message_id,
                  CASE WHEN user_id % 2 = 0 THEN array('ANALYZED', 'starred') ELSE array('inbox') END AS add,
                  CASE WHEN user_id % 3 = 0 THEN array('INBOX', 'ANALYZED') ELSE array('Spam') END AS remove,
                  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS read, 0 AS seq
           FROM {events} WHERE event_id % 3 = 0
           UNION ALL
           SELECT CAST(event_id % 4 AS INT), CAST(event_id AS STRING), array('Inbox', 'later'), array('STARRED', 'ANALYZED'),
                  user_id % 2 = 1, 1
           FROM {events} WHERE event_id % 6 = 0""",
        events=read_table(spark, sf_dir, "events"))


def payload_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nested MIME payloads (D3) as JSON text, one per conversation: a multipart/mixed
    root whose first part is a multipart/alternative holding turns 0 and 1, then one
    leaf per later turn. Every fifth leaf carries an empty ``parts`` list."""
    from pyspark.sql import functions as F
    conv = read_table(spark, sf_dir, "conversations")
    leaf = F.concat(
        F.lit('{"mimeType":"'),
        F.expr("CASE role WHEN 'user' THEN 'text/plain' WHEN 'assistant' THEN 'text/html' ELSE 'application/pdf' END"),
        F.lit('","body":{"data":"'), F.expr("translate(base64(encode(text, 'UTF-8')), '+/', '-_')"), F.lit('"}'),
        F.when(F.col("turn") % 5 == 4, F.lit(',"parts":[]')).otherwise(F.lit("")), F.lit("}"))
    per = (conv.select(F.col("conv_id").cast("string").alias("message_id"), "turn", leaf.alias("leaf"))
               .groupBy("message_id")
               .agg(F.array_sort(F.collect_list(F.struct("turn", "leaf"))).alias("ls")))
    alt = F.concat(F.lit('{"mimeType":"multipart/alternative","parts":['),
                   F.array_join(F.transform(F.slice("ls", 1, 2), lambda x: x["leaf"]), ","), F.lit("]}"))
    rest = F.transform(F.filter("ls", lambda x, i: i >= 2), lambda x: x["leaf"])
    payload = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['),
                       F.array_join(F.concat(F.array(alt), rest), ","), F.lit("]}"))
    return per.select("message_id", payload.alias("payload"))


def msg_links_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each message: two pages picked by the sender's user id, then one link to a
    page that does not exist (so the left join meets a missing page)."""
    return spark.sql(
        """SELECT CAST(e.event_id AS STRING) AS message_id, CAST(e.pos AS BIGINT) AS link_pos,
                  coalesce(p.url, concat('https://missing.example.com/', CAST(e.event_id AS STRING))) AS link
           FROM (SELECT event_id, user_id, explode(array(0, 1, 2)) AS pos FROM {events}) e
           LEFT JOIN {pages} p ON p.page_id = CASE WHEN e.pos < 2 THEN e.user_id + 7 * e.pos END
           WHERE e.pos = 2 OR p.page_id IS NOT NULL""",
        events=read_table(spark, sf_dir, "events"), pages=read_table(spark, sf_dir, "pages").select("page_id", "url"))


#: Markup that a reader blind to quotes or to character references gets wrong.
QUOTED = """<article><a title="x>y" href="/q?a=1&amp;b=2&copy=3">quoted &gt; title</a> <!-- <a href="tel:1">no</a> --> <p data-x='">'>&#8217;&eacute;&#x41;&euro;&notit; &copy2024 &#128; &#x1F600; &bogus; &#xD800;|AT&T</p> <img alt="a>b" src="/i.png"><a href='TEL:5' title='>'>call <b>us</b></a>"""
QUOTED_SQL = "'" + QUOTED.replace("'", "\\'") + "'"


def pages_mixed_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages where some navigation links use system-action schemes (P7, H3): on every fourth
    page the links become ``tel:``, on every fifth ``MAILTO:`` (upper case), and on every
    sixth one anchor gets inner markup. Every seventh page gets tags with quoted ``>`` and character references."""
    return spark.sql(
        f"""SELECT page_id, url,
                  CASE WHEN page_id % 7 = 3 THEN replace(html, '<article>', {QUOTED_SQL})
                       ELSE html END AS html FROM (
            SELECT page_id, url,
                  CASE WHEN page_id % 4 = 0 THEN replace(html, '<li><a href="/', '<li><a href="tel:')
                       WHEN page_id % 5 = 0 THEN replace(html, '<li><a href="/', '<li><a href="MAILTO:')
                       WHEN page_id % 6 = 0 THEN replace(html, '<li><a href="/', '<li><a href="#')
                       ELSE html END AS html
           FROM {{pages}})""",
        pages=read_table(spark, sf_dir, "pages"))


def eval_json_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses (D9) as JSON text: the evaluation rows of a source in blocks of 16
    documents, one response per block. Every ninth block is not JSON, every eleventh
    has no ``news`` key."""
    from pyspark.sql import functions as F
    ev = evaluation_v(spark, sf_dir).withColumn("block", (F.col("doc_id") / 16).cast("bigint"))
    item = F.struct(F.col("id").alias("ID"), F.col("message_id").alias("source"),
                    F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("brief description"),
                    F.lit("fits the themes").alias("reasoning"), F.col("relevancy").alias("relevancy"))
    per = ev.groupBy("message_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", item.alias("it")))).alias("xs"))
    resp = F.to_json(F.struct(F.transform("xs", lambda x: x["it"]).alias("news")))
    return per.select("message_id", "block",
                      F.when(F.col("block") % 9 == 0, F.lit("nope"))
                       .when(F.col("block") % 11 == 0, F.lit('{"other": 1}'))
                       .otherwise(resp).alias("response"))


def corpus_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """links_v in one issue ('weekly'), with the message rank of each source in it."""
    from quire.operators.ordering import positions
    from pyspark.sql import functions as F
    lv = links_v(spark, sf_dir).withColumn("issue_id", F.lit("weekly"))
    msgs = lv.select("issue_id", "message_id").distinct()
    ranked = positions(msgs, by=["issue_id"], order=["message_id"], name="msg_rank")
    return lv.join(ranked, ["issue_id", "message_id"])
