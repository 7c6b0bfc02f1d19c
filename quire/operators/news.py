"""News items from listing pages (N0-N5, S5): a token table and three fallback tiers.

N0 tokenises each page into ``(page_id, pos, kind, tag, text)`` rows (``posexplode`` of
one regex) and derives element membership with running sums over the page's tokens
(``Window.partitionBy(page_id).orderBy(pos)``; one page is one bounded group):

* inside an element ``x``: running opens minus closes of ``x`` is positive;
* inside a paragraph: the last paragraph event is an open ``<p>``; a ``</p>``, or the
  start or end of a block element, ends it (pages often leave ``<p>`` open);
* block depth: running opens minus closes of block containers (for a heading's parent).

Tier 1 groups by the article element, tier 2 by heading, tier 3 by anchor. Tier 2 is
used for a page only when tier 1 found nothing there, tier 3 only when both did not.
Bare tag selectors take the flags above, where nested elements of the same tag count as one; with classes, ids or
descendant steps tier 1 is ``selected_items``, where every matched element is an item.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H

# ---- fixed values ---------------------------------------------------------------------
DEFAULT_SELECTORS = {"article": "article", "title": "h2", "link": "a", "description": "p"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section",
              "table", "ul", "li", "body", "html")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NEWS_CATEGORY = "News"
MIN_LINK_TITLE = 10
TASK_CHARS = 8_000_000                     # HTML that one task of selected_items takes
# ---------------------------------------------------------------------------------------

TOKEN_RE = rf"{H.TAG_RE}|[^<]+|<"


def html_tokens(pages: DataFrame, *, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per tag or text run, in document order."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(html), H.COMMENT_RE, ""), H.DECL_RE, ""),
                             H._blocks_re(("script", "style")), "")
    toks = pages.select(key, url, F.posexplode(F.regexp_extract_all(clean, F.lit(TOKEN_RE), 0)).alias("pos", "tok"))
    tag = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    kind = F.when(F.col("tok").startswith("</"), F.lit("close")) \
            .when(F.col("tok").rlike(r"^<[A-Za-z]"), F.lit("open")).otherwise(F.lit("text"))
    return toks.select(key, url, F.col("pos").cast("bigint"), kind.alias("kind"), tag.alias("tag"), "tok",
                       F.when(kind == "text", H.ustrip(H.unescape("tok"))).alias("text"))


def _inside(w, cond_open: Column, cond_close: Column) -> Column:
    """Running open-minus-close count including the current token (opens count at their own row)."""
    return F.sum(F.when(cond_open, 1).when(cond_close, -1).otherwise(0)).over(w)


def annotate(tokens: DataFrame, selectors: dict | None = None, *, key: str = "page_id") -> DataFrame:
    """Element membership flags for every token."""
    given = {k: v.lower() for k, v in (selectors or {}).items() if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", v)}
    s = {**DEFAULT_SELECTORS, **given}
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t, tok, kind = F.col("tag"), F.col("tok"), F.col("kind")
    opn, cls = kind == "open", kind == "close"
    out = tokens.withColumn("in_article", _inside(w, opn & (t == s["article"]), cls & (t == s["article"]))) \
        .withColumn("article_no", F.sum(F.when(opn & (t == s["article"]), 1).otherwise(0)).over(w)) \
        .withColumn("in_title", _inside(w, opn & (t == s["title"]), cls & (t == s["title"]))) \
        .withColumn("in_a", _inside(w, opn & (t == "a"), cls & (t == "a"))) \
        .withColumn("heading_no", F.sum(F.when(opn & t.isin(*HEADINGS), 1).otherwise(0)).over(w)) \
        .withColumn("in_heading", _inside(w, opn & t.isin(*HEADINGS), cls & t.isin(*HEADINGS))) \
        .withColumn("anchor_no", F.sum(F.when(opn & (t == "a"), 1).otherwise(0)).over(w)) \
        .withColumn("depth", _inside(w, opn & t.isin(*BLOCK_TAGS) & (t != "hr"), cls & t.isin(*BLOCK_TAGS)))
    desc_tag = s["description"]
    p_event = F.when(opn & (t == desc_tag), F.lit(1)).when(cls & (t == desc_tag), F.lit(0)) \
               .when((opn | cls) & t.isin(*BLOCK_TAGS), F.lit(0))
    out = out.withColumn("in_desc", F.coalesce(F.last(p_event, ignorenulls=True).over(w), F.lit(0)) == 1)
    out = out.withColumn("p_no", F.sum(F.when(opn & (t == desc_tag), 1).otherwise(0)).over(w))
    href = H._value(tok, "href")
    return out.withColumn("href", F.when(opn & (t == "a"), href))


def _items(df: DataFrame, tier: int) -> DataFrame:
    return df.select("page_id", F.lit(tier).alias("tier"), F.col("item_no").cast("bigint"),
                     F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"),
                     F.coalesce("link", F.lit("")).alias("link"), F.col("url").alias("source"),
                     F.lit(NEWS_CATEGORY).alias("category"), F.lit("").alias("location"), F.lit("").alias("contact"),
                     F.lit("").alias("requirements"), F.lit("").alias("imageVideosLinks"))


def _ordered_text(cond: Column) -> Column:
    item = F.when(cond & (F.col("kind") == "text") & (F.col("text") != ""), F.struct("pos", "text"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ")


def tier1(ann: DataFrame, selectors: dict | None = None) -> DataFrame:
    """Per article element: title under the title tag, first link, paragraph texts."""
    link_tag = {**DEFAULT_SELECTORS, **(selectors or {})}["link"].lower()
    a = ann.where(F.col("in_article") > 0)
    g = a.groupBy("page_id", "url", F.col("article_no").alias("item_no")).agg(
        _ordered_text(F.col("in_title") > 0).alias("title"),
        _ordered_text(F.col("in_desc")).alias("description"),
        F.min_by("href", F.when((F.col("tag") == link_tag) & F.col("href").isNotNull(), F.col("pos"))).alias("_href"))
    g = g.withColumn("link", F.when(F.col("_href").isNotNull(), H.url_resolve(F.col("url"), F.col("_href"))))
    return _items(g.where((F.col("title") != "") | (F.col("description") != "")), 1)


def chain(selector: str) -> list[tuple[str | None, tuple[str, ...], str | None]]:
    """A selector as its steps from the outside in: ``(tag, classes, id)``, each a descendant of the one before.
    Tag, ``.class`` (several) and ``#id`` are known; other combinators and pseudo-classes are an error."""
    steps = []
    for part in selector.split():
        m = re.fullmatch(r"([A-Za-z][A-Za-z0-9-]*|\*)?((?:[.#][A-Za-z_][\w-]*)*)", part)
        if not m:
            raise ValueError(f"selector step {part!r} is not tag, .class or #id")
        marks = re.findall(r"([.#])([\w-]+)", m[2])
        ids = [v for k, v in marks if k == "#"]
        tag = (m[1] or "").lower()
        steps.append((tag if tag not in ("", "*") else None, tuple(v for k, v in marks if k == "."), ids[0] if ids else None))
    if not steps:
        raise ValueError("empty selector")
    return steps


def _matches(step: tuple) -> Column:
    tag, classes, ident = step
    cond = (F.col("kind") == "open") & ~F.col("tag").isin(*VOID_TAGS)
    if tag is not None:
        cond &= F.col("tag") == tag
    own = F.split(F.coalesce(H._value(F.col("tok"), "class"), F.lit("")), r"[ \t\n\f\r]+")
    for c in classes:
        cond &= F.array_contains(own, c)
    return cond if ident is None else cond & (F.coalesce(H._value(F.col("tok"), "id"), F.lit("")) == ident)


def _paragraph_event() -> Column:
    """A row that ends an open paragraph: its end tag, the next one, or a block tag."""
    t = F.col("tag")
    return (F.col("kind") != "text") & ((t == "p") | t.isin(*BLOCK_TAGS))


def _follow(t: DataFrame, chains: dict, flag: dict, text: tuple[str, ...]) -> DataFrame:
    """Follow all chains through the tokens, one step of every chain at a time; steps that chains begin with alike are
    followed once. Adds ``_own_<name>`` for every chain: where the outermost matched step of a match opens, at the open tag
    of the match, and for the names in ``text`` ``_head_<name>``: the same of the innermost match around a token (null: the
    token is in no match). ``_end``: where the element that a tag opens ends (null: with the page).

    Every window order costs a sort of the task's rows, so windows of one order stand together."""
    page = Window.partitionBy("page_id").orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("page_id", "tag", "_lvl").orderBy("pos")
    same_tag = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_p, is_close = F.col("tag") == "p", F.col("kind") == "close"
    opens = F.when(F.col("kind") == "open", 1).when(is_close, -1).otherwise(0)
    t = t.withColumn("_lvl", F.sum(opens).over(same_tag) + F.when(is_close, 1).otherwise(0))
    t = t.withColumn("_pp", F.when(_paragraph_event(), F.col("pos")))
    paths = {name: [tuple(steps[:d]) for d in range(1, len(steps) + 1)] for name, steps in chains.items()}
    number = {x: i for i, x in enumerate(dict.fromkeys(x for xs in paths.values() for x in xs))}
    spread = {x for name, xs in paths.items() for x in (xs if name in text else xs[:-1])}      # what lies inside is asked for
    for depth in range(1, max(map(len, chains.values())) + 1):
        now = {x: i for x, i in number.items() if len(x) == depth}
        boxes = [i for x, i in now.items() if x in spread and x[-1][0] != "p"]
        pars = [i for x, i in now.items() if x in spread and x[-1][0] in (None, "p")]
        t = t.withColumns({f"_own{i}": F.when(F.col(flag[x[-1]]), F.col("pos") if depth == 1 else F.col(f"_at{number[x[:-1]]}"))
                           for x, i in now.items()})
        # any match but a paragraph ends at the end tag whose partner, the event before it of the same tag and level, it is
        cols = {f"_shut{i}": is_close & ~is_p & F.lag(f"_own{i}").over(same).isNotNull() for i in boxes}
        if depth == 1:
            cols["_end"] = F.when(F.lead("kind").over(same) == "close", F.lead("pos").over(same))
        t = t.withColumns(cols) if cols else t
        # the open paragraph, of which there is one at most: each paragraph event ends it
        cols = {f"_par{i}": F.last(F.when(_paragraph_event(), F.struct(F.when(is_p, F.col(f"_own{i}")).alias("own"))), ignorenulls=True)
                .over(so_far)["own"] for i in pars}
        cols |= {f"_in{i}": F.sum(F.when(~is_p & F.col(f"_own{i}").isNotNull(), 1).when(F.col(f"_shut{i}"), -1).otherwise(0)).over(so_far)
                 for i in boxes}
        if depth == 1:
            cols["_end"] = F.when(is_p, F.expr("lead(_pp) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)")).otherwise(F.col("_end"))
        t = t.withColumns(cols).drop("_pp", *[f"_shut{i}" for i in boxes]) if cols else t
        # rows of one nesting count lie in the match that last opened at that count
        for i in boxes:
            level = Window.partitionBy("page_id", f"_in{i}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
            inner = F.last(F.when(~is_p, F.col(f"_own{i}")), ignorenulls=True).over(level)
            t = t.withColumn(f"_box{i}", F.when(F.col(f"_in{i}") > 0, inner)).drop(f"_in{i}")
        none = F.lit(None).cast("bigint")
        box = {i: F.col(f"_box{i}") if i in boxes else none for i in now.values()}
        par = {i: F.col(f"_par{i}") if i in pars else none for i in now.values()}
        # strictly inside: the match that a tag itself opens does not count, nor a paragraph that it ends
        onward = {number[x[:depth]] for x in number if len(x) == depth + 1}
        t = t.withColumns({f"_head_{name}": F.greatest(box[now[xs[-1]]], par[now[xs[-1]]]) for name, xs in paths.items()
                           if name in text and len(xs) == depth}
                          | {f"_own_{name}": F.col(f"_own{now[xs[-1]]}") for name, xs in paths.items() if len(xs) == depth}
                          | {f"_at{i}": F.greatest(F.lag(box[i]).over(page) if i in boxes else none, F.when(~is_p, par[i])) for i in onward})
        gone = [f"_at{number[x]}" for x in number if len(x) == depth - 1]
        t = t.drop(*gone, *[f"{c}{i}" for i in now.values() for c in ("_own", "_box", "_par")])
    return t.drop("_lvl")


def selected_items(pages: DataFrame, selectors: dict | None = None) -> DataFrame:
    """N1 for any chain of descendant steps (``.post``, ``h2.entry-title a``, ``.entry-content p``): one item per element
    that the article selector matches, nested ones included, with the texts and the first link that the other selectors
    match inside it (or at it). Rows: the news columns, ``tier`` 1, ``item_no`` from 1 in page order.

    Pages are dealt by ``page_id`` before they are cut into tokens, so every window below runs where the page is; tokens
    are not shuffled. They are dealt to as many tasks as their length asks for (``TASK_CHARS`` of HTML each), since each
    window order holds a task's tokens in memory: a task stays that size however many pages there are. An element spans
    from its tag to the end tag of the same name and level (to the page's end where there is none), a paragraph to the
    next paragraph or block tag. Items are made in arrays of the page's row, which hold the matched texts only. A null
    page has no items."""
    s = {**DEFAULT_SELECTORS, **(selectors or {})}
    chains = {name: chain(s[name]) for name in ("article", "title", "link", "description")}
    chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    t = html_tokens(pages.repartition(tasks, "page_id")).where((F.col("kind") != "text") | (F.col("text") != ""))
    flag = {step: f"_m{i}" for i, step in enumerate(dict.fromkeys(step for steps in chains.values() for step in steps))}
    t = t.select("page_id", "url", "pos", "kind", "tag", "text", *[_matches(step).alias(c) for step, c in flag.items()],
                 F.when(_matches(chains["link"][-1]), H._value(F.col("tok"), "href")).alias("_link"))
    t = _follow(t, chains, flag, ("title", "description"))
    t = t.withColumn("_end", F.coalesce("_end", F.lit(1 << 62)))
    spoken = F.col("kind") == "text"
    linked = F.col("_own_link").isNotNull() & F.col("_link").isNotNull()

    def kept(cond: Column, head: str, value: str) -> Column:
        return F.array_sort(F.collect_list(F.when(cond & F.col(head).isNotNull(), F.struct("pos", F.col(head).alias("head"), F.col(value).alias("v")))))
    used = F.col("_own_article").isNotNull() | linked | (spoken & F.coalesce("_head_title", "_head_description").isNotNull())
    page = t.where(used).groupBy("page_id", "url").agg(
        F.array_sort(F.collect_list(F.when(F.col("_own_article").isNotNull(), F.struct("pos", F.col("_end").alias("end"))))).alias("_arts"),
        kept(spoken, "_head_title", "text").alias("_titles"), kept(spoken, "_head_description", "text").alias("_descs"),
        kept(linked, "_own_link", "_link").alias("_links"))
    item = page.select("page_id", "url", "_titles", "_descs", "_links", F.posexplode("_arts").alias("_no", "_a"))

    def inside(found: str) -> Column:
        return F.transform(F.filter(found, lambda x: (x["head"] >= F.col("_a.pos")) & (x["pos"] < F.col("_a.end"))), lambda x: x["v"])
    item = item.select("page_id", "url", (F.col("_no") + 1).alias("item_no"), F.array_join(inside("_titles"), " ").alias("title"),
                       F.array_join(inside("_descs"), " ").alias("description"), F.get(inside("_links"), F.lit(0)).alias("_href"))
    item = item.withColumn("link", F.when(F.coalesce("_href", F.lit("")) != "", H.url_resolve(F.col("url"), F.col("_href"))))
    return _items(item.where((F.col("title") != "") | (F.col("description") != "")), 1)


def tier2(ann: DataFrame) -> DataFrame:
    """Per heading: its text, a link inside it or else under its parent, and the first
    paragraph after it.

    No pairwise joins: the parent of a heading at block depth ``d`` is the last block
    opened at depth ``d-1`` before it (a window over block opens keyed by depth), it ends
    at the first block close back at depth ``d-2`` after the heading, and its first link is
    found by placing a marker row at the parent's start in the page's token order and
    taking the first link at or after it (``first(..., ignorenulls)`` over the following
    rows)."""
    heads = ann.where(F.col("in_heading") > 0).groupBy("page_id", "url", F.col("heading_no").alias("item_no")).agg(
        _ordered_text(F.lit(True)).alias("title"),
        F.min_by("href", F.when(F.col("href").isNotNull(), F.col("pos"))).alias("_own"),
        F.min("pos").alias("_start"), F.max("pos").alias("_end"))
    opens = ann.where((F.col("kind") == "open") & F.col("tag").isin(*HEADINGS)) \
               .select("page_id", F.col("heading_no").alias("item_no"), (F.col("depth") - 1).alias("_d"))
    heads = heads.join(opens, ["page_id", "item_no"])
    blocks = ann.where(F.col("tag").isin(*BLOCK_TAGS) & (F.col("kind") != "text"))
    # parent start: events keyed by (page, depth): block opens at their depth, heading starts at d-1
    ev_open = blocks.where(F.col("kind") == "open").select(
        "page_id", F.col("depth").alias("_k"), F.col("pos").alias("_p"), F.col("pos").alias("_bo"),
        F.lit(None).cast("bigint").alias("item_no"))
    ev_head = heads.select("page_id", F.col("_d").alias("_k"), F.col("_start").alias("_p"),
                           F.lit(None).cast("bigint").alias("_bo"), "item_no")
    w_back = Window.partitionBy("page_id", "_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    par_s = ev_open.unionByName(ev_head).withColumn("_ps", F.last("_bo", ignorenulls=True).over(w_back)) \
                   .where(F.col("item_no").isNotNull()).select("page_id", "item_no", "_ps")
    # parent end: block closes at their depth after closing, heading ends at d-1 - 1
    ev_close = blocks.where(F.col("kind") == "close").select(
        "page_id", F.col("depth").alias("_k"), F.col("pos").alias("_p"), F.col("pos").alias("_bc"),
        F.lit(None).cast("bigint").alias("item_no"))
    ev_end = heads.select("page_id", (F.col("_d") - 1).alias("_k"), F.col("_end").alias("_p"),
                          F.lit(None).cast("bigint").alias("_bc"), "item_no")
    w_fwd = Window.partitionBy("page_id", "_k").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    par_e = ev_close.unionByName(ev_end).withColumn("_pe", F.first("_bc", ignorenulls=True).over(w_fwd)) \
                    .where(F.col("item_no").isNotNull()).select("page_id", "item_no", "_pe")
    # one small row per heading, read by the three lookups below: written once
    spans = heads.join(par_s, ["page_id", "item_no"], "left").join(par_e, ["page_id", "item_no"], "left") \
                 .checkpoint(eager=True)
    heads = spans
    # first link at or after the parent start, in one ordered pass per page
    ev_link = ann.where(F.col("href").isNotNull()).select(
        "page_id", F.col("pos").cast("double").alias("_p"), F.col("pos").alias("_lp"), F.col("href").alias("_h"),
        F.lit(None).cast("bigint").alias("item_no"))
    ev_mark = spans.select("page_id", (F.coalesce("_ps", F.lit(-1)) - 0.5).alias("_p"),
                           F.lit(None).cast("bigint").alias("_lp"), F.lit(None).cast("string").alias("_h"), "item_no")
    w_page = Window.partitionBy("page_id").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("_lp").isNotNull(), F.struct("_lp", "_h")), ignorenulls=True).over(w_page)
    par_link = ev_link.unionByName(ev_mark).withColumn("_nl", F.when(F.col("_lp").isNull(), nxt)) \
                      .where(F.col("item_no").isNotNull()).select("page_id", "item_no", "_nl")
    # the first paragraph that opens after the heading: again a marker in token order
    ev_p = ann.where((F.col("kind") == "open") & (F.col("tag") == "p")).select(
        "page_id", F.col("pos").cast("double").alias("_p"), F.col("p_no").alias("_pn0"),
        F.lit(None).cast("bigint").alias("item_no"))
    ev_he = heads.select("page_id", (F.col("_end") + 0.5).alias("_p"), F.lit(None).cast("bigint").alias("_pn0"),
                         "item_no")
    nxt_p = ev_p.unionByName(ev_he).withColumn("_pn", F.first("_pn0", ignorenulls=True).over(w_page)) \
                .where(F.col("item_no").isNotNull()).select("page_id", "item_no", "_pn")
    ptext = ann.where(F.col("in_desc") & (F.col("kind") == "text") & (F.col("text") != "")) \
               .groupBy("page_id", F.col("p_no").alias("_pn")).agg(_ordered_text(F.lit(True)).alias("description"))
    out = spans.join(par_link, ["page_id", "item_no"], "left").join(nxt_p, ["page_id", "item_no"], "left") \
               .join(ptext, ["page_id", "_pn"], "left")
    in_parent = F.col("_nl").isNotNull() & (F.col("_nl._lp") < F.coalesce("_pe", F.lit(1 << 62)))
    raw = F.coalesce(F.col("_own"), F.when(in_parent, F.col("_nl._h")))
    out = out.withColumn("link", F.when(raw.isNotNull(), H.url_resolve(F.col("url"), raw)))
    keep = (F.col("title") != "") & (F.col("link").isNotNull() | (F.coalesce("description", F.lit("")) != ""))
    return _items(out.where(keep), 2)


def tier3(ann: DataFrame) -> DataFrame:
    """Every anchor with text and a link, its text longer than 10 characters."""
    a = ann.where(F.col("in_a") > 0).groupBy("page_id", "url", F.col("anchor_no").alias("item_no")).agg(
        _ordered_text(F.lit(True)).alias("title"), F.first("href", ignorenulls=True).alias("_h"))
    a = a.withColumn("link", F.when(F.col("_h").isNotNull(), H.url_resolve(F.col("url"), F.col("_h"))))
    keep = (F.col("title") != "") & F.col("link").isNotNull() & (F.length("title") > MIN_LINK_TITLE)
    return _items(a.where(keep).withColumn("description", F.lit("")), 3)


def annotated_tokens(pages: DataFrame, selectors: dict | None = None) -> DataFrame:
    """N0 with its flags, written once to the checkpoint folder: the three tiers read it
    several times, and a re-read is cheaper than tokenising and windowing again."""
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(pages.sparkSession)
    return annotate(html_tokens(pages), selectors).checkpoint(eager=True)


def news_items(pages: DataFrame, *, selectors: dict | None = None, tiers=(1, 2, 3)) -> DataFrame:
    """N4 + N5: per page the items of the first tier that found any."""
    ann = annotated_tokens(pages, selectors)
    plain = all(len(c) == 1 and c[0][0] and not c[0][1] and not c[0][2] for c in map(chain, (selectors or {}).values()))
    parts = {1: lambda: tier1(ann, selectors) if plain else selected_items(pages, selectors), 2: lambda: tier2(ann), 3: lambda: tier3(ann)}
    out = None
    for t in tiers:
        part = parts[t]()
        out = part if out is None else out.unionByName(part)
    best = F.min("tier").over(Window.partitionBy("page_id"))
    return out.withColumn("_best", best).where(F.col("tier") == F.col("_best")).drop("_best")
