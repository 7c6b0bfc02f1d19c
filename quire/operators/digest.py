"""Digest rendering: colour lookup (J5, G1), grouping by category (A1, O3), article,
section and document HTML (G2-G5), outbox rows (K4).

Colours are a fixed six-entry map, used as a literal map expression (no join). Each
article renders in its own row; a section is an ordered concatenation per
(issue, category) and a document one per issue. Digests hold the kept articles only
(top five per issue), so every group is small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------
CATEGORY_COLORS = {
    "News": "#007BFF",
    "Talks": "#28A745",
    "Events": "#DC3545",
    "Workshops": "#17A2B8",
    "Opportunity": "#FFC107",
    "Other": "#6c757d",
}
OTHER = "Other"
# ---------------------------------------------------------------------------------------

# Layout: a document is a page of sections, a section a list of cards, with one style sheet.
STYLE = ("body{font:16px/1.5 Georgia,serif;max-width:44rem;margin:auto}h2{border-left:.5rem solid;padding-left:.5rem}"
         ".card{margin:1rem 0}.facts{font-size:.8rem}.facts dt{float:left;padding-right:.3rem}")
DOC_OPEN = '<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{}</title><style>' + STYLE.replace("{", "{{").replace("}", "}}") + "</style></head><body>"
DOC_CLOSE = "\n</body></html>"
HEADER_TPL = "\n<h1>{}</h1>"
SHARED_TPL = '\n<p class="from">From {}</p>'
NOTE = "Compiled without an editor."


def _lit(s: str) -> Column:
    return F.lit(s)


def color_map() -> Column:
    return F.create_map(*[x for k, v in CATEGORY_COLORS.items() for x in (F.lit(k), F.lit(v))])


def category_of(category: str | Column) -> Column:
    """A missing category is 'Other' (unknown names keep their own name)."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(c, F.lit(OTHER))


def category_color(category: str | Column) -> Column:
    """The colour of the category, or the colour of 'Other' when unknown."""
    return F.coalesce(F.try_element_at(color_map(), category_of(category)), F.lit(CATEGORY_COLORS[OTHER]))


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def article_html(df: DataFrame, *, skip_images: bool = True, escape: bool = False) -> Column:
    """One article card. Image only when present and images are on; contact only when
    present; other missing values are empty, so no card is lost. Values are not escaped unless asked."""
    def known(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def value(name):
        c = category_of(known(name)) if name == "category" else F.coalesce(known(name), F.lit(""))
        return html_escape(c) if escape else c

    def fact(label, name):
        return F.concat(_lit(f"<dt>{label}</dt><dd>"), value(name), _lit("</dd>"))

    def only_with(name, html):
        return F.when(known(name).isNotNull(), html).otherwise(_lit(""))
    picture = _lit("") if skip_images else only_with("image", F.concat(_lit('<img alt="" src="'), value("image"), _lit('">')))
    return F.concat(
        _lit('<article class="card" style="border-top:3px solid '), category_color(known("category")), _lit('">'), picture,
        _lit('<h3><a href="'), value("link"), _lit('">'), value("title"), _lit("</a></h3><p><strong>"), value("summary"),
        _lit("</strong></p><p>"), value("description"), _lit('</p><dl class="facts">'), fact("Topic", "category"),
        fact("Published by", "source"), fact("Place", "location"), only_with("contact", fact("Ask", "contact")), _lit("</dl></article>"))


def _ordered_join(pos: str, value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                                          F.col(value).alias("v")))),
                                    lambda x: x["v"]), sep)


def category_sections(articles: DataFrame, *, by: str | Sequence[str] = "issue_id", pos: str = "pos",
                      skip_images: bool = True, escape: bool = False) -> DataFrame:
    """A1 + G3: one section per (issue, category): a coloured head, then its articles in input order."""
    keys = [by] if isinstance(by, str) else list(by)
    a = articles.withColumn("_html", article_html(articles, skip_images=skip_images, escape=escape)) \
                .withColumn("_cat", category_of("category"))
    sec = a.groupBy(*keys, "_cat").agg(_ordered_join(pos, "_html", "\n").alias("_arts"))
    head = F.concat(_lit('<section><h2 style="border-color:'), category_color(F.col("_cat")), _lit('">'), F.col("_cat"), _lit("</h2>"))
    return sec.select(*keys, F.col("_cat").alias("category"), F.concat(head, _lit("\n"), F.col("_arts"), _lit("\n</section>")).alias("html"))


def _footer(footer_text: str, feedback_url: str | None) -> str:
    answer = f' <a href="{feedback_url}">Tell us what to change</a>' if feedback_url else ""
    return f"<footer>{footer_text}. {NOTE}{answer}</footer>"


def _document(title: str, header: Column, body: Column, footer: str) -> Column:
    return F.concat(_lit(DOC_OPEN.format(title)), header, _lit("\n"), body, _lit("\n" + footer + DOC_CLOSE))


def newsletter(articles: DataFrame, *, by: str | Sequence[str] = "issue_id", pos: str = "pos",
               title: str = "Weekly News", footer_text: str = "Weekly digest", feedback_url: str | None = None,
               skip_images: bool = True, escape: bool = False) -> DataFrame:
    """One document per issue: header, sections sorted by category (code point order), footer."""
    keys = [by] if isinstance(by, str) else list(by)
    secs = category_sections(articles, by=keys, pos=pos, skip_images=skip_images, escape=escape)
    body = secs.groupBy(*keys).agg(_ordered_join("category", "html", "\n").alias("_body"),
                                   F.count(F.lit(1)).alias("n_sections"))
    header = _lit(HEADER_TPL.format(title))
    return body.select(*keys, "n_sections", _document(title, header, F.col("_body"), _footer(footer_text, feedback_url))
                       .alias("html"))


def repost(articles: DataFrame, *, by: str | Sequence[str] = "issue_id", pos: str = "pos",
           shared_by: str | Column = "Unknown", title: str = "News Repost", footer_text: str = "Weekly digest",
           feedback_url: str | None = None, skip_images: bool = True, escape: bool = False) -> DataFrame:
    """One document per repost: who sent it, the articles in input order, no grouping."""
    keys = [by] if isinstance(by, str) else list(by)
    who = F.lit(shared_by) if isinstance(shared_by, str) else shared_by
    a = articles.withColumn("_html", article_html(articles, skip_images=skip_images, escape=escape)) \
                .withColumn("_who", who)
    body = a.groupBy(*keys).agg(_ordered_join(pos, "_html", "\n").alias("_body"), F.first("_who").alias("_who"))
    before, after = SHARED_TPL.split("{}")
    header = F.concat(_lit(HEADER_TPL.format(title) + before), F.col("_who"), _lit(after))
    return body.select(*keys, _document(title, header, F.col("_body"), _footer(footer_text, feedback_url)).alias("html"))


def outbox(docs: DataFrame, setup: DataFrame, *, by: str = "mailbox_id", subject: str = "Newsletter",
           sender: str | None = None) -> DataFrame:
    """K4: one mail row per document; no row when the address is empty."""
    s = setup.select(by, F.col("newsletter_email").alias("to"))
    return docs.join(s, by).where(F.col("to").isNotNull() & (F.col("to") != "")) \
               .withColumn("subject", F.lit(subject)).withColumn("sender", F.lit(sender or "me"))
