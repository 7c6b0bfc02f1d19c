"""HTML functions (P6-P8, H1-H6) as native regex / higher-order Column expressions.

No HTML library runs per row: tags are found with regular expressions and text nodes are the pieces between
tags. A quote opens an attribute value only after ``=``, so a ``>`` inside it ends no tag. Character references
are resolved as HTML5 does: every named one (the standard library's table), the old ones without ``;`` by longest
prefix (in attribute values only as whole names), and numeric ones.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import ustrip

# ---- fixed values (must equal the reference's behaviour) ----------------------------
# Link schemes that trigger system actions; such links are dropped or neutralised.
PROBLEM_SCHEMES = ("mailto", "tel", "sms", "callto", "skype", "javascript")
# Elements whose whole content is removed before the visible text is taken (H1).
HIDDEN_BLOCKS_LINES = ("script", "style", "noscript", "iframe")
# Elements whose text is left out of the flat page text (H4).
HIDDEN_BLOCKS_FLAT = ("script", "style")
# Code points that a numeric reference to 128-159 means (windows-1252; the five free places mean themselves).
CP1252 = tuple(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
# -------------------------------------------------------------------------------------

COMMENT_RE = r"(?s)<!--.*?-->"
DECL_RE = r"<![^>]*>|<\?[^>]*>"
#: What may stand in a tag after its name: anything but ``>``; a quoted run counts only as a value.
ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TAG_RE = rf"</?[A-Za-z]{ATTRS}>"
ATTR_RE = r"[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
#: Names of character references: all (written with ";"), and those that also stand without it, longest first.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_SCHEMES = "|".join(PROBLEM_SCHEMES)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tag_re(name: str) -> str:
    """A start tag of that name."""
    return rf"<{name}(?:[\s/]{ATTRS})?+>"


def _blocks_re(tags) -> str:
    return "(?is)" + "|".join(rf"{tag_re(t)}.*?</{t}\s*+>" for t in tags)


def without_scripts(html: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(html), COMMENT_RE, ""), _blocks_re(("script", "style")), "")


def _code_point(digits: Column) -> Column:
    """The character of a numeric reference: '65' or 'x41'."""
    short = F.regexp_replace(F.regexp_replace(digits, "^[xX]", ""), "^0+", "")
    n = (F.when(F.length(short) > 7, F.lit(1 << 30)).when(short == "", F.lit(0))
         .when(digits.rlike("^[xX]"), F.conv(short, 16, 10).cast("int")).otherwise(short.try_cast("int")))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("�"))
            .when(n.between(128, 159), F.element_at(F.array(*[F.lit(c) for c in CP1252]), n - 127))
            .when(n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                  | (n.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
            .otherwise(plain))


def unescape(s: str | Column, attribute: bool = False) -> Column:
    """Character references resolved. In an attribute value a name without ``;`` counts only whole and not before ``=``."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")      # folded to a literal
    numeric = r"^#([0-9]++|[xX][0-9a-fA-F]++);?"
    bare = "^(" + "|".join(BARE) + ")" + ("(?![A-Za-z0-9=])" if attribute else "")

    def resolved(p: Column) -> Column:
        digits = F.regexp_extract(p, numeric, 1)
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*+);", 1)
        old = F.regexp_extract(p, bare, 1)
        rest = lambda n: F.substring(p, n, F.length(p))
        return (F.when(digits != "", F.concat(_code_point(digits), F.regexp_replace(p, numeric, "")))
                .when((name != "") & F.element_at(names, name).isNotNull(), F.concat(F.element_at(names, name), rest(F.length(name) + 2)))
                .when(old != "", F.concat(F.element_at(names, old), rest(F.length(old) + 1)))
                .otherwise(F.concat(F.lit("&"), p)))

    text = _c(s)
    parts = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(resolved(p)))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def _value(tag: Column, attr: str) -> Column:
    """Value of ``attr`` in a tag (the last one, if given twice); '' for a bare attribute; NULL when absent."""
    given = F.filter(F.regexp_extract_all(tag, F.lit(ATTR_RE), 0), lambda a: a.rlike(rf"(?i)^{attr}\s*+(=|$)"))
    last = F.try_element_at(given, F.lit(-1))
    return unescape(F.regexp_replace(F.regexp_replace(last, r"^[^=]*+=?\s*+", ""), r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2"), attribute=True)


def _attr_values(tags: Column, attr: str) -> Column:
    """Value of ``attr`` in each tag of an array."""
    return F.transform(tags, lambda t: _value(t, attr))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(without_scripts(html), F.lit("(?i)" + tag_re(name)), 0)


def raw_links(html: str | Column) -> Column:
    """``href`` of every ``<a href>``, document order, duplicates kept, not resolved."""
    return F.filter(_attr_values(_tags(_c(html), "a"), "href"), lambda v: v.isNotNull())


def keep_link(link: Column) -> Column:
    """P7 predicate: not a system-action scheme (case-insensitive, not stripped), not blank, not '#'."""
    s = ustrip(link)
    return ~F.lower(link).rlike(rf"^({_SCHEMES}):") & (s != "") & (s != "#")


def filtered_links(html: str | Column) -> Column:
    """P6 + P7."""
    return F.filter(raw_links(html), keep_link)


def image_sources(html: str | Column) -> Column:
    """``src`` of every ``<img src>``; an empty ``src`` is kept."""
    return F.filter(_attr_values(_tags(_c(html), "img"), "src"), lambda v: v.isNotNull())


def all_img_sources(html: str | Column) -> Column:
    """Every ``<img>`` tag in order, with its ``src`` or NULL (H7 counts tags without one)."""
    return _attr_values(_tags(_c(html), "img"), "src")


_ANCHOR = rf"(?is)({tag_re('a')})(.*?)</a\s*+>"


def _anchors(html: str | Column) -> Column:
    """Pieces of the page without comments and scripts, cut before every anchor that is closed; each but the
    first is a tag, U+0002, the content, U+0003, and what follows."""
    return F.split(F.regexp_replace(without_scripts(html), _ANCHOR, "\u0001$1\u0002$2\u0003"), "\u0001")


def _is_problem(piece: Column) -> Column:
    href = _value(F.substring_index(piece, "\u0002", 1), "href")
    return piece.contains("\u0002") & F.coalesce(F.lower(href).rlike(f"^({_SCHEMES}):"), F.lit(False))


def neutralise_links(html: str | Column) -> Column:
    """H3: an anchor with a problem scheme becomes a span holding only its text. Anchors in comments and
    scripts are none (both are left out of the result)."""
    def fixed(p: Column) -> Column:
        inner = F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1)
        after = F.substring(p, F.length(F.substring_index(p, "\u0003", 1)) + 2, F.length(p))
        plain = F.concat(F.lit("<span>"), F.regexp_replace(inner, TAG_RE, ""), F.lit("</span>"), after)
        return F.when(_is_problem(p), plain).otherwise(F.replace(F.replace(p, F.lit("\u0002"), F.lit("")), F.lit("\u0003"), F.lit("</a>")))
    h = _c(html)
    pieces = F.transform(_anchors(h), lambda p, i: F.when(i == 0, p).otherwise(fixed(p)))
    return F.when(h.rlike(f"(?i)({_SCHEMES}):"), F.array_join(pieces, "")).otherwise(h)


def problem_link_count(html: str | Column) -> Column:
    h = _c(html)
    return F.when(h.rlike(f"(?i)({_SCHEMES}):"), F.size(F.filter(_anchors(h), _is_problem))).otherwise(
        F.when(h.isNotNull(), F.lit(0)))


def _text_nodes(html: Column, hidden) -> Column:
    no_comments = F.regexp_replace(F.regexp_replace(html, COMMENT_RE, ""), DECL_RE, "")
    no_blocks = F.regexp_replace(no_comments, _blocks_re(hidden), "")
    nodes = F.split(no_blocks, TAG_RE)
    return F.filter(F.transform(nodes, lambda t: ustrip(unescape(t))),
                    lambda t: t != "")


def collapse_blank_lines(s: str | Column) -> Column:
    """H2: a run of lines holding only white space becomes one empty line."""
    return F.regexp_replace(_c(s), r"(?U)\n\s*\n+", "\n\n")


def page_text_lines(html: str | Column, neutralise: bool = True) -> Column:
    """H1 + H2 (+ H3): visible text of the whole document, one text node per line."""
    h = _c(html)
    if neutralise:
        h = neutralise_links(h)
    return collapse_blank_lines(F.array_join(_text_nodes(h, HIDDEN_BLOCKS_LINES), "\n"))


def page_text_flat(html: str | Column) -> Column:
    """H4: text below ``<body>`` (script/style left out), nodes joined by one space."""
    h = _c(html)
    body = F.when(h.rlike("(?i)" + tag_re("body")), F.regexp_replace(h, rf"(?is)^.*?{tag_re('body')}", "")).otherwise(h)
    body = F.regexp_replace(body, r"(?is)</body\s*>.*$", "")
    return F.array_join(_text_nodes(body, HIDDEN_BLOCKS_FLAT), " ")


# ---- URL resolution (H6) --------------------------------------------------------------
_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _remove_dots(path: Column, relative: Column) -> Column:
    """Dot segments of a merged path; for a relative reference the empty middle segments
    are dropped too (a root-relative path keeps them, as urljoin does)."""
    segs = F.split(path, "/")
    n = F.size(segs)
    mid = F.filter(segs, lambda x, i: (i == 0) | (i == n - 1) | (x != "") | ~relative)
    out = F.aggregate(mid, F.array().cast("array<string>"),
                      lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                                      .when(s == ".", acc)
                                      .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(mid, -1)
    out = F.when(last.isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    joined = F.array_join(out, "/")
    # an authority is present, so the path is made to start with '/'
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def url_resolve(base: str | Column, ref: str | Column) -> Column:
    """H6: ``ref`` made absolute against ``base`` (RFC 3986 merge, as urljoin does)."""
    b, r = _c(base), _c(ref)
    scheme = F.regexp_extract(b, _SCHEME_RE, 1)
    authority = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bpath = F.regexp_extract(b, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    bquery = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
    root = F.concat(scheme, F.lit("://"), authority)
    rpath = F.regexp_extract(r, r"^([^?#]*)", 1)
    rrest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
    base_dir = F.regexp_replace(bpath, r"[^/]*$", "")
    merged = F.when(rpath.startswith("/"), rpath).otherwise(F.concat(
        F.when(base_dir == "", F.lit("/")).otherwise(base_dir), rpath))
    return (F.when(r.isNull(), F.lit(None))
             .when(r == "", b)
             .when(r.rlike(_SCHEME_RE), r)
             .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
             .when(r.startswith("?"), F.concat(root, bpath, r))
             .when(r.startswith("#"), F.concat(root, bpath, bquery, r))
             .otherwise(F.concat(root, _remove_dots(merged, ~rpath.startswith("/")), rrest)))
