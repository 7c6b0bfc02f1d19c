"""HTML main text by gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A page is parsed leniently into a tree of block elements (inline elements belong to their
block; comments, scripts, styles and the like are no text). Every block gets features: depth, text and
link density of its subtree, punctuation, attribute tokens (class, id, role) of itself and its
ancestors, tag kind, share of the page's text, and statistics of its siblings. Boosted trees give each block
the log odds of being main text. Decoding picks one state per block, the best sum over the tree
under the hierarchy: *outside* may hold anything, *main* may hold main or boilerplate,
*boilerplate* only boilerplate. So no main block sits inside boilerplate.

Text: the own text of main blocks in page order, character references decoded, white space inside a
block one space, trimmed, blocks joined by one newline; nothing else dropped or cut.

Training: a bounded sample of ``sample`` pages by hash of the id; pages of more than ``longest`` characters
are drawn last, and the sample reads ``longest`` characters of them. Their blocks are tagged by HTML5 semantics (article or main against nav, footer, aside, adverts, forms), and
their texts are laid out again by fixed rules in other page designs (divisions with class names, side bars,
notices, reader comments, forms, tables), where every block's tag is known.

Cases: null or empty html, or no main block: empty text. No trees can be fitted (no text in the drawn pages): the
semantic tags alone decide, and on a page without article or main all that is not nav, footer, advert and the like is text. Null ids, null urls and repeated rows are kept.
Broken mark-up (unclosed elements, stray ends, cut references) is read as it stands; a head without an end tag ends
where HTML ends it, and a hidden element (svg, object, button, option, audio and the like) without an end tag of its
own hides only what comes before the next block. Empty table: no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._boost import Trees

#: Element kinds (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title select button textarea option canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var img br wbr input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
KINDS = ("p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tfoot tr td th", "article main", "div section center",
         "nav menu", "header", "footer", "aside", "form fieldset", "blockquote pre figure figcaption", "body html")
KIND = {t: i for i, ts in enumerate(KINDS) for t in ts.split()}
GOOD = frozenset("article body content entry main post story text blog page news hentry articlebody maincontent".split())
BAD = frozenset("ad ads advert advertisement adverts aside author banner bio breadcrumb breadcrumbs bar byline comment comments consent cookie "
                "copyright disclaimer disqus dialog feedback foot footer form gdpr head header login masthead menu meta modal nav navbar "
                "navigation newsletter note notice notification overlay pagination pager popup promo promotion recommended related reply replies "
                "respond search share sharing shop sidebar signup skip social sponsor sponsored subscribe tags toolbar top widget".split())
#: An attribute by the rules of HTML: a quote opens a value only right after "="; elsewhere it is a plain character.
_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
TAG = re.compile(rf"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)(?:>|\Z))", re.S)
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("tag", "parent", "depth", "kids", "parts", "good", "bad", "links", "inline", "label")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.kids, self.parts = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = self.links = self.inline = 0
        self.label = "data-main" in attrs   # the mark of laid-out training pages; no feature
        if attrs:
            for m in ATTR.finditer(attrs):
                if m[1].lower() not in ("class", "id", "role"):
                    continue
                for t in SPLIT.split((m[2] or m[3] or m[4] or "").lower()):
                    self.good += t in GOOD
                    self.bad += t in BAD


def _text(runs: list[str]) -> str:
    return " ".join("".join(entities.unescape(r) if "&" in r else r for r in runs).split())


def parse(page: str | None) -> list[Block]:
    """Blocks in page order, the root first. ``parts`` holds a block's text runs and children in order."""
    blocks, open_ = _read(page or "", frozenset())
    return _read(page or "", open_)[0] if open_ else blocks


def _read(page: str, loose: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """Blocks, and the places of the hidden elements (but head) that no end tag of their own closes. Those at the
    places ``loose`` end before the first block that starts in them, or at once if self-closed."""
    root = Block("html", None)
    blocks, here = [root], root
    stack: list[tuple[str, Block | None, int]] = []              # open elements with their places; None: inline
    link = 0
    at, size = 0, len(page)
    hidden = 0
    open_: set[int] = set()
    where: dict[str, list[int]] = {}                             # open elements of a name, by their place in the stack
    depths: list[int] = []                                       # open blocks, likewise
    head, ends_early = -1, []                                    # where in the stack: the open head, the loose ones

    def close(depth: int, own: bool = False) -> None:
        """Close the open elements from ``depth`` up; ``own``: the first by its end tag."""
        nonlocal link, hidden, here, head
        for i, (n, b, place) in enumerate(stack[depth:]):
            where[n].pop()
            link -= n == "a"
            hidden -= n in HIDDEN
            if n in HIDDEN and n != "head" and (i or not own):
                open_.add(place)
        blocks_closed = bisect_left(depths, depth)
        if blocks_closed < len(depths):
            here = stack[depths[blocks_closed]][1].parent
            del depths[blocks_closed:]
        del stack[depth:]
        head = head if head < depth else -1
        while ends_early and ends_early[-1] >= depth:
            ends_early.pop()

    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if 0 <= head == len(stack) - 1 and page[at:end].strip():  # text ends a head without an end tag
            close(head)
        if end > at and not hidden:
            run = page[at:end]
            here.parts.append(run)
            if link:
                here.links += len(run.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:                                                 # an end tag closes the nearest open element of its name
            depth = where[name][-1] if where.get(name) else -1
            if depth < 0 or stack[depth][1] is None and depths and depths[-1] > depth:
                continue
            close(depth, own=True)
            continue
        if head >= 0 and name == "head":
            continue
        if head >= 0 and (name == "body" or name not in HEAD and head == len(stack) - 1):
            close(head)                                          # and so does a start tag that a head cannot hold
        depth = next((i for i in ends_early if name in KIND or name == stack[i][0]), -1)
        if depth >= 0:
            close(depth)
        closes = CLOSES.get(name)
        if closes:                                               # from the nearest scope up, what it closes and paragraphs
            scope = max((where[n][-1] for n in SCOPE[name] if where.get(n)), default=-1)
            ends = [spots[k] for n in (*closes, "p") if (spots := where.get(n)) and (k := bisect_left(spots, scope)) < len(spots)]
            if ends:
                close(min(ends))
        elif name not in INLINE and depths and stack[depths[-1]][0] == "p":
            close(depths[-1])                                    # any block start ends an open paragraph
        if name == "br":
            here.parts.append(" ")
            continue
        if name in VOID:
            continue
        empty = m[3].rstrip().endswith("/")
        if name in RAW and not empty:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name in INLINE:
            here.inline += 1
            link += name == "a"
            where.setdefault(name, []).append(len(stack))
            stack.append((name, None, end))
            continue
        block = Block(name, here, m[3])
        here.kids.append(block)
        here.parts.append(block)
        blocks.append(block)
        if empty and (name in ("svg", "math") or end in loose):
            continue
        hidden += name in HIDDEN
        if name == "head":
            head = len(stack)
        elif end in loose:
            ends_early.append(len(stack))
        where.setdefault(name, []).append(len(stack))
        depths.append(len(stack))
        stack.append((name, block, end))
        here = block
    close(0)
    return blocks, frozenset(open_)


FEATURES = 34


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES)."""
    n = len(blocks)
    index = {id(b): i for i, b in enumerate(blocks)}
    own = [sum(len(r.strip()) for r in b.parts if isinstance(r, str)) for b in blocks]
    marks = [sum(r.count(".") + r.count(",") + r.count("!") + r.count("?") for r in b.parts if isinstance(r, str)) for b in blocks]
    text, links, tags, leaves, stops = list(own), [b.links for b in blocks], [1 + b.inline for b in blocks], [int(o > 0) for o in own], list(marks)
    for i in range(n - 1, 0, -1):
        p = index[id(blocks[i].parent)]
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        leaves[p] += leaves[i]
        stops[p] += stops[i]
    whole = max(1, text[0])
    x = np.zeros((n, FEATURES), np.float32)
    good, bad, kinds = [0] * n, [0] * n, [0] * n                 # along the ancestors
    done = 0
    for i, b in enumerate(blocks):
        kind = KIND.get(b.tag, len(KINDS))
        p = index[id(b.parent)] if b.parent else -1
        if p >= 0:
            good[i], bad[i], kinds[i] = good[p] + blocks[p].good, bad[p] + blocks[p].bad, kinds[p] | 1 << KIND.get(blocks[p].tag, len(KINDS))
        sibs = b.parent.kids if b.parent else [b]
        k = len(sibs)
        t = text[i] or 1
        x[i, :14] = (b.depth, np.log1p(text[i]), np.log1p(own[i]), links[i] / t, 100 * tags[i] / (t + 50), 100 * stops[i] / (t + 20), leaves[i],
                     text[i] / (leaves[i] or 1), text[i] / whole, done / whole, len(b.kids), k, b.good, b.bad)
        x[i, 14:20] = (good[i], bad[i], kind, bool(kinds[i] & 0b100000), bool(kinds[i] & 0b111110000000), own[i] / t)
        done += own[i]
        x[i, 20 + min(kind, 13)] = 1
    for i, b in enumerate(blocks):                               # siblings
        if b.kids:
            ks = [index[id(c)] for c in b.kids]
            lens = [text[j] for j in ks]
            mean, top = sum(lens) / len(ks), max(lens) or 1
            by: dict[str, int] = {}
            for c in b.kids:
                by[c.tag] = by.get(c.tag, 0) + 1
            x[ks, 33] = [by[c.tag] / len(ks) for c in b.kids]
            x[ks, 19] += [2 * round(v / top, 2) for v in lens]
            x[ks, 7] += mean / 1000
    return x


#: Log odds against boilerplate inside a main block.
SWITCH = 3.5


def decode(blocks: list[Block], odds: np.ndarray) -> np.ndarray:
    """Whether each block is main text: the best labelling that the hierarchy allows."""
    n = len(blocks)
    index = {id(b): i for i, b in enumerate(blocks)}
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    main, boiler, outside = yes.copy(), no.copy(), no - 0.05
    for i in range(n - 1, 0, -1):
        p = index[id(blocks[i].parent)]
        main[p] += max(main[i], boiler[i] - SWITCH)
        boiler[p] += boiler[i]
        outside[p] += max(main[i], boiler[i], outside[i])
    state = [0] * n                                              # 0 outside, 1 main, 2 boilerplate
    for i, b in enumerate(blocks):
        above = state[index[id(b.parent)]] if b.parent else 0
        if above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if main[i] >= boiler[i] - SWITCH else 2
        else:
            state[i] = 0 if outside[i] >= max(main[i], boiler[i]) else 1 if main[i] >= boiler[i] else 2
    return np.array(state) == 1


def main_text(blocks: list[Block], main: np.ndarray) -> str:
    """Own text of main blocks in page order; a child block ends the run before it."""
    index = {id(b): i for i, b in enumerate(blocks)}
    out: list[str] = []
    todo = [(blocks[0], 0)]
    run: list[str] = []
    while todo:
        b, i = todo.pop()
        keep = main[index[id(b)]]
        while i < len(b.parts):
            part = b.parts[i]
            i += 1
            if isinstance(part, str):
                if keep:
                    run.append(part)
                continue
            if run:
                out.append(_text(run))
                run = []
            todo.append((b, i))
            b, i, keep = part, 0, main[index[id(part)]]
        if run:
            out.append(_text(run))
            run = []
    return "\n".join(t for t in out if t)


def _designs(paragraphs: list[str], title: str, side: list[str], rng: np.random.Generator) -> str:
    """One page in a drawn design; main blocks carry data-main."""
    esc = entities.escape
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    good = pick("post-content", "entry-content", "article-body", "story", "content", "main-text", "blog-post", "x1", "box", "")
    cls = f' class="{good}"' if good else ""
    links = lambda k: "".join(f'<li><a href="/{j}">{esc(side[j % len(side)][:12])}</a></li>' for j in range(k))
    short = lambda: esc(side[rng.integers(0, len(side))])
    main = [f"<h{1 + int(rng.integers(0, 2))} data-main>{esc(title)}</h1>"] if rng.random() < 0.9 else []
    for p in paragraphs:
        r = rng.random()
        main.append(f"<blockquote data-main><p data-main>{esc(p)}</p></blockquote>" if r < 0.04 else f"<h2 data-main>{esc(p[:40])}</h2>" if r < 0.08
                    else f"<ul data-main><li data-main>{esc(p)}</li><li data-main>{esc(p[:60])}</li></ul>" if r < 0.12
                    else f"<div data-main>{esc(p)}</div>" if r < 0.2 else f'<p data-main>{esc(p)} <a href="/x">{esc(p[:15])}</a></p>' if r < 0.3
                    else f"<p data-main>{esc(p)}</p>" if r < 0.85 else f"<p data-main><b>{esc(p)}<br>")
        if rng.random() < 0.08:
            main.append(pick(f'<div class="{pick("ad", "advert", "promo", "sponsored", "ad-slot")}">{short()}</div>', f"<aside><p>{short()}</p></aside>",
                             f'<div class="{pick("related", "newsletter", "share social")}"><p>{short()}</p><ul>{links(3)}</ul></div>',
                             f"<form><p>{short()}</p><input name=q><label>{short()}</label></form>"))
    wrap = pick("article", "main", "div", "section", "div", "article")
    head = pick("", f"<nav><ul>{links(6)}</ul></nav>", f'<div class="{pick("menu", "navbar", "top-bar", "nav", "x2")}"><ul>{links(int(rng.integers(3, 9)))}</ul></div>')
    head = pick("", f'<header><a href="/">{short()}</a><p>{short()}</p></header>', f'<div id="header"><h1>{short()}</h1></div>') + head
    head += pick("", "", f'<div class="{pick("cookie-notice", "consent", "banner", "notice")}"><p>{short()}</p><button>ok</button></div>')
    head += pick("", f'<div class="{pick("ad", "ads", "banner", "sponsor")}">{short()}</div>')
    said = "".join(f'<div class="{pick("comment", "reply", "comment-body")}"><p>{short()}</p></div>' for _ in range(int(rng.integers(1, 6))))
    tail = pick("", f'<div class="comments" id="comments"><h3>{short()}</h3>{said}</div>', f'<section class="comments">{said}</section>')
    tail += pick("", f'<aside class="sidebar"><h3>{short()}</h3><ul>{links(5)}</ul><p>{short()}</p></aside>', f'<div id="sidebar"><p>{short()}</p><ul>{links(4)}</ul></div>')
    tail += pick(f"<footer>&copy; {short()}</footer>", f'<div class="{pick("footer", "copyright", "foot")}"><p>{short()}</p></div>', f"<footer><ul>{links(4)}</ul><p>{short()}</p></footer>", "")
    inner = "".join(main)
    if rng.random() < 0.3:                                       # nested parts, and text without a paragraph of its own
        cut = int(rng.integers(0, len(main) + 1))
        part = pick("section", "div", "section")
        inner = (f"<{part} data-main>{''.join(main[:cut])}{esc(paragraphs[0])}</{part}>" + "".join(main[cut:]) if rng.random() < 0.5
                 else f"<{part} data-main>{inner}{esc(paragraphs[-1])}</{part}>")
    body = f"<{wrap}{cls} data-main>{inner}</{wrap}>"
    if rng.random() < 0.4:
        body = f'<div class="{pick("wrapper", "container", "row", "page")}"><div>{body}</div></div>'
    if rng.random() < 0.1:
        body = f"<table><tr><td><ul>{links(4)}</ul></td><td data-main>{''.join(main)}</td></tr></table>"
    return f"<html><head><title>{esc(title)}</title><style>p{{}}</style></head><body>{head}{body}{tail}</body></html>"


SEMANTIC_MAIN, SEMANTIC_OUT = {"article", "main"}, {"nav", "footer", "aside", "form", "header", "menu"}


def _semantic(blocks: list[Block], root: bool = False) -> list[bool]:
    index = {id(b): i for i, b in enumerate(blocks)}
    out: list[bool] = []
    for b in blocks:
        above = out[index[id(b.parent)]] if b.parent else root
        out.append((above or b.tag in SEMANTIC_MAIN) and b.tag not in SEMANTIC_OUT and not b.bad)
    return out


def fit(pages: list[str], designs: int = 3, seed: int = 8) -> Trees | None:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    texts: list[tuple[list[str], list[str]]] = []
    for page in pages:
        blocks = parse(page)
        tag = _semantic(blocks)
        if any(tag):
            xs.append(features(blocks))
            ys.append(np.array(tag, float))
        lines = main_text(blocks, np.array(tag)).split("\n") if any(tag) else main_text(blocks, np.ones(len(blocks), bool)).split("\n")
        rest = [t for t in main_text(blocks, ~np.array(tag)).split("\n") if t]
        texts.append(([t for t in lines if t], rest))
    side = [t[:200] for _, rest in texts for t in rest][:2000] or ["Home", "About us", "Read more about this here."]
    for lines, _ in texts:
        for _ in range(designs if lines else 0):
            k = int(rng.integers(1, 12))
            some = [lines[i] for i in sorted(rng.choice(len(lines), min(k, len(lines)), replace=False))]
            page = _designs(some, lines[0][:60], side, rng)
            blocks = parse(page)
            xs.append(features(blocks))
            ys.append(np.array([b.label for b in blocks], float))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    if not 0 < y.mean() < 1:
        return None
    return Trees(4).fit(x, y, np.ones(len(y)))


def train(pages: DataFrame, sample: int = 250, longest: int = 60_000) -> Trees | None:
    ok = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    long, h = F.length("html") > longest, F.xxhash64("page_id")
    ids = ok.select("page_id", long.alias("long")).distinct().orderBy("long", h, "page_id").limit(sample)
    rows = (ok.withColumn("long", long).join(F.broadcast(ids), ["page_id", "long"], "left_semi")
            .select("page_id", F.substring("html", 1, longest).alias("html")).distinct().orderBy("page_id", "html").limit(sample).collect())
    return fit([r["html"] for r in rows]) if rows else None


def extract(model: Trees | None, pages: list) -> list[str]:
    trees = [parse(p) for p in pages]
    if model is None:
        tags = [_semantic(b) for b in trees]
        return [main_text(b, np.array(t if any(t) else _semantic(b, True))) for b, t in zip(trees, tags)]
    x = [features(b) for b in trees]
    odds = model.margin(np.concatenate(x)) if x else np.zeros(0)
    cut = np.cumsum([0] + [len(b) for b in trees])
    return [main_text(b, decode(b, odds[cut[i]: cut[i + 1]])) for i, b in enumerate(trees)]


def _pages(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in T.slices(batches, "html"):
            text = extract(model.value, rows.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages))
    return pages.select("page_id", "url", "html").mapInArrow(_pages(model), "page_id long, url string, text string, n_chars long")
