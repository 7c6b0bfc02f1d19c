"""Selector chains against a walk over the tokens with a stack of open elements."""

import random
import re

import pytest

from quire.operators.news import BLOCK_TAGS, VOID_TAGS, chain, news_items, selected_items

SITE = {"article": ".post", "title": "h2.entry-title", "link": "h2.entry-title a", "description": ".entry-content p"}


def _walk(html, s):
    """Elements as (start, end, tag, classes, id) from a stack per tag; a paragraph ends at the next block or paragraph tag."""
    toks = re.findall(r"</?[a-z][^>]*>|[^<]+", html)
    els, stacks, texts = [], {}, []
    for i, t in enumerate(toks):
        if not t.startswith("<"):
            if t.strip():
                texts.append((i, t.strip()))
            continue
        tag = re.match(r"</?([a-z0-9]+)", t)[1]
        if tag == "p" or tag in BLOCK_TAGS:
            for e in els:
                if e["tag"] == "p" and e["end"] is None:
                    e["end"] = i
        if t.startswith("</"):
            if stacks.get(tag):
                e = stacks[tag].pop()
                if e["end"] is None:
                    e["end"] = i
        elif tag not in VOID_TAGS:
            got = dict(re.findall(r'([a-z]+)="([^"]*)"', t))
            e = {"s": i, "end": None, "tag": tag, "cls": got.get("class", "").split(), "id": got.get("id"), "href": got.get("href")}
            els.append(e)
            stacks.setdefault(tag, []).append(e)
    for e in els:
        e["end"] = 1 << 60 if e["end"] is None else e["end"]

    def hit(e, step):
        return (step[0] is None or e["tag"] == step[0]) and all(c in e["cls"] for c in step[1]) and step[2] in (None, e["id"])

    def select(sel, root):
        steps = chain(sel)
        now = [e for e in els if hit(e, steps[0]) and (root is None or root["s"] <= e["s"] < root["end"])]
        for step in steps[1:]:
            now = [e for e in els if hit(e, step) and any(a["s"] < e["s"] < a["end"] for a in now)]
        return now
    out = []
    for n, art in enumerate(select(s["article"], None), 1):
        def text(sel):
            es = select(sel, art)
            return " ".join(t for i, t in texts if i < art["end"] and any(e["s"] < i < e["end"] for e in es))
        link = next((e["href"] for e in select(s["link"], art) if e["href"] is not None and e["s"] < art["end"]), "")
        title, desc = text(s["title"]), text(s["description"])
        if title or desc:
            out.append((n, title, desc, link and "http://h/" + link))
    return out


def _page(rng, depth=0, inline=False):
    """Nested elements; inline ones and paragraphs hold inline ones only, half of the paragraphs stay open."""
    parts = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["span", "a", "b"] if inline else ["div", "div", "section", "h2", "span", "a", "p", "p"])
        cls = rng.sample(["post", "entry-title", "entry-content", "x"], rng.randrange(0, 3))
        attrs = f' class="{" ".join(cls)}"' if cls else ""
        attrs += f' href="l{rng.randrange(99)}"' if tag == "a" and rng.random() < .8 else ""
        inner = _page(rng, depth + 1, tag in ("span", "a", "b", "p")) if depth < 4 and rng.random() < .8 else f"w{rng.randrange(999)} "
        parts.append(f"<{tag}{attrs}>{inner}" + ("" if tag == "p" and rng.random() < .5 else f"</{tag}>")
                     + ("t " if inline and rng.random() < .5 else rng.choice(["", "<br>"])))
    return "".join(parts)


@pytest.mark.parametrize("selectors", [SITE, {"article": "div .post", "title": ".entry-title.x", "link": "a", "description": "section b"},
                                       {"article": "p.post", "title": "b", "link": ".x a", "description": "span"}])
def test_selectors_equal_a_walk(spark, selectors):
    rng = random.Random(11)
    rows = [(i, "http://h/", _page(rng)) for i in range(250)]
    df = spark.createDataFrame([*rows, (900, "http://h/", None), (901, "http://h/", "")], "page_id int, url string, html string")
    got = {}
    for r in selected_items(df, selectors).collect():
        got.setdefault(r["page_id"], []).append((r["item_no"], r["title"], r["description"], r["link"]))
    want = {i: w for i, _, h in rows if (w := _walk(h, selectors))}
    bad = [(i, h, got.get(i), want.get(i)) for i, _, h in rows if sorted(got.get(i, [])) != want.get(i, [])]
    assert not bad, (len(bad), min(bad, key=lambda b: len(b[1])))
    assert len(want) > 20


def test_config_selectors_come_before_the_other_tiers(spark):
    html = ('<div class="post"><h2 class="t">One</h2></div><div class="post"><h2 class="t">Two</h2><a href="/b">b</a></div>')
    df = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", "<h1>Only a heading</h1><p>with text</p>")], "page_id int, url string, html string")
    got = news_items(df, selectors={"article": ".post", "title": ".t"}).collect()
    assert sorted((r["page_id"], r["tier"], r["title"], r["link"]) for r in got) == [
        (1, 1, "One", ""), (1, 1, "Two", "http://h/b"), (2, 2, "Only a heading", "")]


def test_unknown_selectors_are_an_error():
    for bad in ("a > b", "a:hover", "[x]", ""):
        with pytest.raises(ValueError):
            chain(bad)
