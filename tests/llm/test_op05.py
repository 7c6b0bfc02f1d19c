"""Main text: tagged pages round trip, held-out designs, broken mark-up, the decoder's constraint."""

import html
import itertools
import re

import numpy as np
import pytest

from quire.llm._boost import Trees
from quire.llm.op05_html_trees import SWITCH, _designs, decode, extract, fit, main_text, main_texts, parse

PAGES = "/root/testdata/sf0.01/pages.parquet"


def article(h):
    a = re.search(r"<article>(.*?)</article>", h, re.S)
    parts = [re.sub(r"<[^>]*>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", a[1] if a else "")]
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(PAGES).orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return fit(pages[::2])


def test_held_out_pages_round_trip(model, pages):
    got = extract(model, pages[1::2])
    assert np.mean([g == article(h) for g, h in zip(got, pages[1::2])]) > 0.98


def test_held_out_designs(model, pages):
    rng = np.random.default_rng(123)
    src = [article(h).split("\n") for h in pages[1::2] if article(h)]
    side = [t[:120] for s in src[:30] for t in s]
    f1 = []
    for s in src[:80]:
        page = _designs(s[1:8] or s, s[0], side, rng)
        blocks = parse(page)
        want = main_text(blocks, np.array([b.label for b in blocks])).split()
        got = extract(model, [page])[0].split()
        f1.append(2 * len(set(got) & set(want)) / max(1, len(set(got)) + len(set(want))))
    assert np.mean(f1) > 0.97


def test_references_white_space_and_broken_markup(model):
    page = ("<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy now.</div><article><h1>A &amp; B&#8217;s"
            "</h1><p><b>First,\n  one &eacute;t&#xe9; <a title='a > b' href=/x>link</a>.<br><p>Second &notaref; paragraph, of enough words to be read.</p>"
            "<script>var t='</p><p>no</p>';</script><p>Third paragraph, it is never closed and it ends here")
    assert extract(model, [page]) == ["A & B’s\nFirst, one été link.\nSecond ¬aref; paragraph, of enough words to be read."
                                      "\nThird paragraph, it is never closed and it ends here"]
    odd = ["<", "<a", "</p></div>", "<p", "<!-- x", "<script>", "< p>x", "<p><p><p>", "<table><td>x<td>y", "<div>" * 3000, "a<b>" * 2000, "&" * 1000,
           "<a href='" + "x" * 50000, "<p " + "\"'" * 20000]
    assert len(extract(model, odd)) == len(odd)


def test_decoder_is_the_best_allowed_labelling():
    rng = np.random.default_rng(0)
    blocks = parse("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    n = len(blocks)
    up = [blocks.index(b.parent) if b.parent else -1 for b in blocks]
    for _ in range(30):
        odds = rng.normal(0, 3, n)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = None
        for s in itertools.product((0, 1, 2), repeat=n):
            if any(u >= 0 and (s[u] == 2 and x != 2 or s[u] == 1 and x == 0) for u, x in zip(up, s)):
                continue
            score = sum((no[i] - 0.05, yes[i], no[i])[x] for i, x in enumerate(s))
            score -= SWITCH * sum(u >= 0 and s[u] == 1 and x == 2 for u, x in zip(up, s))
            if best is None or score > best[0] + 1e-12:
                best = (score, s)
        assert (decode(blocks, odds) == (np.array(best[1]) == 1)).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Trees(4).fit(x, y, np.ones(2000))
    z = rng.normal(size=(1000, 4)).astype(np.float32)
    assert np.mean((t.margin(z) > 0) == ((z[:, 0] > 0) ^ (z[:, 1] > 0.5))) > 0.93


def test_query_shape_and_edge_cases(spark, pages):
    rows = [(i, f"u{i}", h, "k") for i, h in enumerate(pages[:40])] + [(100, None, None, "k"), (101, "u", "", "k"), (None, "u", pages[0], "k"),
                                                                       (0, "u0", pages[0], "k"), (102, "u", "plain", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_texts(df).collect()
    assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str(r[:2]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[100] == by[101] == "" and by[None] == by[0] == article(pages[0])
    assert main_texts(df.limit(0)).count() == 0
