"""Quoted values, character references and links against the standard library's parser, on inline pages."""

from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.sources.fixtures import QUOTED

REFERENCES = ["&#8217;", "&eacute;", "&#x41;", "&euro;", "&notit;", "&copy2024", "&#128;", "&#x1F600;", "&bogus;", "&#xD800;", "&#0;", "&#13;", "AT&T", "&",
              "&&amp;", "&amp;lt;", "&ampersand", "&#x110000;", "&#99999999999;", "&#1;", "&#xFFFE;", "&#65", "&#x", "&#;", "&lt;b&gt;", "&NotEqualTilde;",
              "&CounterClockwiseContourIntegral;", "&frac12;x", "&frac12x", "&#150;&#129;", "a&nbsp;b", "&Aacute", "&ThickSpace;|", "&#0065;"]


def test_references_in_text(spark):
    df = spark.createDataFrame([(r,) for r in REFERENCES], "s string")
    for r in df.select("s", H.unescape("s").alias("u")).collect():
        assert r.u == unescape(r.s), r.s


@pytest.mark.parametrize("value,want", [
    ("/q?a=1&amp;b=2", "/q?a=1&b=2"), ("/q?a=1&copy=3", "/q?a=1&copy=3"), ("/q?x&copy", "/q?x©"), ("/q?x&copycat", "/q?x&copycat"),
    ("/&eacute;", "/é"), ("/&#233", "/é"), ("/q?&not", "/q?¬"), ("/q?&notit;", "/q?&notit;")])
def test_references_in_values(spark, value, want):
    page = f'<a href="{value}">x</a>'
    assert spark.range(1).select(H.raw_links(F.lit(page))).first()[0] == [want]


class Twin(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links, self.images, self.texts, self.hidden = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and "href" in values:
            self.links.append(values["href"] or "")
        if tag == "img" and "src" in values:
            self.images.append(values["src"] or "")
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.texts.append(data.strip())


# (the parser here resolves old names inside values too; HTML5, and newer versions of it, do not: see the test above)
PAGES = [QUOTED.replace("&copy=3", ""), '<a title="x>y" href="/q">t</a>', '<img alt="a>b" src=/i.png><img src=\'/j\' alt=">">', "<p title=it's>one</p><p title=that's>two</p>",
         '<a href="/1" href="/2">dup</a>', "<a HREF = '/up' >u</a>", "<a href>bare</a><a>none</a>", '<!-- <a href="/c">c</a> --><script>"<a href=/s>"</script><a href=/x/>z</a>',
         '<script src="a>b">no</script><b>yes</b>', '<a data-href="/no" href="/yes">d</a>', '<div class="a"">main</div>']


@pytest.mark.parametrize("page", PAGES)
def test_pages_match_the_standard_parser(spark, page):
    twin = Twin()
    twin.feed(page)
    twin.close()
    got = spark.range(1).select(H.raw_links(F.lit(page)).alias("l"), H.image_sources(F.lit(page)).alias("i"),
                                H.page_text_lines(F.lit(page), neutralise=False).alias("t"), H.page_text_flat(F.lit(page)).alias("f")).first()
    assert got.l == twin.links and got.i == twin.images
    assert [x for x in got.t.split("\n") if x] == twin.texts and got.f == " ".join(twin.texts)


def test_problem_anchors_outside_comments_and_scripts_only(spark):
    page = ('<!-- <a href="tel:1">c</a> --><script>var s = \'<a href="tel:2">\';</script><a title="tel:" href="/ok">ok</a>'
            '<a href="TEL:3" title=">">call <b>us</b></a><a href=mailto:a@b.c>mail</a>')
    got = spark.range(1).select(H.problem_link_count(F.lit(page)).alias("n"), H.neutralise_links(F.lit(page)).alias("h")).first()
    assert got.n == 2
    assert got.h == '<a title="tel:" href="/ok">ok</a><span>call us</span><span>mail</span>'
