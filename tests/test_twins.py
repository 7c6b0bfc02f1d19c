"""Rule twins: small Python versions of the rules, compared with the native expressions
on every fixture row (documents, pages, messages at sf0.001)."""

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from conftest import SMALL
from quire.functions import html as H
from quire.functions.text import sender_address
from quire.operators.issues import WEEKDAYS, next_release
from quire.operators.text import text_blocks


class _Text(HTMLParser):
    """Visible text nodes, one per line (script/style/noscript/iframe dropped)."""
    hide = {"script", "style", "noscript", "iframe"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.links, self.buf = [], [], [], []

    def _flush(self):
        if self.buf:
            t = "".join(self.buf).strip()
            if t and not any(x in self.hide for x in self.stack):
                self.nodes.append(t)
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "a":
            d = dict(attrs)
            if "href" in d:
                self.links.append(d["href"])
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def _twin(html):
    p = _Text()
    p.feed(html)
    p.close()
    import re
    return re.sub(r"\n\s*\n+", "\n\n", "\n".join(p.nodes)), p.links


def test_page_text_and_links_equal_stdlib_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.select("html", H.page_text_lines("html").alias("t"), H.raw_links("html").alias("l")).collect()
    assert rows
    for r in rows:
        text, links = _twin(r["html"])
        assert r["t"] == text
        assert list(r["l"]) == links


def test_blocks_hold_what_defines_them(spark):
    """No block is too long, together they are the text, and each ends where the rule says."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n in (7, 200, 1000, 5000):
        got = {}
        for r in text_blocks(docs, max_chars=n).collect():
            got.setdefault(r["doc_id"], {})[r["block_pos"]] = r["block"]
        assert set(got) == set(texts)
        for d, by_pos in got.items():
            blocks = [by_pos[i] for i in range(len(by_pos))]
            assert "".join(blocks) == texts[d]
            assert all(0 < len(b) <= n for b in blocks)
            rest = texts[d]
            for b in blocks[:-1]:
                assert len(rest) > n                          # a rest that fits is never cut
                window = rest[:n]
                assert window.count(".", len(b)) == 0         # no later stop would have fitted
                assert b.endswith(".") or (len(b) == n and "." not in b)
                rest = rest[len(b):]


def test_block_split_table(spark):
    want = [("", 5, [""]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("ab.cd.efgh", 4, ["ab.", "cd.", "efgh"]), ("a😀b.c", 3, ["a😀b", ".c"]),
            ("...", 2, ["..", "."]), ("abcdef.", 3, ["abc", "def", "."]), ("a.b.c", 5, ["a.b.c"]), ("a\nb.\nc", 4, ["a\nb.", "\nc"]),
            ("😀" * 3000 + "a" * 3000, 2999, ["😀" * 2999, "😀" + "a" * 2998, "aa"])]
    for text, n, blocks in want:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [r["block"] for r in text_blocks(df, max_chars=n).orderBy("block_pos").collect()] == blocks


def test_url_resolve_equals_urljoin(spark):
    bases = ["http://h/a/b?x#y", "https://m.x.net/en/25#top", "https://blog.t.example.com/en/853/", "http://h"]
    refs = ["c", "//z/q", "?q", "#f", "", "mailto:x@y", "../c", "./c", "/../x", "../../../x", "c/.", "c/..",
            "/The", "a/./b/../c", "g;x?y#s", "/a//b/c"]
    data = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(data, "b string, r string")
    got = df.select("b", "r", H.url_resolve("b", "r").alias("u")).collect()
    for row in got:
        assert row["u"] == urljoin(row["b"], row["r"]), (row["b"], row["r"])


def test_sender_address_table(spark):
    want = {"A B <a@b.c>": "a@b.c", " a@b.c ": "a@b.c", "<>": "<>", "> <": "> <", None: "", "": "", "x <y> <z>": "y", "<  q@r.s >": "q@r.s"}
    df = spark.createDataFrame([(c,) for c in want], "s string")
    assert {r["s"]: r["a"] for r in df.select("s", sender_address("s").alias("a")).collect()} == want


def test_next_release_table(spark):
    """2024-01-03 is a Wednesday."""
    every = list(WEEKDAYS)
    want = [("2024-01-03 09:00:00", ["Wednesday"], "12:00:00", "2024-01-03 12:00:00"),
            ("2024-01-03 12:00:00", ["Wednesday"], "12:00:00", "2024-01-10 12:00:00"),
            ("2024-01-03 12:00:01", ["Monday", "Friday"], "12:00:00", "2024-01-05 12:00:00"),
            ("2024-01-06 00:00:00", ["Monday", "Friday"], "08:30:00", "2024-01-08 08:30:00"),
            ("2024-01-07 00:00:00", ["Sunday"], "00:00:01", "2024-01-07 00:00:01"),
            ("2024-01-07 00:00:02", ["Sunday"], "00:00:01", "2024-01-14 00:00:01"),
            ("2024-02-28 23:59:59", every, "23:59:59", "2024-02-29 23:59:59"),
            ("2023-12-31 23:00:00", every, "22:00:00", "2024-01-01 22:00:00"),
            ("2024-01-03 09:00:00", [], "10:00:00", None), ("2024-01-03 09:00:00", ["Wednesday"], "", None)]
    for now, days, at, expected in want:
        df = spark.createDataFrame([(now,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        arr = F.array(*[F.lit(d) for d in days]).cast("array<string>")
        got = df.select(next_release(F.col("t"), arr, F.lit(at)).cast("string").alias("r")).first()["r"]
        assert got == expected, (now, days, at)
