"""Tables whose pages are all long, or give no trees."""

from quire.llm.op05_html_trees import extract, main_texts, train

SCHEMA = "page_id long, url string, html string"


def page(i, n=1):
    text = "".join(f"<p>Paragraph {j} of page {i}, with words enough to be read.</p>" for j in range(n))
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title {i}</h1>{text}</article><footer>Imprint</footer></body></html>"


def want(i, n=1):
    return "\n".join([f"Title {i}"] + [f"Paragraph {j} of page {i}, with words enough to be read." for j in range(n)])


def test_all_pages_longer_than_the_training_limit(spark):
    df = spark.createDataFrame([(i, "u", page(i, 1200)) for i in range(12)], SCHEMA).cache()
    assert df.where("length(html) <= 60000").count() == 0 and train(df) is not None
    assert {r.page_id: r.text for r in main_texts(df).collect()} == {i: want(i, 1200) for i in range(12)}


def test_a_short_page_without_text_beside_long_ones(spark):
    rows = [(100, "u", "<br>")] + [(i, "u", page(i, 40)) for i in range(12)]
    assert train(spark.createDataFrame(rows, SCHEMA), longest=1000) is not None


def test_no_trees_at_all(spark):
    rows = [(i, "u", f"<br id={i}>") for i in range(20)] + [(None, "u", page(3, 2)), (None, "u2", "<nav>Home</nav><div>Plain <b>text</b></div>")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert train(df) is None
    got = {(r.page_id, r.url): r.text for r in main_texts(df).collect()}
    assert got[None, "u"] == want(3, 2) and got[None, "u2"] == "Plain text" and got[0, "u"] == ""
    assert extract(None, [None, "", "plain"]) == ["", "", "plain"]
