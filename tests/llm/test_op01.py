"""Surrogates: round trip of everything else, formats, distinctness, coreference."""

import re

from pyspark.sql import functions as F

from quire.llm.op01_surrogates import replaced, surrogate_texts, surrogates

CARD = re.compile(r"(?<!\w)\d{16}(?!\w)")


def luhn(x):
    d = [int(c) for c in reversed(x)]
    return sum(d[0::2] + [sum(divmod(2 * v, 10)) for v in d[1::2]]) % 10 == 0


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_pii) for r in surrogate_texts(df).collect()}


def test_formats_and_coreference(spark):
    rows = [(1, "Mail ann.12@mail7.example.org, now. Call +1 (838) 555-7235 or 838-555-7235!"),
            (2, "x ANN.12@MAIL7.EXAMPLE.ORG y 4876179267539117 z 4876-1792-6753-9117 and 10.20.30.255."),
            (3, "Mrs. Anna Schmidt met Herr Schmidt, Mr. Anna Brown; Госпожа Иванова; 078-05-1120, GB82 WEST 1234 5698 7654 32"),
            (4, "bob@mail7.example.org"), (5, "nothing here 1.2.3 and 12 345"), (6, None), (7, "")]
    got = made(spark, rows)
    a = re.fullmatch(r"Mail ([a-z]{3}\.\d\d)@([a-z]{8}\.example\.com), now\. Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})!", got[1][0])
    assert a and a.group(3, 4, 5) == a.group(6, 7, 8) and got[1][1] == 3
    b = re.fullmatch(r"x ([A-Z]{3}\.\d\d)@([A-Z]{8}\.EXAMPLE\.COM) y (\d{16}) z (\d{4})-(\d{4})-(\d{4})-(\d{4}) and (\d+\.\d+\.\d+\.\d+)\.", got[2][0])
    assert b and b[1].lower() == a[1] and b[2].lower() == a[2] and b[3] == "".join(b.group(4, 5, 6, 7)) and luhn(b[3])
    assert all(0 <= int(x) <= 255 for x in b[8].split(".")) and b[8] != "10.20.30.255"
    c = re.fullmatch(r"Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+) met Herr ([A-Z][a-z]+), Mr\. ([A-Z][a-z]+) ([A-Z][a-z]+); Госпожа ([А-Я][а-я]+); (9\d\d-\d\d-\d{4}), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d)", got[3][0])
    assert c and c[2] == c[3] and c[1].endswith("lia") and c[4].endswith("n") and c[5] != c[2] and got[3][1] == 6
    assert got[4][0].endswith("@" + a[2]) and got[4][0].split("@")[0] != "bob"
    assert got[5] == (rows[4][1], 0) and got[6] == (None, 0) and got[7] == ("", 0)


def test_distinct_entities_stay_distinct(spark):
    # one-letter names under one domain: 26 draws for 30 entities cannot all differ without added letters
    ents = [("email", f"{c}@d.com") for c in "abcdefghijklmnopqrstuvwxyz0123"] + [("ip", f"10.0.{i}.{j}") for i in range(20) for j in range(50)]
    df = spark.createDataFrame(ents, "kind string, norm string")
    rows = surrogates(df.unionByName(df), "k").collect()
    assert len(rows) == len(ents) == len({(r.kind, r.surrogate) for r in rows})
    assert not {(r.kind, r.surrogate) for r in rows} & set(ents)
    other = {(r.kind, r.norm): r.surrogate for r in surrogates(df, "another").collect()}
    assert sum(other[r.kind, r.norm] == r.surrogate for r in rows) < 20


def test_edge_cases_and_columns(spark):
    rows = [(None, "a@b.org c", 5, "x"), (None, "a@b.org c", 5, "x"), (2, "a@b.org", 6, None), (3, "w" * 200000 + " a@b.org", 7, "y"),
            (4, "a." * 50000, 8, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pii int, norm string")
    got = replaced(df)
    assert got.columns == ["doc_id", "text", "norm", "n_pii"]
    out = got.collect()
    assert len(out) == 5 and all("a@b.org" not in r.text for r in out)
    assert len({re.search(r"\S+@\S+", r.text)[0] for r in out if r.doc_id != 4}) == 1
    assert replaced(df.limit(0)).count() == 0


def test_small_table_keeps_everything_else(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in d.collect()}
    after = {r.doc_id: (r.text, r.n_pii) for r in surrogate_texts(d).collect()}
    assert set(before) == set(after)
    shape = lambda t: re.sub(r"[a-z0-9]+", "", t)
    for i, t in before.items():
        text, n = after[i]
        assert (text == t) == (n == 0)
        if "@" not in t:
            assert re.sub(r"[\d.()+ -]", "", text) == re.sub(r"[\d.()+ -]", "", t)
        for x in CARD.findall(t):
            assert x not in text
