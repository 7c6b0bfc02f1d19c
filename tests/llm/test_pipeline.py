"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm._tables import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return ({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def survivors(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 10 * len(s & u) >= 8 * len(s | u):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i for i, _ in rows if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(stored(f(spark, out[-1], SF), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "packing"]
    for d in stages[1:5]:
        assert d.schema == stages[0].schema


def test_language_keeps_clean_documents(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[:2])
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    letters = [i for i, t in before.items() if len(re.findall(r"[^\W\d_]+", t or "")) >= 8]
    assert sum(i in after for i in letters) >= 0.99 * len(letters)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == survivors(rows)


def test_leaks_go_and_others_stay(spark, stages):
    from test_op03 import shingles as five
    items = [five(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect()
            if not any(q and 100 * len(q & five(r.text)) >= 80 * len(q) for q in items)}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_secrets_are_masked_and_rows_stay(stages):
    from test_op04 import base
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[3:5])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[i].text) and "[SECRET]" not in r.text:
            assert r.text == before[i].text


def test_packing_holds_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(exact.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda d: sorted(map(tuple, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(P.run(spark, SF)) == key(stages[5])


def test_odd_rows(spark):
    rows = [(None, "text without an id and with words", "en", "s", 33), (1, None, None, None, None), (1, None, None, None, None),
            (2, "", "en", "s", 0), (3, "the of and with this that", "en", "s", 25), (3, "the of and with this that", "en", "s", 25)]
    d = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in P.STAGES[:4]:
        e = f(spark, d.limit(0), SF)
        assert e.schema == d.schema and e.count() == 0
        assert f(spark, d, SF).schema == d.schema
        f(spark, d, SF).collect()
    assert P.packing(spark, d.limit(0), SF).count() == 0
