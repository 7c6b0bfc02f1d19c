"""Language CRF: held-out accuracy, code-switched words, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.op06_language_crf import fold, language_of, predict, train

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet(DOCS), fold(3) != 1, per_lang=120, words=80, rounds=25)


def test_held_out_accuracy(spark, model):
    d = spark.read.parquet(DOCS)
    rows = predict(d, model).where(fold(3) == 1).where("lang is not null").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_of_a_switched_text(spark, model):
    from quire.llm import _text as T
    from quire.llm._chain import marginals
    from quire.llm.op06_language_crf import stream
    d = {r["lang"]: r["text"] for r in spark.read.parquet(DOCS).where("length(text) between 400 and 3000")
         .where(fold(3) == 1).orderBy("doc_id").collect()}
    a, b = " ".join(d["de"].split()[:40]), " ".join(d["es"].split()[:40])
    text = (a + " " + b).lower().encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    group, row, _ = stream(buf, offs)
    first = np.arange(len(row)) == 0
    post = marginals(model.crf.emissions([group], len(row)), first, model.crf.trans, model.crf.start)
    half = len(T.words(*(lambda x: (np.frombuffer(x, np.uint8), np.array([0, len(x)])))(a.lower().encode()), T.PUNCT)[0])
    got = post.argmax(1)
    assert np.mean(got[:half] == model.langs.index("de")) > 0.9
    assert np.mean(got[half:] == model.langs.index("es")) > 0.9


def test_edge_cases(spark, model):
    rows = [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "123 --- !", "x", 1.0), (None, "the of and with", "x", 1.0),
            (4, "…", "x", 1.0), (5, "the of and with", "x", 1.0), (5, "the of and with", "x", 1.0), (6, "der " * 90000, "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred) for r in predict(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "und"), (5, "en"),
                                           (5, "en"), (6, "de")], key=str)


def test_empty_table_and_fold(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_of(empty).count() == 0
    df = spark.createDataFrame([(i, "abc", None) for i in range(30)], "doc_id long, text string, lang string")
    got = language_of(df).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.lang_pred == "und" and r.score == 0 for r in got)
