"""The training sample where one id holds very many rows."""

import quire.llm.op06_language_crf as op
from pyspark.sql import functions as F


def test_copies_of_an_id_take_one_place(spark, monkeypatch):
    words = {"aa": "alpha apple anchor", "bb": "brown bread butter", "zz": "zebra zinc zero"}
    rows = [(i * 10 + j, f"{words[x]} {i}{j}", x) for j, x in enumerate(words) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = df.where("lang = 'aa'").orderBy(F.xxhash64("doc_id")).first()
    many = df.unionByName(spark.range(200).select(F.lit(hot.doc_id).alias("doc_id"), F.concat(F.lit("alpha copy "), "id").alias("text"),
                                                  F.lit("aa").alias("lang")))
    seen = []
    inner = op.T.raw
    monkeypatch.setattr(op.T, "raw", lambda col: seen.extend(col.to_pylist()) or inner(col))
    model = op.train(many, F.lit(True), per_lang=4, rounds=2)
    assert model.langs == ["aa", "bb", "zz"]
    assert len(seen) == 12                                       # four ids of each language, one row of each
