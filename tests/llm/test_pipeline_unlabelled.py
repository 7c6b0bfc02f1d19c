"""The language stage where no language can be learned."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlabelled_table_keeps_its_texts(spark):
    texts = ["the of and with this that", "été", "слово", "123 --- !", "", None, "…"]
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts * 3)] + [(None, "words without an id", None, "s", 19)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = P.language(spark, d, "")
    assert got.schema == d.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)


def test_all_rows_in_the_fold_that_is_not_learned_from(spark):
    ids = [r.doc_id for r in spark.range(40).withColumnRenamed("id", "doc_id").where(P.fold(3) == 1).collect()]
    rows = [(i, f"words of text {i}", "en", "s", 9) for i in ids]
    assert P.language(spark, spark.createDataFrame(rows, SCHEMA), "").count() == len(ids) > 0
