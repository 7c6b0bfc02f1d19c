"""Corpus pipeline over documents: language ID, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``:

1. language: rows whose language cannot be told go (no letter, or no language with two fifths of the words).
   Where nothing can be learned (no lang in the folds to learn from) only null texts and texts without a letter go.
2. near_duplicates: of each group linked by n-gram Jaccard (5 words, 0.8) the row with the smallest
   doc_id stays, with all rows of that id; rows without words link with nothing and stay, as do rows without an id.
3. decontaminate: rows that hold a test item of ``benchmark`` go.
4. secrets: spans of secrets are masked in the text, n_chars follows; no row goes.
5. packing: the packed pieces of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm._subwords import fold
from quire.llm._tables import prepared, stored
from quire.llm.op02_hilbert_packing import pack
from quire.llm.op03_containment import drop_contaminated
from quire.llm.op04_secret_crf import masked
from quire.llm.op06_language_crf import predict, train, with_letters
from quire.llm.op10_prefix_tree_join import classes_and_components

#: Learned models and hash sketches are outside SQL; tests compare the stages with brute force.
ORACLE_SQL = None
LEAST_SHARE = 0.4
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    model = train(docs, fold(3) != 1)
    if not model.langs:                                          # no model, so none that rejects a row
        return with_letters(docs)
    scored = predict(docs, model)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    groups = classes_and_components(docs, WORDS, PERCENT)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    out = masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` and return the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
