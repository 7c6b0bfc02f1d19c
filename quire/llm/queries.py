"""Registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm._tables import prepared
from quire.llm.oracle import SQL  # noqa: F401
from quire.sources.tables import read_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(prepared(spark), sf_dir, "documents")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op01_surrogates import surrogate_texts
    return surrogate_texts(_docs(spark, sf_dir))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op02_hilbert_packing import pack
    return pack(_docs(spark, sf_dir))


def op3_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op03_containment import contaminated
    return contaminated(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op04_secret_crf import secrets
    return secrets(_docs(spark, sf_dir))


def op5_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op05_html_trees import main_texts
    return main_texts(read_table(prepared(spark), sf_dir, "pages"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op06_language_crf import language_of
    return language_of(_docs(spark, sf_dir))


def op7_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op07_fixed_blocks import remove_repeats
    return remove_repeats(_docs(spark, sf_dir))


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op08_subword_toxicity import toxicity
    return toxicity(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op9_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op09_mcd_quality import quality
    return quality(_docs(spark, sf_dir))


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op10_prefix_tree_join import classes_and_components
    return classes_and_components(_docs(spark, sf_dir))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op11_source_mixing import mix
    return mix(_docs(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op12_importance_resampling import resample
    return resample(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.op13_multi_index_negatives import hard_negatives
    return hard_negatives(read_table(prepared(spark), sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_hilbert_packing, op3_containment_search, op4_secret_crf, op5_html_trees,
                            op6_language_crf, op7_fixed_block_dedup, op8_subword_toxicity, op9_mcd_quality, op10_prefix_tree_join,
                            op11_source_mixing, op12_importance_resampling, op13_multi_index_negatives)
}
