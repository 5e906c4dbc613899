"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroute.llm import (
    balance,
    bktree,
    bpe,
    curves,
    decision_list,
    lexical_search,
    pii,
    pu_quality,
    recurrent_lm,
    secret_scan,
    spelling,
    toxicity,
    url_trees,
)
from tallyroute.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judged(table(spark, sf_dir, "pages"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op3_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_fiftieth = F.col("vec_id") % 50 == 0
    return curves.nearest(table(spark, sf_dir, "embeddings"), every_fiftieth)


def op4_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op10_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.scores(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_trees": op1_url_trees,
    "op2_decision_list": op2_decision_list,
    "op3_curves": op3_curves,
    "op4_bktree": op4_bktree,
    "op5_pu_quality": op5_pu_quality,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_balance": op10_balance,
    "op11_lexical_search": op11_lexical_search,
    "op12_recurrent_lm": op12_recurrent_lm,
    "op13_spelling": op13_spelling,
}
