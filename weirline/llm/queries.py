"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.llm import (
    ann, chosen_path, hilbert, html_text, lm_score, merkle, mixing, packing, quality, suffix_dedup, toxicity, url_filter, vector_codes,
)
from weirline.llm.common import table


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


def op2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(table(spark, sf, "documents"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


def op5_chosen_path(spark: SparkSession, sf: str) -> DataFrame:
    return chosen_path.join(table(spark, sf, "documents"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf, "documents"))


def op8_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"))


def op13_hilbert(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.shard(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_html_text, op3_lm_score, op4_quality, op5_chosen_path, op6_mixing, op7_suffix_dedup, op8_ann, op9_toxicity, op10_packing,
        op11_vector_codes, op12_merkle, op13_hilbert,
    )
}
#: The others have no SQL: they are tested against brute force, exact round trips or held-out labels.
SQL: dict[str, str] = {
    "op6_mixing": mixing.SQL, "op11_vector_codes": vector_codes.SQL, "op12_merkle": merkle.SQL, "op13_hilbert": hilbert.SQL,
}
