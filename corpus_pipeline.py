"""From raw documents to training batches: five stages, each written as a table before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.llm import chosen_path, mixing, packing, suffix_dedup, toxicity
from weirline.llm.common import table
from weirline.sources.scratch import cut


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Labels come from the labels table; only texts still in docs serve as examples."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return chosen_path.one_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice leave the texts; n_chars follows the text."""
    cleaned = suffix_dedup.cleaned(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for every document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeated passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Nearest examples, chosen paths and suffix arrays are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
