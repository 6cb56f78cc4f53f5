"""Train/test split, forward-chaining folds and held-out tails."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.series import DEFAULT, Series, number


def missing_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Sections that no rule covers."""
    return df.select("section_id").distinct().join(rules, "section_id", "left_anti")


def require_rules(df: DataFrame, rules: DataFrame) -> None:
    """Raise for sections without a rule (a handful of names is enough for the message)."""
    names = [r[0] for r in missing_rules(df, rules).limit(5).collect()]
    if names:
        raise ValueError(f"sections without first_test_year, e.g. {names}")


def train_test(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``split``; sections lacking train or test rows are left out.

    Rules are joined without a broadcast hint: their number grows with the
    sections, and the adaptive planner broadcasts them while they are small.
    """
    year = F.year("date")
    split = F.when(year < F.col("first_test_year"), "train").when(
        year >= F.col("first_test_year"), "test"
    )
    whole = Window.partitionBy("section_id")
    sides = F.count_if(F.col("split") == "train").over(whole), F.count_if(F.col("split") == "test").over(whole)
    return (
        df.join(rules.select("section_id", "first_test_year"), "section_id")
        .withColumn("split", split)
        .withColumns({"train_size": sides[0], "test_size": sides[1]})
        .where((F.col("train_size") > 0) & (F.col("test_size") > 0))
    )


def section_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("section_id").agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
    )


def _block(k: int) -> Column:
    """The fold that validates train row ``pos`` of ``n``, -1 before all folds.

    A section too short to be split is an error.
    """
    n, pos = F.col("n"), F.col("pos")
    step = F.floor(n / F.lit(k + 1))
    start = n - F.lit(k) * step
    short = F.raise_error(F.concat(F.lit(f"{k} folds need more than {k} rows, got "), n)).cast("int")
    return (
        F.when(n <= k, short)
        .when(pos <= start, F.lit(-1))
        .otherwise(F.floor((pos - 1 - start) / step).cast("int"))
    )


def fold_blocks(train: DataFrame, k: int, series: Series = DEFAULT) -> DataFrame:
    """Add ``block``: the fold that validates a row, -1 for the rows before all folds.

    Fold f trains on every block below f, so this one column describes all
    folds without copying rows.
    """
    return number(train, series).withColumn("block", _block(k)).drop("pos", "n")


def forward_blocks(split: DataFrame, k: int, series: Series = DEFAULT) -> DataFrame:
    """``fold_blocks`` on the train rows; test rows get block k (trained on everything)."""
    sides = replace(series, keys=(*series.keys, "split"))
    block = F.when(F.col("split") == "test", F.lit(k)).otherwise(_block(k))
    return number(split, sides).withColumn("block", block).drop("pos", "n")


def cv_folds(train: DataFrame, k: int = 3, series: Series = DEFAULT) -> DataFrame:
    """(section_id, date, fold, role): each row once per fold it takes part in."""
    first = F.greatest(F.col("block"), F.lit(0))
    return (
        fold_blocks(train, k, series)
        .withColumn("fold", F.explode(F.sequence(first, F.lit(k - 1))))
        .select(
            "section_id",
            "date",
            "fold",
            F.when(F.col("block") == F.col("fold"), "val").otherwise("train").alias("role"),
        )
    )


def held_out_tail(df: DataFrame, share: float = 0.8, series: Series = DEFAULT) -> DataFrame:
    """``part`` = 'fit' for the first share of a section's rows, 'check' for the rest."""
    part = F.when(F.col("pos") <= F.floor(F.col("n") * F.lit(share)), "fit").otherwise("check")
    return number(df, series).withColumn("part", part).drop("pos", "n")
