"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirline.llm.common import tasks
from weirline.sources.scratch import cut


def numbered(df: DataFrame, group: list[str], order: list[str], size: Column | None = None) -> DataFrame:
    """df with rank (0-based place in its group), before (sizes of the rows before it), n and total of its group.

    Rows are dealt into ranges of (group, order); each range adds up its own rows,
    and only these sums, one per range and group, are walked in order. Nulls come
    first. Rows equal in all of order are told apart by a number given once, so
    that any number of them is split over ranges, too. group has no nulls.
    """
    parts = tasks(df.sparkSession)
    sized = df.withColumn("_size", F.lit(1) if size is None else size).withColumn("_tie", F.monotonically_increasing_id())
    # Written before it is dealt: the sample for the ranges and the deal itself read the same numbers.
    known = cut(sized)
    dealt = cut(known.repartitionByRange(parts, *group, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    all_ = Window.partitionBy(*group)
    earlier = all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group, "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before0"),
        F.sum("_n").over(all_).alias("n"), F.sum("_s").over(all_).alias("total"),
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order, "_tie")
    placed = dealt.join(offsets, [*group, "_part"]).select(
        *df.columns, "n", "total",
        (F.col("_rank0") + F.row_number().over(inside) - 1).alias("rank"),
        (F.col("_before0") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("before"),
    )
    return placed
