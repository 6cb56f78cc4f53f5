"""Build the two monthly source tables from raw delivery records.

One section per supplier. Raw records are reduced to (section, month) sums with
a map-side partial aggregate before anything is shuffled, so a supplier holding
a third of all records still leaves one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _rate(c: str) -> Column:
    return F.col(c).cast("decimal(4,2)")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _section_month(df: DataFrame) -> DataFrame:
    return df.withColumn("section_id", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).withColumn(
        "date", F.trunc("l_shipdate", "month")
    )


def _hundredth(total: Column) -> Column:
    # Exact decimal sums: the result does not depend on the order of the rows.
    return total.cast("double") / F.lit(100.0)


def hydro(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, date, rainfall, evaporation, runoff_measured, runoff_natural."""
    lines = _section_month(_table(spark, folder, "lineitem"))
    price, off = _money("l_extendedprice"), _rate("l_discount")
    return lines.groupBy("section_id", "date").agg(
        F.sum(_money("l_quantity")).cast("double").alias("rainfall"),
        (F.lit(25.5) * F.count("*")).alias("evaporation"),
        _hundredth(F.sum(price * (F.lit(1) - off))).alias("runoff_measured"),
        _hundredth(F.sum(price)).alias("runoff_natural"),
    )


def water_use(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, date, domestic, agricultural, industrial, ecological."""
    lines = _section_month(_table(spark, folder, "lineitem"))
    paid = _money("l_extendedprice") * _rate("l_tax")

    def use(cond: Column) -> Column:
        return _hundredth(F.sum(F.when(cond, paid)))

    return lines.groupBy("section_id", "date").agg(
        use(F.col("l_returnflag") == "A").alias("domestic"),
        use(F.col("l_returnflag") == "N").alias("agricultural"),
        use(F.col("l_returnflag") == "R").alias("industrial"),
        use(F.col("l_linestatus") == "O").alias("ecological"),
    )


def station_rules(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, first_test_year, rank. Suppliers in debt have no rule."""
    return (
        _table(spark, folder, "supplier")
        .where(F.col("s_acctbal") >= 0)
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("section_id"),
            F.when(F.col("s_nationkey") < 12, 2000).otherwise(2001).alias("first_test_year"),
            F.col("s_suppkey").alias("rank"),
        )
    )


def hydro_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """The same observations at the coarser grain nation x order month."""
    lines = _table(spark, folder, "lineitem")
    orders = _table(spark, folder, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("date"))
    price, off = _money("l_extendedprice"), _rate("l_discount")
    by_supplier = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "date")
        .agg(
            F.sum(_money("l_quantity")).alias("q"),
            F.count("*").alias("c"),
            F.sum(price * (F.lit(1) - off)).alias("m"),
            F.sum(price).alias("t"),
        )
    )
    return (
        by_supplier.join(_table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("section_id"), "date")
        .agg(
            F.sum("q").cast("double").alias("rainfall"),
            (F.lit(25.5) * F.sum("c")).alias("evaporation"),
            _hundredth(F.sum("m")).alias("runoff_measured"),
            _hundredth(F.sum("t")).alias("runoff_natural"),
        )
    )
