"""Inputs the registered queries share. Everything starts from the tables in ``folder``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.operators import curve, ensemble, features, linear, neighbours, split
from weirline.plans.oracle import KNN_INPUTS, KNN_LAG_INPUTS
from weirline.schema import RENAMED, USES
from weirline.sources import panel
from weirline.sources.scratch import cut, stack


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), as the SQL side does."""
    fixed = {c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    return df.withColumns(fixed) if fixed else df


def joined(spark: SparkSession, folder: str) -> DataFrame:
    return features.join_sources(panel.hydro(spark, folder), panel.water_use(spark, folder))


def gate_ready(spark: SparkSession, folder: str) -> DataFrame:
    """Row features and lagged gate inputs, without the memory column."""
    return features.lagged_gate_inputs(features.row_features(joined(spark, folder)))


def split_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with the train/test split, under the names models use."""
    hydro = panel.hydro(spark, folder).withColumnsRenamed(RENAMED)
    return split.train_test(hydro, panel.station_rules(spark, folder))


def split_panel(spark: SparkSession, folder: str) -> DataFrame:
    full = gate_ready(spark, folder).withColumnsRenamed(RENAMED)
    return split.train_test(full, panel.station_rules(spark, folder))


def gated(spark: SparkSession, folder: str) -> DataFrame:
    return curve.fit_and_apply_gate(split_panel(spark, folder))


def blocks(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    return split.forward_blocks(split_flows(spark, folder), k)


def base_view(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """Base rows with their blocks, written once, for experts that use no lags."""
    return cut(blocks(spark, folder, k))


def two_views(spark: SparkSession, folder: str, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Base rows and lag rows with their blocks.

    The raw records are read and reduced once; every expert starts from the
    written views instead of repeating the scan and the windows.
    """
    return write_views(split_flows(spark, folder), k)


def write_views(rows: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    base = cut(split.forward_blocks(rows, k))
    return base, cut(split.forward_blocks(features.lag_view(base), k))


def expert_predictions(base: DataFrame, lag: DataFrame) -> DataFrame:
    """Out-of-fold and test predictions of the experts that fit all sections in one job."""
    parts = [
        ensemble.phys_predictions(base),
        neighbours.knn_predictions(base, list(KNN_INPUTS), (5,)).drop("k"),
        neighbours.knn_predictions(lag, list(KNN_LAG_INPUTS), (5,), "KNN_LAG").drop("k"),
        linear.line_predictions(base, "natural_flow"),
        linear.line_predictions(lag, "measured_flow_lag1", "MLR_LAG"),
        linear.line_predictions(base, "rainfall", "MLR_RAIN"),
    ]
    return stack(parts)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return expert_predictions(*two_views(spark, folder))


ALGS = ["KNN", "KNN_LAG", "MLR", "MLR_LAG", "MLR_RAIN", "PHYS"]
USE_COLUMNS = list(USES)
