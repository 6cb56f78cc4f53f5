"""Least squares per section and fold from mergeable sums.

Sums are taken once per (section, block) with a map-side partial aggregate; the
train set of fold f is the merge of the blocks below f, so no row is copied per
fold and only one p*p array per block crosses the network. The small solve runs
on Arrow batches with one row per section.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.functions.columns import bind, weighted_sum


def _products(design: str, y: str, size: int, use: Column) -> Column:
    """All products of (1, inputs, truth) of a row, flat; zeros where the row does not count."""
    values = F.concat(F.array(F.lit(1.0)), F.col(design), F.array(F.col(y).cast("double")))
    rows = bind(values, lambda v: F.flatten(F.transform(v, lambda a: F.transform(v, lambda b: a * b))))
    return F.when(use, rows).otherwise(F.array_repeat(F.lit(0.0), size * size))


def plain_design(blocks: DataFrame, features: list[str]) -> DataFrame:
    """Rows with complete inputs and the inputs as one array column ``design``."""
    return blocks.dropna(subset=features).withColumn(
        "design", F.array(*[F.col(c).cast("double") for c in features])
    )


def _solve(total: np.ndarray, ridge: float, ridge_free: int) -> list[float]:
    """[intercept, slopes] from summed products; the minimum-norm solution for redundant inputs."""
    n, sums = total[0, 0], total[0, 1:]
    mean = sums / n
    centred = total[1:, 1:] - np.outer(sums, mean)
    p = len(mean) - 1
    a, b = centred[:p, :p], centred[:p, p]
    # Unit diagonal before solving: inputs differ in scale by many orders. An
    # input whose spread is lost in rounding is constant and gets no slope.
    spread = np.diag(a)
    flat = spread <= 1e-12 * np.diag(total)[1 : p + 1]
    scale = np.where(flat, np.inf, np.sqrt(np.where(flat, 1.0, spread)))
    unit = a / np.outer(scale, scale)
    penalty = np.zeros(p)
    penalty[ridge_free:] = ridge
    slopes = np.linalg.pinv(unit + np.diag(penalty), rcond=1e-10, hermitian=True) @ (b / scale) / scale
    return [float(mean[p] - slopes @ mean[:p]), *map(float, slopes)]


def fit_linear(
    designed: DataFrame,
    width: int,
    y: str = "measured_flow",
    ridges: tuple[float, ...] = (0.0,),
    ridge_free: int = 0,
) -> DataFrame:
    """(section_id, block, ridge, beta): coefficients from the train blocks below ``block``.

    ``width`` is the number of inputs in ``design``; a ridge spares the first ``ridge_free``.
    """
    size = width + 2
    use = (F.col("split") == "train") & F.col(y).isNotNull()
    summed = (
        designed.select("section_id", "block", array_to_vector(_products("design", y, size, use)).alias("v"))
        .groupBy("section_id", "block")
        .agg(Summarizer.sum(F.col("v")).alias("v"))
        .select("section_id", "block", vector_to_array("v").alias("m"))
    )

    @F.pandas_udf("array<array<double>>")
    def solve(parts: pd.Series) -> pd.Series:
        out = []
        for own in parts:
            total, found = np.zeros((size, size)), []
            for part in own:
                if part["block"] >= 0 and total[0, 0] > 0:
                    found += [[part["block"], r, *_solve(total, r, ridge_free)] for r in ridges]
                total = total + np.asarray(part["m"]).reshape(size, size)
            out.append(found)
        return pd.Series(out)

    # One short list per section: a handful of blocks.
    packed = summed.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("parts"))
    return packed.select("section_id", F.explode(solve("parts")).alias("s")).select(
        "section_id",
        F.col("s")[0].cast("int").alias("block"),
        F.col("s")[1].alias("ridge"),
        F.slice("s", 3, size - 1).alias("beta"),
    )


def predict_linear(designed: DataFrame, betas: DataFrame, alg: str, y: str = "measured_flow") -> DataFrame:
    slopes = F.slice("beta", 2, F.size("beta") - 1)
    return (
        designed.where(F.col("block") >= 0)
        .join(betas, ["section_id", "block"])
        .select(
            "section_id", "date", "split", F.lit(alg).alias("alg"), "block", F.col(y).alias("y"),
            "ridge", (F.col("beta")[0] + weighted_sum(slopes, "design")).alias("pred"),
        )
    )


def mlr_predictions(blocks: DataFrame, features: list[str], alg: str = "MLR", y: str = "measured_flow") -> DataFrame:
    designed = plain_design(blocks, features)
    return predict_linear(designed, fit_linear(designed, len(features), y), alg, y).drop("ridge")


def line_predictions(blocks: DataFrame, feature: str, alg: str = "MLR", y: str = "measured_flow") -> DataFrame:
    """One input: the same fit by built-in aggregates, without leaving the JVM."""
    ready = blocks.dropna(subset=[feature])
    x = F.col(feature).cast("double")
    use = (F.col("split") == "train") & F.col(y).isNotNull()
    tx, ty = F.when(use, x), F.when(use, F.col(y))
    sums = ready.groupBy("section_id", "block").agg(
        F.count(ty).alias("n"), F.avg(tx).alias("mx"), F.avg(ty).alias("my"),
        (F.covar_pop(tx, ty) * F.count(ty)).alias("sxy"), (F.var_pop(tx) * F.count(ty)).alias("sxx"),
    )
    before = Window.partitionBy("section_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("n").over(before)
    mx = F.try_divide(F.sum(F.col("n") * F.col("mx")).over(before), n)
    my = F.try_divide(F.sum(F.col("n") * F.col("my")).over(before), n)
    # Merge of centred sums: within-block parts plus the spread of block means.
    parts = F.collect_list(F.struct("n", "mx", "my", "sxy", "sxx")).over(before)
    merged = sums.withColumns({"_n": n, "_mx": mx, "_my": my, "_parts": parts})

    def spread(a, b, own):
        return F.aggregate(
            "_parts",
            F.lit(0.0),
            lambda acc, s: acc
            + F.coalesce(s[own] + s["n"] * (s[a] - F.col(f"_{a}")) * (s[b] - F.col(f"_{b}")), F.lit(0.0)),
        )

    fitted = merged.where((F.col("block") >= 0) & (F.col("_n") > 0)).withColumns(
        {"_sxx": spread("mx", "mx", "sxx"), "_sxy": spread("mx", "my", "sxy")}
    ).withColumn("_slope", F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.lit(0.0)))
    line = fitted.select("section_id", "block", "_slope", "_mx", "_my")
    return (
        ready.where(F.col("block") >= 0)
        .join(line, ["section_id", "block"])
        .select(
            "section_id", "date", "split", F.lit(alg).alias("alg"), "block", F.col(y).alias("y"),
            (F.col("_my") + F.col("_slope") * (x - F.col("_mx"))).alias("pred"),
        )
    )
