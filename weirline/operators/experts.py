"""Fitted experts as tables, and what becomes of them when an input is off.

An expert has a name, ``fit(blocks) -> model`` and ``predict(rows, model) -> rows with
pred``. The model is a DataFrame of one or many rows per section, fitted on all
train rows; it can be written, read again and applied to any rows with the inputs.

``perturbation`` moves an input by a factor in the test period of the source rows,
derives lags anew and scores the experts, fitted on the rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.functions.columns import weighted_sum
from weirline.operators import ensembles, features, linear, neighbours, splines, trees
from weirline.operators.skill import metric_suite
from weirline.series import Series
from weirline.sources.scratch import cut, stack


@dataclass(frozen=True)
class Expert:
    name: str
    inputs: tuple[str, ...]
    fit: Callable[[DataFrame], DataFrame]
    predict: Callable[[DataFrame, DataFrame], DataFrame]

    def needs_lags(self) -> bool:
        return any("_lag" in c for c in self.inputs)


def line(name: str, inputs: tuple[str, ...], k: int = 3, y: str = "measured_flow") -> Expert:
    """Least squares; a model row is (section_id, beta)."""

    def fit(blocks: DataFrame) -> DataFrame:
        teach = linear.plain_design(blocks.where((F.col("split") == "train") & (F.col("block") < k)), list(inputs)).select("section_id", "split", y, "design")
        # One row per section stands for the block to predict; it adds nothing to the sums.
        ask = teach.groupBy("section_id").agg(F.first("split").alias("split"), F.lit(None).cast("double").alias(y), F.first("design").alias("design"))
        both = stack([teach.withColumn("block", F.lit(-1)), ask.withColumn("block", F.lit(0))])
        return linear.fit_linear(both, len(inputs), y).where("block = 0").select("section_id", "beta")

    def predict(rows: DataFrame, model: DataFrame) -> DataFrame:
        slopes = F.slice("beta", 2, F.size("beta") - 1)
        met = linear.plain_design(rows, list(inputs)).join(model, "section_id")
        return met.withColumn("pred", F.get("beta", F.lit(0)) + weighted_sum(slopes, "design")).drop("beta", "design")

    return Expert(name, inputs, fit, predict)


def nearest_mean(name: str, inputs: tuple[str, ...], near: int = 5, k: int = 3, y: str = "measured_flow") -> Expert:
    """Mean of the nearest train rows; the model is these rows."""

    def fit(blocks: DataFrame) -> DataFrame:
        teach = blocks.where((F.col("split") == "train") & (F.col("block") < k) & F.col(y).isNotNull()).dropna(subset=list(inputs))
        return teach.select("section_id", "date", F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in inputs])

    def predict(rows: DataFrame, model: DataFrame) -> DataFrame:
        # Copies of one day, as of several factors, are searched at once.
        asked = rows.select("section_id", "date", F.lit(0).alias("block"), F.struct(*rows.columns).alias("_row"), *inputs)
        said = neighbours.search(model.withColumn("block", F.lit(-1)), asked, list(inputs), near, F.col("_row"), "y")
        return said.select("kept.*", neighbours.near_mean(near).alias("pred"))

    return Expert(name, inputs, fit, predict)


def tree(name: str, inputs: tuple[str, ...], depth: int | None = None, least: int = 1, k: int = 3, y: str = "measured_flow") -> Expert:
    """One regression tree; the model is its nodes."""

    def fit(blocks: DataFrame) -> DataFrame:
        _, model = trees.grow(blocks, list(inputs), (least,), trees.DEEPEST if depth is None else depth, k, y)
        return model.where(F.col("fold") == k)

    def predict(rows: DataFrame, model: DataFrame) -> DataFrame:
        asked = rows.dropna(subset=list(inputs)).withColumns({"fold": F.lit(k), "least": F.lit(least)})
        return trees.predict(asked, model, list(inputs)).drop("fold", "least").where("pred IS NOT NULL")

    return Expert(name, inputs, fit, predict)


def spline(name: str, inputs: tuple[str, ...], pieces: int = 10, lam: float = 1.0, k: int = 3, y: str = "measured_flow") -> Expert:
    """Additive splines; a model row is knots and coefficients."""

    def fit(blocks: DataFrame) -> DataFrame:
        cases = ensembles.forward_cases(blocks, list(inputs), k, y).where(F.col("fold") == k)
        return splines.fit(cases, len(inputs), (pieces,), (lam,))

    def predict(rows: DataFrame, model: DataFrame) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in inputs])
        asked = rows.dropna(subset=list(inputs)).withColumns({"fold": F.lit(k), "x": x})
        return splines.predict(asked, model, len(inputs)).drop("fold", "x", "splines", "lam")

    return Expert(name, inputs, fit, predict)


def moved(rows: DataFrame, inputs: list[str], factors: tuple[float, ...]) -> DataFrame:
    """Copies of the rows per (input, factor): the input of test rows times the factor, ``y`` the flow as it was."""
    kept = [c for c in rows.columns if c not in ("section_id", "date", "split")]
    test = F.col("split") == "test"

    def copy(name: str, f: float):
        values = [F.when(test, F.col(c) * F.lit(f)).otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in kept]
        return F.struct(F.lit(name).alias("input"), F.lit(f).alias("factor"), F.struct(*values).alias("r"))

    copies = F.explode(F.array(*[copy(c, f) for c in inputs for f in factors]))
    return rows.withColumn("y", F.col("measured_flow")).withColumn("_c", copies).select("section_id", "date", "split", "y", "_c.input", "_c.factor", "_c.r.*")


def _with_lags(copies: DataFrame) -> DataFrame:
    """Lags within each copy of a section: every copy counts as a section of its own."""
    kept = [c for c in copies.columns if c not in ("section_id", "input", "factor", "date", "split", *features.LAGGED, "rainfall")]
    return features.lag_view(copies, Series(keys=("section_id", "input", "factor")), tuple(kept))


def _against_as_is(skill: DataFrame) -> DataFrame:
    """Change of the skill against the factor 1.0 of the same input; inputs without that factor are left out."""
    same = F.col("factor") == 1.0
    whole = Window.partitionBy("section_id", "alg", "input")
    change = {f"d{m}": F.col(m) - F.max(F.when(same, F.col(m))).over(whole) for m in ("NSE", "RMSE")}
    return skill.withColumns({**change, "_known": F.max(same).over(whole)}).where("_known").drop("_known")


def perturbation(
    rows: DataFrame, experts: list[Expert], models: dict[str, DataFrame], inputs: list[str], factors: tuple[float, ...] = (0.9, 1.0, 1.1)
) -> DataFrame:
    """(section_id, alg, input, factor, NSE, RMSE, dNSE, dRMSE) on test rows; 1.0 among the factors is the input as is.

    ``rows`` are read once per expert. They are dealt by section before they are copied, and the copies
    of a section stay together: lags, lines and their metrics need no exchange of copies, and none is written.
    """
    copies = moved(rows.repartition("section_id"), inputs, factors)
    asked = copies.where("split = 'test'")
    lagged = _with_lags(copies).where("split = 'test'")
    if sum(e.needs_lags() for e in experts) > 1:
        lagged = cut(lagged)
    keys = ["section_id", "alg", "input", "factor"]
    found = []
    for e in experts:
        source = lagged if e.needs_lags() else asked
        got = e.predict(source.select("section_id", "date", "y", "input", "factor", *e.inputs), models[e.name])
        said = got.select("section_id", "date", "input", "factor", "y", F.lit(e.name).alias("alg"), "pred")
        found.append(_against_as_is(metric_suite(said, keys, metrics=("NSE", "RMSE"))))
    return stack(found)
