"""The experts in pyspark.ml's terms: Estimator, Model, Evaluator and a validator over forward folds.

``fit`` takes train rows (section_id, date, the inputs and the label) of any number of
sections and returns a Model that holds the fitted table; ``transform`` adds the prediction
column to any rows with the inputs. ``ForwardFoldValidator`` is to these what
``CrossValidator`` is to others, but trains fold f only on blocks before f and
scores by the harmonic mean of NSE and logNSE per section.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.functions import columns as C
from weirline.operators import experts
from weirline.operators.ensemble import best_by
from weirline.operators.skill import scores
from weirline.sources.scratch import cut, stack


class _SectionParams(Params):
    inputs = Param(Params._dummy(), "inputs", "names of the input columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "name of the label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "name of the prediction column", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="measured_flow", predictionCol="prediction")
        self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class SectionModel(_SectionParams, Model):
    """A fitted expert: ``table`` is all it knows."""

    def __init__(self, expert: experts.Expert, table: DataFrame, **values) -> None:
        super().__init__(**values)
        self.expert, self.table = expert, table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.expert.predict(dataset, self.table).withColumnRenamed("pred", self.value("predictionCol"))


class SectionEstimator(_SectionParams, Estimator):
    """One model per section, fitted in one job."""

    def expert(self) -> experts.Expert:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> SectionModel:
        expert = self.expert()
        train = dataset.withColumns({"split": F.lit("train"), "block": F.lit(-1)})
        names = {n: self.value(n) for n in ("inputs", "labelCol", "predictionCol")}
        return SectionModel(expert, cut(expert.fit(train)), **names)

    def _common(self) -> dict:
        return {"inputs": tuple(self.value("inputs")), "k": 0, "y": self.value("labelCol")}


class LineEstimator(SectionEstimator):
    """Least squares."""

    def expert(self) -> experts.Expert:
        return experts.line("MLR", **self._common())


class NeighbourEstimator(SectionEstimator):
    """Mean of the k nearest train rows."""

    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)

    def __init__(self, **values) -> None:
        super().__init__(**{"k": 5, **values})

    def expert(self) -> experts.Expert:
        return experts.nearest_mean("KNN", near=self.value("k"), **self._common())


class TreeEstimator(SectionEstimator):
    """One regression tree; a depth of 0 is no limit."""

    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level, 0 for no limit", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least train rows of a leaf", TypeConverters.toInt)

    def __init__(self, **values) -> None:
        super().__init__(**{"maxDepth": 0, "minInstancesPerNode": 1, **values})

    def expert(self) -> experts.Expert:
        return experts.tree("DT", depth=self.value("maxDepth") or None, least=self.value("minInstancesPerNode"), **self._common())


class SplineEstimator(SectionEstimator):
    """Additive P-splines."""

    splines = Param(Params._dummy(), "splines", "splines per input", TypeConverters.toInt)
    lam = Param(Params._dummy(), "lam", "weight of the roughness", TypeConverters.toFloat)

    def __init__(self, **values) -> None:
        super().__init__(**{"splines": 10, "lam": 1.0, **values})

    def expert(self) -> experts.Expert:
        return experts.spline("GAM", pieces=self.value("splines"), lam=self.value("lam"), **self._common())


class HmeanEvaluator(Evaluator):
    """Mean over sections and folds of the clamped harmonic mean of NSE and logNSE; the larger the better."""

    labelCol = Param(Params._dummy(), "labelCol", "name of the label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "name of the prediction column", TypeConverters.toString)
    foldCol = Param(Params._dummy(), "foldCol", "name of the fold column; without that column all rows are one fold", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="measured_flow", predictionCol="prediction", foldCol="fold")
        self._set(**values)

    def per_section(self, dataset: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """(section_id, keys, score): mean over folds."""
        fold = [c for c in [self.getOrDefault(self.foldCol)] if c in dataset.columns]
        by = ["section_id", *keys]
        said = scores(dataset, [*by, *fold], C.HMEAN_GRID, y=self.getOrDefault(self.labelCol), pred=self.getOrDefault(self.predictionCol))
        return said.groupBy(*by).agg(F.avg("hmean").alias("score"))

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.per_section(dataset).agg(F.avg("score")).first()[0])

    def isLargerBetter(self) -> bool:
        return True


class ForwardFoldModel(Model):
    """The models of all points that are best for some section, and which section takes which."""

    def __init__(self, models: dict[int, SectionModel], scores: DataFrame, best: DataFrame) -> None:
        super().__init__()
        self.models, self.scores, self.best = models, scores, best

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = []
        for point, model in self.models.items():
            own = self.best.where(F.col("point") == point).select("section_id")
            parts.append(model.transform(dataset.join(own, "section_id", "left_semi")))
        return stack(parts)


class ForwardFoldValidator(Estimator):
    """Every point of the grid over forward folds; each section keeps its best, the earlier of equal ones."""

    def __init__(self, estimator: SectionEstimator, grid: list[dict], evaluator: HmeanEvaluator | None = None, folds: int = 3) -> None:
        super().__init__()
        self.estimator, self.grid, self.evaluator, self.folds = estimator, grid, evaluator or HmeanEvaluator(), folds

    def _fit(self, dataset: DataFrame) -> ForwardFoldModel:
        """dataset: train rows with the column block of ``split.fold_blocks``."""
        rows = cut(dataset)
        said = []
        for point, params in enumerate(self.grid):
            for f in range(self.folds):
                model = self.estimator.fit(rows.where(F.col("block") < f), params)
                said.append(model.transform(rows.where(F.col("block") == f)).withColumns({"fold": F.lit(f), "point": F.lit(point)}))
        found = cut(self.evaluator.per_section(stack(said), ("point",)))
        best = cut(best_by(found, ["section_id"], "score", ["point"]).select("section_id", "point"))
        used = sorted(r["point"] for r in best.select("point").distinct().collect())  # no more than the grid has points
        return ForwardFoldModel({p: self.estimator.fit(rows, self.grid[p]) for p in used}, found, best)
