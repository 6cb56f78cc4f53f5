"""Tree experts, fitted forward in time: one model per section, or one for all.

``scope='section'`` (the default) fits every section and fold by itself, all in one
job, and answers a whole grid from as few fits as it takes (``trees``, ``ensembles``).
``scope='panel'`` is one distributed ``pyspark.ml`` fit for all sections: target and
flow-like inputs are divided by the section's mean train flow, which makes sections comparable.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.functions import columns as C
from weirline.operators import ensembles, jvm, trees
from weirline.operators.ensemble import best_by
from weirline.operators.screening import donors, importance_from_copies
from weirline.operators.skill import scores
from weirline.sources.scratch import cut, spread, stack

UNSCALED = ("season_sin", "season_cos", "I_t", "ag_share", "ind_share", "dom_share", "D_phase")

# The parameter grids. A depth of None is no limit.
GRIDS: dict[str, list[dict]] = {
    "DT": [{"maxDepth": d, "minInstancesPerNode": m} for d in (None, 5, 10) for m in (1, 5)],
    "RF": [{"numTrees": t, "maxDepth": d} for t in (100, 300) for d in (None, 10)],
    "GB": [{"maxIter": n, "maxDepth": d} for n in (100, 300) for d in (2, 3)],
    "LGBM": [
        {"maxIter": n, "stepSize": s, "maxDepth": 5, "minInstancesPerNode": m, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
        for n in (200, 400)
        for s in (0.05, 0.1)
        for m in (5, 20)
    ],
    "AdaB": [{"rounds": n, "rate": r} for n in (100, 300) for r in (0.05, 0.1, 0.2)],
}
#: The deepest tree that pyspark.ml grows.
_POOLED_DEPTH = 30
_MAKERS = {"DT": DecisionTreeRegressor, "RF": RandomForestRegressor, "GB": GBTRegressor, "LGBM": GBTRegressor}


def estimator(alg: str, seed: int = 42, **params):
    if params.get("maxDepth", 0) is None:
        params["maxDepth"] = _POOLED_DEPTH
    return _MAKERS[alg.removesuffix("_LAG")](featuresCol="_x", labelCol="_y", predictionCol="_pred", seed=seed, **params)


def assemble(df: DataFrame, features: list[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def _scales(ready: DataFrame, y: str) -> DataFrame:
    """(section_id, block, _scale): mean train flow known before each block; 1 where that is not above 0."""
    parts = ready.groupBy("section_id", "block").agg(
        F.sum(F.when(F.col("split") == "train", F.col(y))).alias("s"),
        F.count(F.when(F.col("split") == "train", F.col(y))).alias("n"),
    )
    before = Window.partitionBy("section_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("mean", F.try_divide(F.sum("s").over(before), F.sum("n").over(before)))
        .where((F.col("block") >= 0) & F.col("mean").isNotNull())
        .select("section_id", "block", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("_scale"))
    )


def _sets(ready: DataFrame, scales: DataFrame, b: int, features: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """Train and apply rows of block b, scaled and assembled."""
    scale = scales.where(F.col("block") == b).select("section_id", "_scale")
    known = ready.where(
        ((F.col("split") == "train") & (F.col("block") < b) & F.col(y).isNotNull()) | (F.col("block") == b)
    ).join(scale, "section_id")
    inputs = [
        F.col(c).cast("double").alias(f"_f_{c}") if c in UNSCALED else (F.col(c).cast("double") / F.col("_scale")).alias(f"_f_{c}")
        for c in features
    ]
    flat = known.select(
        "section_id", "date", "split", "block", "_scale", F.col(y).alias("y"), (F.col(y) / F.col("_scale")).alias("_y"), *inputs
    )
    ready_x = assemble(flat, [f"_f_{c}" for c in features]).drop(*[f"_f_{c}" for c in features])
    return ready_x.where(F.col("block") < b), ready_x.where(F.col("block") == b)


Fit = Callable[[DataFrame, DataFrame], DataFrame]


def _plain(make: Callable[[], object]) -> Fit:
    def fit(train: DataFrame, rows: DataFrame) -> DataFrame:
        return make().fit(train).transform(rows)

    return fit


def _forward(blocks: DataFrame, features: list[str], fit: Fit, alg: str, k: int, y: str, threads: int) -> DataFrame:
    ready = cut(blocks.dropna(subset=features).select("section_id", "date", "split", "block", y, *features))
    scales = _scales(ready, y)

    def one(b: int) -> DataFrame:
        train, rows = _sets(ready, scales, b, features, y)
        return fit(cut(train), rows).select(
            "section_id", "date", "split", F.lit(alg).alias("alg"), "block", "y",
            (F.col("_pred") * F.col("_scale")).alias("pred"),
        )

    with ThreadPoolExecutor(threads) as pool:
        return stack(pool.map(one, range(k + 1)))


def _in_section(
    blocks: DataFrame, features: list[str], alg: str, grid: list[dict], k: int, y: str, seed: int
) -> DataFrame:
    base = alg.removesuffix("_LAG")
    if base == "DT":
        return trees.tree_predictions(blocks, features, alg, grid, k, y)
    unlimited = [{**g, "maxDepth": ensembles.UNLIMITED} if g.get("maxDepth", 0) is None else g for g in grid]
    return ensembles.staged_predictions(blocks, features, alg, unlimited, k, y, seed)


def grid_predictions(
    blocks: DataFrame,
    features: list[str],
    alg: str,
    grid: list[dict],
    k: int = 3,
    y: str = "measured_flow",
    seed: int = 42,
    scope: str = "section",
    threads: int = 4,
) -> DataFrame:
    """Out-of-fold (blocks below k) and test (block k) predictions of every setting, its number in ``point``."""
    if scope == "section":
        return _in_section(blocks, features, alg, grid, k, y, seed)
    if scope != "panel":
        raise ValueError(f"scope must be section or panel, not {scope}")
    if alg.startswith("AdaB"):
        raise ValueError("AdaBoost is fitted per section only: its weights belong to a section")
    tried = [
        _forward(blocks, features, _plain(lambda params=params: estimator(alg, seed, **params)), alg, k, y, threads)
        .withColumn("point", F.lit(i))
        for i, params in enumerate(grid)
    ]
    return stack(tried)


def forest_predictions(blocks: DataFrame, features: list[str], alg: str, params: dict, k: int = 3, **kw) -> DataFrame:
    """Out-of-fold and test predictions of one setting."""
    return grid_predictions(blocks, features, alg, [params], k, **kw).drop("point")


def grid_scores(preds: DataFrame) -> DataFrame:
    """(section_id, point, score): mean fold score of every setting."""
    per_fold = scores(preds.where(F.col("split") == "train"), ["section_id", "point", "block"], C.HMEAN_GRID)
    return per_fold.groupBy("section_id", "point").agg(F.avg("hmean").alias("score"))


def grid_search(
    blocks: DataFrame, features: list[str], alg: str, grid: list[dict] | None = None, k: int = 3, **kw
) -> tuple[DataFrame, DataFrame, float]:
    """Best setting per section by mean fold score (to nine digits, the earlier of equal ones), its predictions, and the seconds spent.

    Fold predictions are made once: they score the grid, and those of the best
    setting are the out-of-fold predictions.
    """
    began = time.perf_counter()
    grid = grid if grid is not None else GRIDS[alg.removesuffix("_LAG")]
    preds = cut(grid_predictions(blocks, features, alg, grid, k, **kw))
    best = cut(best_by(grid_scores(preds).withColumn("score", F.round("score", 9)), ["section_id"], "score", ["point"]))
    kept = preds.join(best.select("section_id", "point"), ["section_id", "point"]).drop("point")
    return best, kept, time.perf_counter() - began


# ---- the weighted median behind AdaBoost.R2, as a column


def weighted_median(values, weights) -> Column:
    """First value, in ascending order, at which half of the total weight is reached."""
    pairs = F.array_sort(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("hit"))

    def walk(acc, p):
        upto = acc["sum"] + p["w"]
        reached = acc["hit"].isNull() & (upto >= F.lit(0.5) * total)
        return F.struct(upto.alias("sum"), F.when(reached, p["v"]).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(pairs, start, walk, lambda acc: acc["hit"])


# ---- stability screening with two kinds of trees


def stability_importances(
    blocks: DataFrame,
    features: list[str],
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4),
    k: int = 3,
    repeats: int = 8,
    models: dict[str, dict] | None = None,
    y: str = "measured_flow",
) -> DataFrame:
    """(section_id, seed, model, fold, feature, importance) over seeds x models x folds.

    Every seed counts as k folds of its own, so one job per model fits all seeds, folds
    and sections and scores all permuted copies on the way. Rows travel with the rows
    they take values from; the copies exist only in the task that predicts them.
    """
    models = models or {
        "RF": {"numTrees": 200, "maxDepth": None},
        "LGBM": {"maxIter": 400, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20},
    }
    ready = blocks.where(F.col("split") == "train").dropna(subset=[*features, y])
    ready = cut(ready.select("section_id", "date", "block", F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]))
    x = F.array(*[F.col(c) for c in features])
    each = F.explode(F.array(*[F.lit(i * k) for i in range(len(seeds))]))
    later = F.sequence(F.greatest(F.col("block") + 1, F.lit(0)), F.lit(k - 1))
    teach = (
        ready.where(F.col("block") < k - 1)
        .withColumn("_first", each)
        .select("section_id", F.explode(F.transform(later, lambda f: F.col("_first") + f)).alias("fold"), F.unix_date("date").alias("tag"), "y", x.alias("x"))
    )
    asked = ready.where("block >= 0").withColumn("_first", each).withColumn("fold", F.col("_first") + F.col("block")).drop("_first")
    drawn = donors(asked, features, 0, repeats, ["section_id", "fold"])
    flat = lambda c: F.array(*[F.col(c)[f] for f in features])
    rows = drawn.select("section_id", "fold", F.struct(F.unix_date("date").alias("tag"), "repeat", "y", flat("own").alias("own"), flat("donor").alias("donor")).alias("r"))
    taught = teach.select("section_id", "fold", F.struct("tag", "y", "x").alias("t"))
    both = stack([taught, rows], allow_missing=True).groupBy("section_id", "fold").agg(F.sort_array(F.collect_list("t")).alias("t"), F.sort_array(F.collect_list("r")).alias("r"))
    packs = cut(both)

    def run(name: str) -> DataFrame:
        params = models[name]
        params = {**params, "maxDepth": ensembles.UNLIMITED} if params["maxDepth"] is None else params
        # Rows of a repeated day are added up where trees come from several chunks, as in ensembles.
        chunks = params.get("numTrees", 1) > ensembles.CHUNK
        again = F.transform("r", lambda v, i: F.lit(chunks) & (i > 0) & (v["tag"] == F.get("r", i - 1)["tag"]) & (v["repeat"] == F.get("r", i - 1)["repeat"]))
        said = jvm.copies(
            blocks.sparkSession, name, ensembles.settings(name, params, 42), params.get("numTrees", 1), 42, len(features), "section_id", "fold",
            "t.y", F.flatten("t.x"), F.flatten("r.own"), F.flatten("r.donor"), F.transform("r.repeat", lambda n: n == 0), again,
        )
        found = spread(packs, "section_id", F.xxhash64("fold")).select("section_id", F.col("fold").alias("run"), F.col("r.y").alias("y"), F.col("r.repeat").alias("repeat"), said.alias("preds"))
        row, place = F.expr(f"pos div {len(features) + 1}").cast("int"), F.col("pos") % (len(features) + 1)
        scored = (
            found.select("section_id", "run", "y", "repeat", F.posexplode("preds").alias("pos", "pred"))
            .select("section_id", "run", F.get("y", row).alias("y"), "pred", F.get("repeat", row).alias("repeat"), F.when(place > 0, F.get(F.array(*map(F.lit, features)), place - 1)).alias("shuffled"))
            .where("(shuffled IS NOT NULL OR repeat = 0) AND NOT isnan(pred)")
        )
        seed = F.get(F.array(*map(F.lit, seeds)), F.expr(f"run div {k}").cast("int"))
        return cut(
            importance_from_copies(scored, ["section_id", "run"])
            .withColumns({"seed": seed, "model": F.lit(name), "fold": F.pmod("run", F.lit(k))})
            .drop("run")
        )

    return stack([run(name) for name in models])
