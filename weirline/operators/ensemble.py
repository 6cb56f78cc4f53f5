"""Choosing, aligning and blending experts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.functions import columns as C
from weirline.operators.skill import log_nse_column, nse_column, prepared, scores
from weirline.series import DEFAULT, Series
from weirline.sources.scratch import cut, spread


def phys_predictions(blocks: DataFrame, y: str = "measured_flow", baseline: str = "natural_flow") -> DataFrame:
    """The physical baseline needs no fit: it is its own prediction."""
    return blocks.where(F.col("block") >= 0).select(
        "section_id", "date", "split", F.lit("PHYS").alias("alg"), "block",
        F.col(y).alias("y"), F.col(baseline).alias("pred"),
    )


def out_of_fold(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("split") == "train").withColumnRenamed("block", "fold")


def ranked_experts(oof: DataFrame, clamp: float | None = None) -> DataFrame:
    """Experts of each section by out-of-fold skill; missing scores last, then by name."""
    rule = dict(C.HMEAN_TOP, clamp=clamp)
    place = Window.partitionBy("section_id").orderBy(F.col("hmean").desc_nulls_last(), "alg")
    return scores(oof, ["section_id", "alg"], rule).withColumn("place", F.row_number().over(place))


def top_experts(oof: DataFrame, k: int = 5, clamp: float | None = None) -> DataFrame:
    return ranked_experts(oof, clamp).where(F.col("place") <= k)


def best_by(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row with the highest score per key; the earlier ``tie`` wins, null scores lose."""
    place = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), *tie)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == 1).drop("_place")


def expert_matrix(preds: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row of ``rows`` with ``experts`` and the aligned array ``yhat``.

    Aligned by key: an expert without a prediction for a row leaves a null in
    its slot. The array has one slot per chosen expert, in order of place.
    """
    names = chosen.groupBy("section_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "alg"))), lambda s: s["alg"]
        ).alias("experts")
    )
    kept = preds.join(chosen.select("section_id", "alg"), ["section_id", "alg"])
    said = kept.groupBy("section_id", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("alg", "pred"))).alias("_said")
    )
    yhat = F.transform("experts", lambda a: F.try_element_at("_said", a))
    return (
        rows.join(names, "section_id")
        .join(said, ["section_id", "date"], "left")
        .withColumn("yhat", yhat)
        .drop("_said")
    )


def pivot_experts(preds: DataFrame, algs: list[str]) -> DataFrame:
    """Wide form pred_<alg>; naming the experts spares a pass to find them."""
    wide = preds.groupBy("section_id", "date").pivot("alg", algs).agg(F.first("pred"))
    return wide.withColumnsRenamed({a: f"pred_{a}" for a in algs})


def _train_mean(value: Column) -> Column:
    """Section mean of the finite train values, as a window value: no join back."""
    known = F.when((F.col("split") == "train") & C.finite(value), value)
    return F.avg(known).over(Window.partitionBy("section_id"))


def fill_expert_gaps(matrix: DataFrame) -> DataFrame:
    """Fill missing predictions with the expert's train mean, in train and test rows alike.

    Sections may have any number of experts: the longest array says how many means are taken.
    """
    slots = matrix.agg(F.max(F.size("yhat"))).first()[0] or 1
    means = F.array(*[_train_mean(F.get(F.col("yhat"), F.lit(i))) for i in range(max(1, slots))])
    filled = F.zip_with("yhat", F.slice("_means", 1, F.size("yhat")), lambda v, m: F.coalesce(v, m))
    return matrix.withColumn("_means", means).withColumn("yhat", filled).drop("_means")


def fill_gate_gaps(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Fill missing gate inputs of test rows with the section's train mean."""
    gap = {c: (F.col("split") == "test") & ~F.coalesce(C.finite(c), F.lit(False)) for c in columns}
    return df.withColumns({c: F.when(gap[c], _train_mean(F.col(c))).otherwise(F.col(c)) for c in columns})


def finite_rows(df: DataFrame, columns: tuple[str, ...], array: str = "yhat", y: str = "measured_flow") -> DataFrame:
    """Rows whose truth, gate inputs and expert predictions are all finite numbers."""
    keep = F.forall(array, lambda v: F.coalesce(C.finite(v), F.lit(False))) & F.coalesce(C.finite(y), F.lit(False))
    for c in columns:
        keep = keep & F.coalesce(C.finite(c), F.lit(False))
    return df.where(keep)


def equal_weights(array: str = "yhat") -> Column:
    size = F.size(array)
    return F.transform(array, lambda _: F.lit(1.0) / size)


def blend(df: DataFrame, weights: str = "w", array: str = "yhat") -> DataFrame:
    return df.withColumn("pred_MoE", C.weighted_sum(weights, array))


def gate_diagnostics(df: DataFrame, weights: str = "w") -> DataFrame:
    return df.withColumns(
        {"gate_choice": C.strongest(weights), "gate_entropy": C.weight_entropy(weights)}
    )


# ---- forward selection of a small equal-weight ensemble

#: Rows of ``_said`` that a task meets on average; a bound on its memory, not on results.
ROWS = 100_000


def _add_expert(wide: DataFrame, state: DataFrame | None, algs: list[str]) -> DataFrame:
    """Score every section x candidate in one grouped pass.

    ``wide`` has one row per (section, date) with the truth and a map of
    predictions, dealt by section; ``state`` holds the chosen list of each section, None: nothing is chosen.
    Candidates are unfolded where the rows are: neither they nor their sums are exchanged.
    """
    none = F.array().cast("array<string>").alias("chosen")
    met = wide.select("*", none) if state is None else wide.join(state.select("section_id", "chosen"), "section_id")
    have = F.size("chosen")
    so_far = F.when(
        have > 0,
        F.aggregate("chosen", F.lit(0.0), lambda acc, a: acc + F.try_element_at("said", a)) / have,
    )
    rows = met.withColumns(
        {"ens": so_far, "alg": F.explode(F.array_except(F.array(*map(F.lit, algs)), "chosen"))}
    )
    own = F.try_element_at("said", F.col("alg"))
    mixed = F.when(have > 0, (F.col("ens") * have + own) / (have + 1)).otherwise(own)
    rows = rows.withColumns({"own": own, "pred": mixed})
    ready = prepared(rows, ["section_id", "alg"], "y", "pred", "date", ranks=False, keep=("own", "ens"))
    both = F.col("own").isNotNull() & F.col("ens").isNotNull()
    a, b = F.when(both, F.col("own")), F.when(both, F.col("ens"))
    close = F.when(F.count(a) < 3, F.lit(1.0)).when(
        (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b))
    )
    score = C.harmonic("NSE", "logNSE", **C.HMEAN_GREEDY)
    return (
        ready.groupBy("section_id", "alg")
        .agg(nse_column().alias("NSE"), log_nse_column().alias("logNSE"), close.alias("corr"))
        .select("section_id", "alg", score.alias("score"), "corr")
    )


def _said(oof: DataFrame) -> DataFrame:
    """One row per (section, date): the truth and a map of the experts' predictions."""
    return oof.groupBy("section_id", "date").agg(
        F.first("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("alg", "pred"))).alias("said")
    )


def _dealt(oof: DataFrame) -> DataFrame:
    """``_said``, written once and dealt by section into tasks whose number grows with the rows."""
    wide = cut(_said(oof))
    return spread(wide, "section_id", least=-(-wide.count() // ROWS))


def _rank(algs: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, algs)), F.col("alg"))


def _singles(wide: DataFrame, algs: list[str]) -> DataFrame:
    return _add_expert(wide, None, algs).withColumn("rank", _rank(algs))


def second_choice(oof: DataFrame, algs: list[str]) -> DataFrame:
    """The first selection step in full: best expert, and every candidate beside it."""
    wide = _dealt(oof)
    best = best_by(_singles(wide, algs), ["section_id"], "score", ["rank"]).select(
        "section_id", F.col("alg").alias("first"), F.col("score").alias("base")
    )
    best = cut(best)
    tried = _add_expert(wide, best.select("section_id", F.array("first").alias("chosen")), algs)
    return best.join(tried, "section_id").select("section_id", "first", "alg", "base", "score")


def greedy_experts(
    oof: DataFrame,
    algs: list[str],
    max_k: int = 5,
    corr_thr: float = 0.95,
    min_k: int = 3,
    min_gain: float = 0.01,
) -> DataFrame:
    """(section_id, chosen): forward selection on out-of-fold skill.

    Starts from the best expert and adds the one that lifts the equal-weight
    mean most, as long as the gain is large enough; once ``min_k`` are in,
    candidates too close to the ensemble are passed over. A section that ends
    with fewer than ``min_k`` gets its ``min_k`` best single experts.
    """
    least = max(min_gain, -0.1)
    wide = _dealt(oof)
    singles = cut(_singles(wide, algs))
    state = best_by(singles, ["section_id"], "score", ["rank"]).select(
        "section_id", F.array("alg").alias("chosen"), "score", F.lit(True).alias("open")
    )
    state = cut(state)
    for size in range(1, max_k):
        tried = _add_expert(wide, state.where("open"), algs)
        if size >= min_k:
            tried = tried.where(F.col("corr").isNull() | (F.col("corr") < corr_thr))
        tried = tried.withColumn("rank", _rank(algs))
        pick = best_by(tried, ["section_id"], "score", ["rank"]).select(
            "section_id", F.col("alg").alias("pick"), F.col("score").alias("pick_score")
        )
        gain = F.col("pick_score") - F.col("score")
        take = F.col("open") & F.coalesce(gain >= least, F.lit(False))
        state = cut(
            state.join(pick, "section_id", "left").select(
                "section_id",
                F.when(take, F.concat("chosen", F.array("pick"))).otherwise(F.col("chosen")).alias("chosen"),
                F.when(take, F.col("pick_score")).otherwise(F.col("score")).alias("score"),
                take.alias("open"),
            )
        )
    order = Window.partitionBy("section_id").orderBy(F.col("score").desc_nulls_last(), "rank")
    top = (
        singles.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= min_k)
        .groupBy("section_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "alg"))), lambda s: s["alg"]).alias("_top"))
    )
    return state.join(top, "section_id").select(
        "section_id", F.when(F.size("chosen") >= min_k, F.col("chosen")).otherwise(F.col("_top")).alias("chosen")
    )


def section_winner(candidates: DataFrame) -> DataFrame:
    """One row per section from the best single expert and the blend.

    The blend wins only with a strictly higher score; without a score for either
    side the single expert stays, with one score its owner wins.
    """
    h = C.harmonic("NSE", "logNSE", **C.HMEAN_TEST)
    scored = candidates.withColumn("TEST_Hmean", h)
    # Within equal scores (and among missing ones) the single expert sorts first.
    blend_last = (F.col("alg") == "MoE").cast("int")
    place = Window.partitionBy("section_id").orderBy(F.col("TEST_Hmean").desc_nulls_last(), blend_last, "alg")
    return scored.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
