"""Skill metrics, folds' means, expert choice and blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import columns as C
from weirline.operators import ensemble, estimators, linear, neighbours, reports, skill
from weirline.plans.common import ALGS, base_view, blocks, expert_predictions, predictions, split_flows, tidy, two_views
from weirline.plans.oracle import KNN_INPUTS, KNN_LAG_INPUTS, compose, register, rounded, suite
from weirline.plans.queries import query
from weirline.schema import METRICS
from weirline.sources.scratch import cut, stack

KEY = "section_id, date"

# One table of metrics per section serves the single-metric checks.
register("phys_test", f"SELECT {KEY}, split, measured_flow AS y, natural_flow AS pred FROM split WHERE split = 'test'")
register("phys_suite", suite("phys_test", "section_id"))
register("oof", "SELECT section_id, date, alg, block AS fold, y, pred FROM preds WHERE split = 'train'")
register("tests", "SELECT section_id, date, alg, y, pred FROM preds WHERE split = 'test'")
register("oof_suite", suite("oof", "section_id, alg"))
register("test_suite", suite("tests", "section_id, alg"))
register("fold_suite", suite("oof", "section_id, alg, fold"))


def _phys(spark, folder):
    test = split_flows(spark, folder).where(F.col("split") == "test")
    return test.select("section_id", "date", F.col("measured_flow").alias("y"), F.col("natural_flow").alias("pred"))


def _metric_query(name, metrics):
    @query(name, compose(f"SELECT section_id, {rounded(metrics)} FROM phys_suite"))
    def run(spark, folder):
        return tidy(skill.metric_suite(_phys(spark, folder), ["section_id"], metrics=tuple(metrics)))


_metric_query("agg_nse", ["NSE"])
_metric_query("agg_log_nse", ["logNSE"])
_metric_query("agg_rmse", ["RMSE"])
_metric_query("agg_mae", ["MAE"])
_metric_query("agg_fhv", ["FHV"])
_metric_query("agg_flv", ["FLV"])
_metric_query("agg_metric_suite", list(METRICS))


@query(
    "agg_log_eps",
    compose(
        """SELECT section_id, round(coalesce(greatest(0.01::double * median(CASE WHEN measured_flow > 0
        THEN measured_flow END), 0.1), 0.1), 4) AS eps FROM split WHERE split = 'train' GROUP BY 1"""
    ),
)
def agg_log_eps(spark, folder):
    train = split_flows(spark, folder).where(F.col("split") == "train")
    return tidy(train.groupBy("section_id").agg(skill.log_offset("measured_flow").alias("eps")), 4)


@query(
    "agg_hmean",
    compose(
        """SELECT section_id,
      round(2 * greatest(NSE, 1e-6) * greatest(logNSE, 1e-6) / (greatest(NSE, 1e-6) + greatest(logNSE, 1e-6)), 6) AS clamp6,
      round(2 * greatest(NSE, 1e-9) * greatest(logNSE, 1e-9) / (greatest(NSE, 1e-9) + greatest(logNSE, 1e-9)), 6) AS clamp9,
      round(2 * NSE * logNSE / (NSE + logNSE + 1e-6), 6) AS raw6,
      round(2 * NSE * logNSE / (NSE + logNSE + 1e-12), 6) AS raw12 FROM phys_suite"""
    ),
)
def agg_hmean(spark, folder):
    two = skill.metric_suite(_phys(spark, folder), ["section_id"], metrics=("NSE", "logNSE"))
    rules = {"clamp6": C.HMEAN_GRID, "clamp9": C.HMEAN_GREEDY, "raw6": C.HMEAN_TOP, "raw12": C.HMEAN_TEST}
    return tidy(two.select("section_id", *[C.harmonic("NSE", "logNSE", **r).alias(n) for n, r in rules.items()]))


_CV = [f"cv_mean_{m}" for m in (*METRICS, "Hmean")]
register(
    "fold_means",
    "SELECT section_id, alg, "
    + ", ".join(f"avg({m}) AS cv_mean_{m}" for m in METRICS)
    + """, avg(2 * greatest(NSE, 1e-6) * greatest(logNSE, 1e-6) / (greatest(NSE, 1e-6) + greatest(logNSE, 1e-6))) AS "cv_mean_Hmean"
    FROM fold_suite GROUP BY 1, 2""",
)


@query("agg_fold_mean", compose(f"SELECT section_id, alg, {rounded(_CV)} FROM fold_means"))
def agg_fold_mean(spark, folder):
    return tidy(skill.fold_means(_oof(spark, folder), ["section_id", "alg"]))


def _oof(spark, folder):
    return ensemble.out_of_fold(predictions(spark, folder)).drop("split")


@query(
    "loss_mse_logmse",
    compose(
        """SELECT section_id, round(avg((pred - y) ** 2) + 0.3::double * avg((ln(greatest(pred, 0) + 1e-3::double)
        - ln(y + 1e-3::double)) ** 2), 3) AS loss FROM phys_test GROUP BY 1"""
    ),
)
def loss_mse_logmse(spark, folder):
    return tidy(skill.mse_logmse(_phys(spark, folder), ["section_id"]), 3)


# ---- predictions of the experts SQL can reproduce

_PRED_COLUMNS = ["section_id", "date", "split", "alg", "block", "y", "pred"]


def _expert_query(name, algs, view, experts):
    listed = ", ".join(f"'{a}'" for a in algs)
    sql = f"SELECT section_id, date, split, alg, block, {rounded(['y', 'pred'])} FROM preds WHERE alg IN ({listed})"

    @query(name, compose(sql))
    def run(spark, folder):
        return tidy(experts(view(spark, folder)).select(*_PRED_COLUMNS))


def _two_lines(base):
    return stack([linear.line_predictions(base, "natural_flow"), linear.line_predictions(base, "rainfall", "MLR_RAIN")])


def _lag_rows(spark, folder):
    return two_views(spark, folder)[1]


def _lag_twins(lag):
    near = neighbours.knn_predictions(lag, list(KNN_LAG_INPUTS), (5,), "KNN_LAG").drop("k")
    return stack([near, linear.line_predictions(lag, "measured_flow_lag1", "MLR_LAG")])


_expert_query("exp_phys", ["PHYS"], blocks, ensemble.phys_predictions)
_expert_query("exp_knn", ["KNN"], base_view, lambda base: neighbours.knn_predictions(base, list(KNN_INPUTS), (5,)))
_expert_query("exp_mlr_one_input", ["MLR", "MLR_RAIN"], base_view, _two_lines)
_expert_query("exp_lag_twins", ["KNN_LAG", "MLR_LAG"], _lag_rows, _lag_twins)


@query(
    "join_knn",
    compose(
        f"SELECT {KEY}, CAST(r AS integer) AS place, n.near_date, round(d, 4) AS d, round(ty, 6) AS near_y "
        "FROM (SELECT section_id, date, r, d, ty, tdate AS near_date FROM near) n WHERE r <= 5"
    ),
)
def join_knn(spark, folder):
    found = neighbours.nearest(blocks(spark, folder), list(KNN_INPUTS), 5)
    rows = found.select("section_id", "date", F.posexplode("near").alias("place", "t"))
    return rows.select(
        "section_id", "date", (F.col("place") + 1).alias("place"), F.col("t.date").alias("near_date"),
        F.round("t.d", 4).alias("d"), F.round("t.y", 6).alias("near_y"),
    )


@query(
    "oof_phys",
    compose(f"SELECT {KEY}, block AS fold, {rounded(['y', 'pred'])} FROM preds WHERE alg = 'PHYS' AND split = 'train'"),
)
def oof_phys(spark, folder):
    return tidy(ensemble.out_of_fold(ensemble.phys_predictions(blocks(spark, folder))).drop("alg", "split"))


@query("oof_predict", compose(f"SELECT {KEY}, alg, fold, {rounded(['y', 'pred'])} FROM oof"))
def oof_predict(spark, folder):
    return tidy(_oof(spark, folder))


@query("final_refit_predict", compose(f"SELECT {KEY}, alg, {rounded(['y', 'pred'])} FROM tests"))
def final_refit_predict(spark, folder):
    test = predictions(spark, folder).where(F.col("split") == "test")
    return tidy(test.select("section_id", "date", "alg", "y", "pred"))


_wide = ", ".join(f"round(max(pred) FILTER (WHERE alg = '{a}'), 6) + 0.0 AS \"pred_{a}\"" for a in ALGS)


@query("join_preds_align", compose(f"SELECT {KEY}, {_wide} FROM preds GROUP BY ALL"))
def join_preds_align(spark, folder):
    return tidy(ensemble.pivot_experts(predictions(spark, folder), ALGS))


# ---- choosing experts

register(
    "experts",
    """SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY hmean DESC NULLS LAST, alg) AS place FROM (
    SELECT section_id, alg, NSE, logNSE, 2 * NSE * logNSE / (NSE + logNSE + 1e-6) AS hmean FROM oof_suite)""",
)
register("top5", "SELECT * FROM experts WHERE place <= 5")


@query("topk_experts", compose(f"SELECT section_id, alg, CAST(place AS integer) AS place, {rounded(['hmean'])} FROM top5"))
def topk_experts(spark, folder):
    return tidy(ensemble.top_experts(_oof(spark, folder)).select("section_id", "alg", "place", "hmean"))


@query("ens_topk", compose("SELECT section_id, string_agg(alg, '|' ORDER BY place) AS experts FROM top5 GROUP BY 1"))
def ens_topk(spark, folder):
    top = ensemble.top_experts(_oof(spark, folder))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "alg"))), lambda s: s["alg"])
    return top.groupBy("section_id").agg(F.concat_ws("|", listed).alias("experts"))


@query(
    "topk_first_model",
    compose(
        """SELECT section_id, alg, round("cv_mean_Hmean", 6) + 0.0 AS "cv_mean_Hmean" FROM fold_means WHERE alg <> 'PHYS'
        QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY "cv_mean_Hmean" DESC NULLS LAST, alg) = 1"""
    ),
)
def topk_first_model(spark, folder):
    means = skill.fold_means(_oof(spark, folder).where(F.col("alg") != "PHYS"), ["section_id", "alg"])
    best = ensemble.best_by(means, ["section_id"], "cv_mean_Hmean", ["alg"])
    return tidy(best.select("section_id", "alg", "cv_mean_Hmean"))


# ---- one grid search: the k of the neighbour expert

register(
    "knn_grid",
    """SELECT section_id, date, block AS fold, k, any_value(y) AS y, avg(ty) AS pred FROM near, (VALUES (3), (5), (7)) g(k)
    WHERE split = 'train' AND r <= k GROUP BY 1, 2, 3, 4""",
)
register("knn_grid_suite", suite("knn_grid", "section_id, k, fold"))
register(
    "knn_grid_score",
    """SELECT section_id, CAST(k AS integer) AS k, avg(2 * greatest(NSE, 1e-6) * greatest(logNSE, 1e-6)
       / (greatest(NSE, 1e-6) + greatest(logNSE, 1e-6))) AS score FROM knn_grid_suite GROUP BY 1, 2""",
)


def _grid_scores(spark, folder):
    oof = ensemble.out_of_fold(neighbours.knn_predictions(blocks(spark, folder), list(KNN_INPUTS)))
    per_fold = skill.scores(oof, ["section_id", "k", "fold"], C.HMEAN_GRID)
    return per_fold.groupBy("section_id", "k").agg(F.avg("hmean").alias("score"))


@query("cv_grid_search", compose(f"SELECT section_id, k, {rounded(['score'])} FROM knn_grid_score"))
def cv_grid_search(spark, folder):
    return tidy(_grid_scores(spark, folder))


@query("cv_forward_validator", compose(f"SELECT section_id, k, {rounded(['score'])} FROM knn_grid_score"))
def cv_forward_validator(spark, folder):
    """The same search through the Estimator, the Evaluator and the validator over forward folds."""
    train = blocks(spark, folder).where(F.col("split") == "train").select("section_id", "date", "block", "measured_flow", *KNN_INPUTS)
    knn = estimators.NeighbourEstimator(inputs=list(KNN_INPUTS))
    sizes = (3, 5, 7)
    found = estimators.ForwardFoldValidator(knn, [{knn.k: k} for k in sizes]).fit(train).scores
    return tidy(found.select("section_id", F.get(F.array(*map(F.lit, sizes)), F.col("point")).alias("k"), "score"))


@query(
    "topk_best_params",
    compose(
        f"""SELECT section_id, k, {rounded(['score'])} FROM knn_grid_score
        QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY score DESC NULLS LAST, knn_grid_score.k) = 1"""
    ),
)
def topk_best_params(spark, folder):
    return tidy(ensemble.best_by(_grid_scores(spark, folder), ["section_id"], "score", ["k"]))


# ---- blending the five chosen experts

register(
    "slots",
    """SELECT b.section_id, b.date, b.split, b.block, b.measured_flow AS y, e.alg, e.place, p.pred
    FROM based b JOIN top5 e USING (section_id)
    LEFT JOIN preds p ON p.section_id = b.section_id AND p.date = b.date AND p.alg = e.alg""",
)
register("slot_means", "SELECT section_id, alg, avg(pred) AS m FROM slots WHERE split = 'train' GROUP BY 1, 2")
register("filled", "SELECT s.*, coalesce(pred, m) AS v FROM slots s JOIN slot_means USING (section_id, alg)")


def matrix_parts(spark, folder):
    """Predictions, chosen experts, and all rows with their predictions, gaps left as nulls."""
    base, lag = two_views(spark, folder)
    preds = cut(expert_predictions(base, lag))
    chosen = cut(ensemble.top_experts(ensemble.out_of_fold(preds)))
    return preds, chosen, ensemble.expert_matrix(preds, chosen, base)


def _matrix(spark, folder):
    return matrix_parts(spark, folder)[2]


@query("agg_col_mean_impute", compose(f"SELECT {KEY}, alg, CAST(place - 1 AS integer) AS slot, round(sign(v) * ln(1 + abs(v)), 9) + 0.0 AS log_v FROM filled"))
def agg_col_mean_impute(spark, folder):
    full = ensemble.fill_expert_gaps(cut(_matrix(spark, folder)))
    # Means of few-digit flows often end in an exact half; their logs never do, and round alike everywhere.
    log_v = (F.signum("c.yhat") * F.ln(1 + F.abs("c.yhat"))).alias("log_v")
    cells = full.select("section_id", "date", F.posexplode(F.arrays_zip("experts", "yhat")).alias("slot", "c"))
    return tidy(cells.select("section_id", "date", F.col("c.experts").alias("alg"), "slot", log_v), 9)


@query(
    "filt_finite_rows",
    compose(
        f"""SELECT {KEY}, round(any_value(y), 6) + 0.0 AS measured_flow FROM slots GROUP BY 1, 2
        HAVING count(*) = count(pred) AND any_value(y) IS NOT NULL"""
    ),
)
def filt_finite_rows(spark, folder):
    kept = ensemble.finite_rows(_matrix(spark, folder), ())
    return tidy(kept.select("section_id", "date", "measured_flow"))


@query(
    "ens_equal_weight",
    compose(f"SELECT {KEY}, round(avg(v), 6) AS \"pred_MoE\" FROM filled WHERE split = 'test' GROUP BY 1, 2"),
)
def ens_equal_weight(spark, folder):
    full = ensemble.fill_expert_gaps(cut(_matrix(spark, folder))).where(F.col("split") == "test")
    return tidy(ensemble.blend(full.withColumn("w", ensemble.equal_weights())).select("section_id", "date", "pred_MoE"))


# Weights with a fixed rule: the softmax of relative closeness of each expert to the baseline flow.
register(
    "soft",
    """SELECT *, exp(l / 1.5::double) / sum(exp(l / 1.5::double)) OVER (PARTITION BY section_id, date) AS w FROM (
      SELECT f.*, -abs(v - b.natural_flow) / b.natural_flow AS l FROM filled f JOIN based b USING (section_id, date)
      WHERE f.split = 'test')""",
)


def soft_weights(spark, folder):
    return weigh_softly(_matrix(spark, folder))


def weigh_softly(matrix):
    full = ensemble.fill_expert_gaps(cut(matrix)).where(F.col("split") == "test")
    logits = F.transform("yhat", lambda v: -F.abs(v - F.col("natural_flow")) / F.col("natural_flow"))
    return full.withColumn("w", C.softmax(logits, 1.5))


@query("gate_softmax", compose(f"SELECT {KEY}, CAST(place - 1 AS integer) AS slot, {rounded(['w'])} FROM soft"))
def gate_softmax(spark, folder):
    return tidy(soft_weights(spark, folder).select("section_id", "date", F.posexplode("w").alias("slot", "w")))


register(
    "blended",
    """SELECT section_id, date, any_value(y) AS y, sum(w * v) AS "pred_MoE", -sum(w * ln(w + 1e-12)) AS gate_entropy,
    CAST(arg_max(place, (w, -place)) - 1 AS integer) AS gate_choice FROM soft GROUP BY 1, 2""",
)


@query("moe_blend", compose(f"SELECT {KEY}, round(\"pred_MoE\", 6) AS \"pred_MoE\" FROM blended"))
def moe_blend(spark, folder):
    return tidy(ensemble.blend(soft_weights(spark, folder)).select("section_id", "date", "pred_MoE"))


@query("gate_choice", compose(f"SELECT {KEY}, gate_choice FROM blended"))
def gate_choice(spark, folder):
    return ensemble.gate_diagnostics(soft_weights(spark, folder)).select("section_id", "date", "gate_choice")


@query("gate_entropy", compose(f"SELECT {KEY}, {rounded(['gate_entropy'])} FROM blended"))
def gate_entropy(spark, folder):
    return tidy(ensemble.gate_diagnostics(soft_weights(spark, folder)).select("section_id", "date", "gate_entropy"))


@query(
    "gate_loss",
    compose(
        """SELECT section_id, round(sum((y - "pred_MoE") ** 2) / greatest(any_value(sst), 1e-6)
             - 0.01::double * avg(gate_entropy), 6) + 0.0 AS gate_loss
        FROM blended JOIN (SELECT section_id, var_pop(y) * count(y) AS sst FROM blended GROUP BY 1) USING (section_id) GROUP BY 1"""
    ),
)
def gate_loss(spark, folder):
    blended = ensemble.blend(soft_weights(spark, folder)).withColumnRenamed("measured_flow", "y")
    return tidy(skill.gate_loss(blended, ["section_id"]))


# ---- single expert against blend

register("moe_suite", suite("blended", "section_id", "y", '"pred_MoE"'))
register(
    "winner",
    """SELECT *, 2 * NSE * logNSE / (NSE + logNSE + 1e-12) AS "TEST_Hmean" FROM (
      SELECT t.* FROM test_suite t JOIN (SELECT section_id, alg FROM fold_means WHERE alg <> 'PHYS'
        QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY "cv_mean_Hmean" DESC NULLS LAST, alg) = 1) b USING (section_id, alg)
      UNION ALL BY NAME SELECT *, 'MoE' AS alg FROM moe_suite)
    QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY "TEST_Hmean" DESC NULLS LAST, CASE WHEN alg = 'MoE' THEN 1 ELSE 0 END) = 1""",
)


@query("topk_winner", compose(f"SELECT section_id, alg, {rounded(METRICS)}, round(\"TEST_Hmean\", 6) + 0.0 AS \"TEST_Hmean\" FROM winner"))
def topk_winner(spark, folder):
    preds, _, matrix = matrix_parts(spark, folder)
    singles = reports.best_fitted(preds).select("section_id", "alg")
    test = preds.where(F.col("split") == "test").join(singles, ["section_id", "alg"])
    one = skill.metric_suite(test, ["section_id", "alg"])
    moe = ensemble.blend(weigh_softly(matrix)).select("section_id", "date", F.col("measured_flow").alias("y"), "pred_MoE")
    two = skill.metric_suite(moe.withColumn("alg", F.lit("MoE")), ["section_id", "alg"], pred="pred_MoE")
    return tidy(ensemble.section_winner(stack([one, two])))


# ---- forward selection


register("solo", "SELECT section_id, alg, 2 * greatest(NSE, 1e-9) * greatest(logNSE, 1e-9) / (greatest(NSE, 1e-9) + greatest(logNSE, 1e-9)) AS score FROM oof_suite")
register("first_pick", "SELECT section_id, alg AS first, score AS base FROM solo QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY score DESC NULLS LAST, alg) = 1")
register(
    "pairs",
    """SELECT o.section_id, o.date, o.alg, o.y, (f.pred * 1 + o.pred) / 2 AS pred FROM oof o JOIN first_pick USING (section_id)
    LEFT JOIN oof f ON f.section_id = o.section_id AND f.date = o.date AND f.alg = first WHERE o.alg <> first""",
)
register("pair_suite", suite("pairs", "section_id, alg"))
register("pair_score", "SELECT section_id, alg, 2 * greatest(NSE, 1e-9) * greatest(logNSE, 1e-9) / (greatest(NSE, 1e-9) + greatest(logNSE, 1e-9)) AS score FROM pair_suite")


@query(
    "ens_greedy_step",
    compose("SELECT section_id, first, alg, round(base, 6) AS base, round(score, 6) AS score FROM pair_score JOIN first_pick USING (section_id)"),
)
def ens_greedy_step(spark, folder):
    oof = cut(_oof(spark, folder))
    return tidy(ensemble.second_choice(oof, ALGS))


_LEAST_GAIN, _CLOSE, _FEWEST, _MOST = 0.01, 0.95, 3, 5
register("grown_1", "SELECT section_id, [first] AS chosen, base AS score, true AS going FROM first_pick")
for _n in range(1, _MOST):
    register(
        f"mean_{_n}",
        f"""SELECT section_id, date, CASE WHEN count(pred) = {_n} THEN sum(pred) / {_n} END AS ens
        FROM oof JOIN grown_{_n} USING (section_id) WHERE list_contains(chosen, alg) GROUP BY 1, 2""",
    )
    register(
        f"mixes_{_n}",
        f"""SELECT o.section_id, o.date, o.alg, o.y, o.pred AS own, ens, (ens * {_n} + o.pred) / {_n + 1} AS pred
        FROM oof o JOIN grown_{_n} g ON g.section_id = o.section_id
        LEFT JOIN mean_{_n} m ON m.section_id = o.section_id AND m.date = o.date WHERE going AND NOT list_contains(chosen, o.alg)""",
    )
    register(f"mix_suite_{_n}", suite(f"mixes_{_n}", "section_id, alg"))
    register(
        f"picks_{_n}",
        f"""SELECT section_id, alg AS pick, score AS pick_score FROM (
          SELECT section_id, alg, 2 * greatest(NSE, 1e-9) * greatest(logNSE, 1e-9) / (greatest(NSE, 1e-9) + greatest(logNSE, 1e-9)) AS score
          FROM mix_suite_{_n}) JOIN (
          SELECT section_id, alg, CASE WHEN count(own + ens) < 3 THEN 1.0::double
            WHEN var_pop(own) FILTER (WHERE ens IS NOT NULL) > 0 AND var_pop(ens) FILTER (WHERE own IS NOT NULL) > 0 THEN corr(own, ens) END AS likeness
          FROM mixes_{_n} GROUP BY 1, 2) USING (section_id, alg)
        WHERE {_n} < {_FEWEST} OR likeness IS NULL OR likeness < {_CLOSE}
        QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY score DESC NULLS LAST, alg) = 1""",
    )
    register(
        f"grown_{_n + 1}",
        f"""SELECT section_id, CASE WHEN taken THEN list_append(chosen, pick) ELSE chosen END AS chosen,
          CASE WHEN taken THEN pick_score ELSE score END AS score, taken AS going
        FROM (SELECT *, going AND coalesce(pick_score - score >= {_LEAST_GAIN}, false) AS taken
              FROM grown_{_n} LEFT JOIN picks_{_n} USING (section_id))""",
    )
register(
    "best_singles",
    f"""SELECT section_id, string_agg(alg, '|' ORDER BY place) AS names FROM (
      SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC NULLS LAST, alg) AS place FROM solo)
    WHERE place <= {_FEWEST} GROUP BY 1""",
)


@query(
    "ens_greedy",
    compose(
        f"""SELECT section_id, CASE WHEN len(chosen) >= {_FEWEST} THEN array_to_string(chosen, '|') ELSE names END AS experts
        FROM grown_{_MOST} JOIN best_singles USING (section_id)"""
    ),
)
def ens_greedy(spark, folder):
    chosen = ensemble.greedy_experts(_oof(spark, folder), ALGS)
    return chosen.select("section_id", F.concat_ws("|", "chosen").alias("experts"))
