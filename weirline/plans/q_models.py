"""Experts that need a fit, gate training, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import columns as C
from weirline.operators import ensemble, experts, features, forest, gate, linear, reports, sequence, skill, splines, split
from weirline.plans.common import ALGS, base_view, expert_predictions, gated, split_flows, tidy, two_views, write_views
from weirline.plans.oracle import KNN_INPUTS, compose, register, rounded, suite
from weirline.plans.q_skill import matrix_parts, soft_weights, weigh_softly
from weirline.plans.queries import query
from weirline.plans.workflow import Settings, blend_experts, run
from weirline.schema import GATE_INPUTS, METRICS
from weirline.sources import panel, tables
from weirline.sources.scratch import cut, new_path, stack

KEY = "section_id, date"
BASE = list(KNN_INPUTS)
TREE_INPUTS = ["natural_flow", "rainfall", "evaporation", "season_sin", "season_cos"]


def _tree_blocks(spark, folder, k=3):
    return split.forward_blocks(features.season(split_flows(spark, folder)), k)


register(
    "two_sums",
    """SELECT q.section_id, q.date, q.split, q.block, any_value(q.measured_flow) AS y, any_value(q.natural_flow) AS x1,
      any_value(q.rainfall) AS x2, avg(t.measured_flow) AS my, avg(t.natural_flow) AS m1, avg(t.rainfall) AS m2,
      var_pop(t.natural_flow) AS s11, var_pop(t.rainfall) AS s22, covar_pop(t.natural_flow, t.rainfall) AS s12,
      covar_pop(t.natural_flow, t.measured_flow) AS s1y, covar_pop(t.rainfall, t.measured_flow) AS s2y
    FROM based q JOIN based t ON q.section_id = t.section_id AND t.split = 'train' AND t.block < q.block
    WHERE q.block >= 0 GROUP BY 1, 2, 3, 4""",
)


@query(
    "exp_mlr",
    compose(
        f"""SELECT {KEY}, split, 'MLR' AS alg, block, round(y, 6) + 0.0 AS y,
        round(my + (s1y * s22 - s2y * s12) / (s11 * s22 - s12 ** 2) * (x1 - m1)
                 + (s2y * s11 - s1y * s12) / (s11 * s22 - s12 ** 2) * (x2 - m2), 4) + 0.0 AS pred FROM two_sums"""
    ),
)
def exp_mlr(spark, folder):
    base = base_view(spark, folder)
    return tidy(linear.mlr_predictions(base, ["natural_flow", "rainfall"]).withColumn("pred", F.round("pred", 4)))


@query("exp_mlr_many_inputs")
def exp_mlr_many_inputs(spark, folder):
    _, lag = two_views(spark, folder)
    return tidy(linear.mlr_predictions(lag, list(features.LAG_INPUTS), "MLR_LAG"))


def _best_of(tried, names):
    """Predictions of each section's best setting by mean fold score."""
    tried = cut(tried)
    per_fold = skill.scores(ensemble.out_of_fold(tried), ["section_id", *names, "fold"], C.HMEAN_GRID)
    means = per_fold.groupBy("section_id", *names).agg(F.avg("hmean").alias("score"))
    best = ensemble.best_by(means, ["section_id"], "score", names).select("section_id", *names)
    return tried.join(best, ["section_id", *names])


@query("exp_gam")
def exp_gam(spark, folder):
    """Splines in 10 and 20 pieces under three penalties; the best setting of each section."""
    return tidy(_best_of(splines.spline_predictions(base_view(spark, folder), BASE), ["splines", "lam"]))


# The whole grid of every tree expert, one model per section and fold; the setting with the best fold score gives the predictions.
def _tree_expert(name, alg):
    @query(name)
    def fit(spark, folder):
        _, kept, _ = forest.grid_search(cut(_tree_blocks(spark, folder)), TREE_INPUTS, alg)
        return tidy(kept)


for _name, _alg in (("exp_rf", "RF"), ("exp_gb", "GB"), ("exp_lgbm", "LGBM"), ("exp_adab", "AdaB")):
    _tree_expert(_name, _alg)


def _lag_twin(name, alg):
    @query(name)
    def fit(spark, folder):
        _, lag = two_views(spark, folder)
        _, kept, _ = forest.grid_search(lag, list(features.LAG_INPUTS), f"{alg}_LAG")
        return tidy(kept)


for _name, _alg in (
    ("exp_lag_tree_twin", "RF"), ("exp_lag_gb_twin", "GB"), ("exp_lag_lgbm_twin", "LGBM"), ("exp_lag_adab_twin", "AdaB"),
):
    _lag_twin(_name, _alg)


@query("exp_rf_pooled")
def exp_rf_pooled(spark, folder):
    """One forest for all sections, on inputs scaled by section."""
    params = {"numTrees": 100, "maxDepth": 10}
    return tidy(forest.forest_predictions(_tree_blocks(spark, folder), TREE_INPUTS, "RF", params, scope="panel"))


# ---- trees in SQL, level by level; no tree of these sections is as deep as the last level

_LEVELS = 24

_LEAST = (1, 5)


def _tree_views(prefix: str, source: str, inputs: list[str]) -> None:
    """State of every row after each level; the sums, splits and states of a level are views of their own."""
    known = " AND ".join(f"b.{c} IS NOT NULL" for c in inputs)
    register(
        f"{prefix}_rows",
        f"""SELECT b.section_id, b.date, b.split, b.block, b.measured_flow AS y, [{", ".join(inputs)}] AS x, f.fold, b.block < f.fold AND b.split = 'train' AS train
        FROM {source} b JOIN (VALUES (0), (1), (2), (3)) f(fold) ON b.block = f.fold OR (b.block < f.fold AND b.split = 'train') WHERE {known}""",
    )
    register(
        f"{prefix}_state0",
        f"""SELECT r.*, least, 1::bigint AS node, avg(CASE WHEN train THEN y END) OVER (PARTITION BY section_id, fold, least) AS pred
        FROM {prefix}_rows r, (VALUES {", ".join(f"({m})" for m in _LEAST)}) l(least)""",
    )
    node = "section_id, fold, least, node"
    for level in range(_LEVELS):
        register(
            f"{prefix}_sums{level}",
            f"""SELECT {node}, input, x[input] AS value, count(*) AS n, sum(y) AS s, sum(y * y) AS q
            FROM {prefix}_state{level}, range(1, {len(inputs) + 1}) i(input) WHERE train AND node IS NOT NULL GROUP BY ALL""",
        )
        register(
            f"{prefix}_split{level}",
            f"""SELECT {node}, input, (value + following) / 2 AS threshold, ls / ln AS left_value, (ts - ls) / (tn - ln) AS right_value
            FROM (SELECT *, round((ls * ls / ln + (ts - ls) ** 2 / (tn - ln) - ts * ts / tn) / (tq - ts * ts / tn), 9) AS gain
                  FROM (SELECT {node}, input, value, lead(value) OVER o AS following, sum(n) OVER o AS ln, sum(s) OVER o AS ls,
                          sum(n) OVER p AS tn, sum(s) OVER p AS ts, sum(q) OVER p AS tq FROM {prefix}_sums{level}
                        WINDOW o AS (PARTITION BY {node}, input ORDER BY value), p AS (PARTITION BY {node}, input))
                  WHERE following IS NOT NULL AND ln >= least AND tn - ln >= least AND tq - ts * ts / tn > 1e-12 * tq)
            WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY {node} ORDER BY gain DESC, input, value) = 1""",
        )
        register(
            f"{prefix}_state{level + 1}",
            f"""SELECT t.* EXCLUDE (node, pred), CASE WHEN s.input IS NOT NULL THEN t.node * 2 + (x[s.input] > threshold)::integer END AS node,
              CASE WHEN s.input IS NULL THEN pred WHEN x[s.input] > threshold THEN right_value ELSE left_value END AS pred
            FROM {prefix}_state{level} t LEFT JOIN {prefix}_split{level} s
              ON s.section_id = t.section_id AND s.fold = t.fold AND s.least = t.least AND s.node = t.node""",
        )


def _tree_points(prefix: str, alg: str, grid: list[dict]) -> str:
    """Predictions of every setting, from the state after its depth."""
    return " UNION ALL ".join(
        f"SELECT section_id, date, split, '{alg}' AS alg, fold AS block, y, {p}::integer AS point, pred "
        f"FROM {prefix}_state{_LEVELS if g['maxDepth'] is None else g['maxDepth']} WHERE NOT train AND least = {g['minInstancesPerNode']}"
        for p, g in enumerate(grid)
    )


def _tree_choice(prefix: str, source: str, inputs: list[str], alg: str) -> str:
    """Views of the whole grid, and the predictions of each section's best setting."""
    _tree_views(prefix, source, inputs)
    register(f"{prefix}_points", _tree_points(prefix, alg, forest.GRIDS["DT"]))
    register(f"{prefix}_oof", f"SELECT * FROM {prefix}_points WHERE split = 'train'")
    register(f"{prefix}_suite", suite(f"{prefix}_oof", "section_id, point, block"))
    register(
        f"{prefix}_scores",
        f"""SELECT section_id, point, avg(2 * greatest(NSE, 1e-6) * greatest(logNSE, 1e-6) / (greatest(NSE, 1e-6) + greatest(logNSE, 1e-6))) AS score
        FROM {prefix}_suite GROUP BY 1, 2""",
    )
    return compose(
        f"""SELECT {KEY}, split, alg, block, round(y, 6) + 0.0 AS y, round(pred, 2) + 0.0 AS pred FROM {prefix}_points
        SEMI JOIN (SELECT * FROM {prefix}_scores QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round(score, 9) DESC NULLS LAST, point) = 1) s
          ON s.section_id = {prefix}_points.section_id AND s.point = {prefix}_points.point"""
    )


@query("exp_dt", _tree_choice("tree_base", "based", TREE_INPUTS, "DT"))
def exp_dt(spark, folder):
    """Six settings from one growth; the best of each section. Means of two flows often end in a 5: two digits are compared."""
    _, kept, _ = forest.grid_search(cut(_tree_blocks(spark, folder)), TREE_INPUTS, "DT")
    return tidy(kept.withColumn("pred", F.round("pred", 2)))


@query("exp_lag_dt_twin", _tree_choice("tree_lag", "lagblocked", list(features.LAG_INPUTS), "DT_LAG"))
def exp_lag_dt_twin(spark, folder):
    """The same grid on lags."""
    _, lag = two_views(spark, folder)
    _, kept, _ = forest.grid_search(lag, list(features.LAG_INPUTS), "DT_LAG")
    return tidy(kept.withColumn("pred", F.round("pred", 2)))


_SHALLOW = [{"maxDepth": d, "minInstancesPerNode": m} for d in (1, 2) for m in (1, 5)]


@query(
    "exp_dt_shallow",
    compose(f"SELECT {KEY}, split, alg, block, point, round(y, 6) + 0.0 AS y, round(pred, 2) + 0.0 AS pred FROM ({_tree_points('tree_base', 'DT', _SHALLOW)})"),
)
def exp_dt_shallow(spark, folder):
    """Every setting's predictions, from one growth."""
    preds = forest.grid_predictions(cut(_tree_blocks(spark, folder)), TREE_INPUTS, "DT", _SHALLOW)
    return tidy(preds.withColumn("pred", F.round("pred", 2)))


SEQ_INPUTS = ["natural_flow", "rainfall"]


@query("exp_seq")
def exp_seq(spark, folder):
    """Look-backs of 6, 12 and 24 rows under the mixed loss; the best of each section."""
    return tidy(_best_of(sequence.sequence_predictions(cut(split_flows(spark, folder)), SEQ_INPUTS), ["lookback"]))


@query("exp_seq_linear")
def exp_seq_linear(spark, folder):
    windows = features.sequence_windows(split_flows(spark, folder), SEQ_INPUTS, 6)
    cells = {f"{c}_{i}": F.col("window")[i][j] for i in range(6) for j, c in enumerate(SEQ_INPUTS)}
    flat = split.forward_blocks(windows.withColumns(cells).drop("window"), 2)
    return tidy(linear.mlr_predictions(flat, list(cells), "SEQ_MLR"))


@query("cv_grid_search_trees")
def cv_grid_search_trees(spark, folder):
    """Mean fold score of every point of the tree grids, each from as few fits as it takes."""
    blocks = cut(_tree_blocks(spark, folder))
    found = [
        forest.grid_scores(cut(forest.grid_predictions(blocks, TREE_INPUTS, alg, forest.GRIDS[alg]))).withColumn("alg", F.lit(alg))
        for alg in ("DT", "RF", "GB", "AdaB")
    ]
    return tidy(stack(found))


# ---- weighted median behind the boosted expert, on the five chosen experts


@query(
    "agg_weighted_median",
    compose(
        f"""SELECT {KEY}, round(min(v), 6) + 0.0 AS pred FROM (
          SELECT {KEY}, v, sum(w) OVER (PARTITION BY {KEY} ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS upto,
            sum(w) OVER (PARTITION BY {KEY}) AS total FROM soft) WHERE upto >= 0.5::double * total GROUP BY 1, 2"""
    ),
)
def agg_weighted_median(spark, folder):
    rows = soft_weights(spark, folder)
    return tidy(rows.select("section_id", "date", forest.weighted_median("yhat", "w").alias("pred")))


# ---- the gate

NET = {
    "w1": [[0.5, -0.25, 0.1, 0.8, -0.3, 0.2, 0.4], [-0.6, 0.3, 0.05, -0.2, 0.9, -0.1, 0.7]],
    "b1": [0.1, 0.2],
    "w2": [[1.0, -0.5], [0.25, 0.75], [-0.4, 0.6]],
    "b2": [0.0, 0.1, -0.1],
}


def _sql_list(values) -> str:
    return "[" + ", ".join(f"{v!r}::double" for v in values) + "]"


_G = "[" + ", ".join(f"{c}" for c in GATE_INPUTS) + "]"
register("gate_rows", f"SELECT {KEY}, {_G} AS g FROM gated WHERE split = 'test'")
register(
    "gate_hidden",
    f"SELECT {KEY}, ["
    + ", ".join(f"greatest(list_dot_product(g, {_sql_list(w)}) + {b!r}::double, 0)" for w, b in zip(NET["w1"], NET["b1"]))
    + "] AS h FROM gate_rows",
)
register(
    "gate_logits",
    f"SELECT {KEY}, slot, CASE slot "
    + " ".join(
        f"WHEN {i} THEN list_dot_product(h, {_sql_list(w)}) + {b!r}::double" for i, (w, b) in enumerate(zip(NET["w2"], NET["b2"]))
    )
    + " END AS l FROM gate_hidden, range(3) s(slot)",
)


@query(
    "gate_apply",
    compose(
        f"""SELECT {KEY}, CAST(slot AS integer) AS slot,
        round(exp(l / 1.5::double) / sum(exp(l / 1.5::double)) OVER (PARTITION BY {KEY}), 6) AS w FROM gate_logits"""
    ),
)
def gate_apply(spark, folder):
    rows = gated(spark, folder).where(F.col("split") == "test")
    nested = lambda m: F.array(*[F.array(*map(F.lit, r)) for r in m])
    flat = lambda v: F.array(*map(F.lit, v))
    one = rows.withColumns({"w1": nested(NET["w1"]), "b1": flat(NET["b1"]), "w2": nested(NET["w2"]), "b2": flat(NET["b2"])})
    w = gate.gate_weights(F.array(*GATE_INPUTS))
    return tidy(one.select("section_id", "date", F.posexplode(w).alias("slot", "w")))


def _trained(spark, folder):
    """Gate rows, expert predictions and everything the gate gives, for the closed-form experts."""
    base, lag = write_views(gated(spark, folder))
    preds = cut(expert_predictions(base, lag))
    return (preds, *blend_experts(base, preds, Settings()))


@query("gate_train")
def gate_train(spark, folder):
    _, _, gates, _, _ = _trained(spark, folder)
    return tidy(gates.select("section_id", "epochs", "check_loss", F.size("b2").alias("experts")))


@query("gate_train_shared")
def gate_train_shared(spark, folder):
    """One gate for all sections: weights it gives on test rows."""
    base, lag = write_views(gated(spark, folder))
    preds = cut(expert_predictions(base, lag))
    chosen = cut(ensemble.top_experts(ensemble.out_of_fold(preds)))
    matrix = cut(ensemble.expert_matrix(preds, chosen, base))
    usable = cut(ensemble.finite_rows(matrix.where(F.col("split") == "train"), GATE_INPUTS))
    gates = gate.train_shared_gate(usable, GATE_INPUTS)
    ready = ensemble.fill_gate_gaps(ensemble.fill_expert_gaps(matrix), GATE_INPUTS).where(F.col("split") == "test")
    weighed = gate.apply_gates(ready, gates, GATE_INPUTS)
    return tidy(weighed.select("section_id", "date", F.posexplode("w").alias("slot", "w")))


# ---- reports


_soft_cells = ", ".join(
    f"round(max(w) FILTER (WHERE alg = '{a}'), 6) + 0.0 AS \"gate_w_{a}\"" for a in ALGS
)
_test_cells = ", ".join(f"round(max(pred) FILTER (WHERE alg = '{a}'), 6) + 0.0 AS \"pred_{a}\"" for a in ALGS)
register(
    "single_best",
    """SELECT section_id, alg FROM fold_means WHERE alg <> 'PHYS'
    QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY "cv_mean_Hmean" DESC NULLS LAST, alg) = 1""",
)
register("soft_wide", f"SELECT {KEY}, {_soft_cells} FROM soft GROUP BY 1, 2")
register("test_cells", f"SELECT {KEY}, {_test_cells} FROM tests GROUP BY 1, 2")


@query(
    "rep_test_wide",
    compose(
        f"""SELECT {KEY}, 'test' AS "set", round(s.measured_flow, 6) + 0.0 AS measured_flow,
          round(s.natural_flow, 6) + 0.0 AS natural_flow, w.* EXCLUDE (section_id, date), c.* EXCLUDE (section_id, date),
          gate_choice, round(gate_entropy, 6) + 0.0 AS gate_entropy, round(b."pred_MoE", 6) + 0.0 AS "pred_MoE", round(p.pred, 6) + 0.0 AS pred
        FROM blended b JOIN split s USING (section_id, date) JOIN soft_wide w USING (section_id, date)
        JOIN test_cells c USING (section_id, date)
        LEFT JOIN (SELECT t.* FROM tests t JOIN single_best e ON e.section_id = t.section_id AND e.alg = t.alg) p USING (section_id, date)"""
    ),
)
def rep_test_wide(spark, folder):
    preds, _, matrix = matrix_parts(spark, folder)
    blended = ensemble.gate_diagnostics(ensemble.blend(weigh_softly(matrix)))
    return tidy(reports.test_wide(blended, preds, ALGS, reports.best_fitted(preds)))


@query("rep_test_wide_trained")
def rep_test_wide_trained(spark, folder):
    preds, _, _, blended, _ = _trained(spark, folder)
    return tidy(reports.test_wide(blended, preds, ALGS, reports.best_fitted(preds)))


register("equal_blend", 'SELECT section_id, date, split, any_value(y) AS y, avg(v) AS "pred_MoE" FROM filled GROUP BY 1, 2, 3')
register(
    "all_test",
    """SELECT section_id, date, alg, y, pred FROM tests
    UNION ALL SELECT section_id, date, 'MoE', y, "pred_MoE" FROM equal_blend WHERE split = 'test'""",
)
register("all_suite", suite("all_test", "section_id, alg"))
register("sizes", "SELECT DISTINCT section_id, train_size, test_size, first_test_year FROM split")

def _equal_parts(spark, folder):
    """Predictions, equal-weight blend and sizes: reports SQL can follow."""
    base, lag = two_views(spark, folder)
    preds = cut(expert_predictions(base, lag))
    chosen = cut(ensemble.top_experts(ensemble.out_of_fold(preds)))
    full = ensemble.fill_expert_gaps(cut(ensemble.expert_matrix(preds, chosen, base)))
    blended = ensemble.blend(full.withColumn("w", ensemble.equal_weights()))
    sizes = base.select("section_id", "train_size", "test_size", "first_test_year").distinct()
    return preds, chosen, blended, sizes


@query(
    "rep_summary",
    compose(
        f"""SELECT s.section_id, s.alg, {rounded(METRICS)}, round(f."cv_mean_NSE", 6) + 0.0 AS "cv_mean_NSE",
          round(f."cv_mean_Hmean", 6) + 0.0 AS "cv_mean_Hmean", train_size, test_size, first_test_year,
          b.alg IS NOT NULL AS is_best,
          CASE WHEN s.alg = 'MoE' THEN '{{"experts":["' || experts || '"],"gate_cols":["{'","'.join(GATE_INPUTS)}"]}}' ELSE '{{}}' END AS best_params
        FROM all_suite s JOIN sizes USING (section_id)
        JOIN (SELECT section_id, string_agg(alg, '","' ORDER BY place) AS experts FROM top5 GROUP BY 1) t USING (section_id)
        LEFT JOIN (SELECT * FROM fold_means WHERE alg <> 'PHYS') f ON f.section_id = s.section_id AND f.alg = s.alg
        LEFT JOIN single_best b ON b.section_id = s.section_id AND b.alg = s.alg"""
    ),
)
def rep_summary(spark, folder):
    preds, chosen, blended, sizes = _equal_parts(spark, folder)
    return tidy(reports.summary(preds, blended, sizes, reports.moe_params(chosen)))


_OOF_NAMES = {"NSE": "oof_nse", "logNSE": "oof_lognse", "RMSE": "oof_rmse", "FHV": "oof_fhv", "FLV": "oof_flv"}


@query(
    "rep_model_selection",
    compose(
        "SELECT f.section_id, f.alg AS algorithm, "
        + rounded([f"cv_mean_{m}" for m in (*METRICS, "Hmean")]).replace("round(", "round(f.")
        + ", "
        + ", ".join(f"round(o.{m}, 6) + 0.0 AS {n}" for m, n in _OOF_NAMES.items())
        + f""", moe_experts, '{{}}' AS best_params, '{"|".join(GATE_INPUTS)}' AS moe_gate_cols
        FROM fold_means f JOIN oof_suite o ON o.section_id = f.section_id AND o.alg = f.alg
        JOIN (SELECT section_id, string_agg(alg, '|' ORDER BY place) AS moe_experts FROM top5 GROUP BY 1) t ON t.section_id = f.section_id
        WHERE f.alg <> 'PHYS'"""
    ),
)
def rep_model_selection(spark, folder):
    preds, chosen, _, _ = _equal_parts(spark, folder)
    return tidy(reports.model_selection(preds, chosen))


_BEST = [f"TEST_{m}" for m in METRICS]
register(
    "validated",
    """SELECT o.section_id, o.date, o.alg, o.y, o.pred FROM oof o JOIN single_best b ON b.section_id = o.section_id AND b.alg = o.alg
    WHERE o.pred IS NOT NULL""",
)
register(
    "both_sides",
    """SELECT section_id, date, alg, y, pred FROM validated
    UNION ALL SELECT e.section_id, e.date, 'MoE', e.y, e."pred_MoE" FROM equal_blend e JOIN validated v ON v.section_id = e.section_id AND v.date = e.date""",
)
register("both_suite", suite("both_sides", "section_id, alg"))


def _station_best(judged_on: str) -> str:
    """Winner by the scores in ``judged_on``, with its test metrics."""
    return f"""SELECT w.section_id, w.alg, {', '.join(f'w.{m} AS "TEST_{m}"' for m in METRICS)}, w."TEST_Hmean",
      f."cv_mean_NSE", f."cv_mean_Hmean", train_size, test_size, first_test_year, true AS is_best_overall
    FROM (SELECT a.*, 2 * a.NSE * a.logNSE / (a.NSE + a.logNSE + 1e-12) AS "TEST_Hmean"
          FROM all_suite a LEFT JOIN {judged_on} o ON o.section_id = a.section_id AND o.alg = a.alg
          WHERE a.alg = 'MoE' OR EXISTS (SELECT 1 FROM single_best b WHERE b.section_id = a.section_id AND b.alg = a.alg)
          QUALIFY row_number() OVER (PARTITION BY a.section_id
            ORDER BY 2 * o.NSE * o.logNSE / (o.NSE + o.logNSE + 1e-12) DESC NULLS LAST, CASE WHEN a.alg = 'MoE' THEN 1 ELSE 0 END) = 1) w
    JOIN sizes USING (section_id) LEFT JOIN single_best b ON b.section_id = w.section_id AND b.alg = w.alg
    LEFT JOIN fold_means f ON f.section_id = b.section_id AND f.alg = b.alg"""


register("station_best", _station_best("all_suite"))
register("station_best_oof", _station_best("both_suite"))


def _best_sql(source: str) -> str:
    return compose(
        "SELECT section_id, alg, train_size, test_size, first_test_year, is_best_overall, '{}' AS best_params, "
        + ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in (*(f"TEST_{m}" for m in METRICS), "TEST_Hmean", "cv_mean_NSE", "cv_mean_Hmean"))
        + f" FROM {source}"
    )


def _best_table(spark, folder, select_on="test"):
    preds, _, blended, sizes = _equal_parts(spark, folder)
    return tidy(reports.station_best(preds, blended, sizes, select_on=select_on))


@query("rep_station_best", _best_sql("station_best"))
def rep_station_best(spark, folder):
    return _best_table(spark, folder)


@query("rep_station_best_oof", _best_sql("station_best_oof"))
def rep_station_best_oof(spark, folder):
    return _best_table(spark, folder, select_on="oof")


@query("snk_summary_csv", _best_sql("station_best"))
def snk_summary_csv(spark, folder):
    table = _best_table(spark, folder)
    path = new_path(spark, "summary")
    tables.write_summary_csv(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


register(
    "report_rows",
    """SELECT 'train_predictions_oof' AS part, section_id, count(*) AS n FROM split WHERE split = 'train' GROUP BY ALL
    UNION ALL SELECT 'test_predictions', section_id, count(*) FROM split WHERE split = 'test' GROUP BY ALL
    UNION ALL SELECT 'predictions_all', section_id, count(*) FROM split GROUP BY ALL
    UNION ALL SELECT 'summary_one_station', section_id, count(*) FROM all_suite GROUP BY ALL
    UNION ALL SELECT 'model_selection', section_id, count(*) FROM fold_means WHERE alg <> 'PHYS' GROUP BY ALL""",
)


@query("snk_station_report", compose("SELECT part, section_id, n FROM report_rows"))
def snk_station_report(spark, folder):
    """Written and read back: rows per part and section. Timings have no section and are left out here."""
    preds, chosen, blended, sizes = _equal_parts(spark, folder)
    best = cut(reports.best_fitted(preds).select("section_id", "alg"))
    blended = cut(ensemble.gate_diagnostics(blended))
    train = reports.train_oof(blended, preds, best)
    test = reports.test_wide(blended, preds, ALGS, best)
    parts = {
        "train_predictions_oof": train,
        "test_predictions": test,
        "predictions_all": reports.predictions_all(train, test),
        "summary_one_station": reports.summary(preds, blended, sizes),
        "model_selection": reports.model_selection(preds, chosen),
    }
    path = new_path(spark, "report")
    tables.write_report(parts, path)
    counts = []
    for name in parts:
        one = spark.read.parquet(f"{path}/{name}").groupBy("section_id").agg(F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("part"), "section_id", "n")
        counts.append(one)
    return stack(counts)


@query("rep_cv_time")
def rep_cv_time(spark, folder):
    blocks = cut(_tree_blocks(spark, folder))
    seconds = {}
    for alg in forest.GRIDS:
        _, _, seconds[alg] = forest.grid_search(blocks, TREE_INPUTS, alg)
    return reports.cv_time(spark, seconds)


# ---- perturbed inputs

register(
    "shaken",
    "SELECT section_id, date, measured_flow AS y, input, factor, "
    "0.9::double * (CASE WHEN input = 'natural_flow' THEN natural_flow * factor ELSE natural_flow END) "
    "+ 2.0::double * (CASE WHEN input = 'rainfall' THEN rainfall * factor ELSE rainfall END) AS pred "
    "FROM split, (VALUES ('natural_flow'), ('rainfall')) i(input), (VALUES (0.9::double), (1.0::double), (1.1::double)) f(factor) "
    "WHERE split = 'test'",
)
register("shaken_suite", suite("shaken", "section_id, input, factor"))


@query(
    "exp_perturbation",
    compose(
        """SELECT s.section_id, s.input, s.factor, round(s.NSE, 6) + 0.0 AS "NSE", round(s.RMSE, 6) + 0.0 AS "RMSE",
        round(s.NSE - b.NSE, 6) + 0.0 AS "dNSE", round(s.RMSE - b.RMSE, 6) + 0.0 AS "dRMSE"
        FROM shaken_suite s JOIN shaken_suite b ON b.section_id = s.section_id AND b.input = s.input AND b.factor = 1"""
    ),
)
def exp_perturbation(spark, folder):
    rows = split_flows(spark, folder).where(F.col("split") == "test")
    rows = rows.select("section_id", "date", "measured_flow", "natural_flow", "rainfall")

    def score(df):
        return df.withColumn("pred", F.lit(0.9) * F.col("natural_flow") + F.lit(2.0) * F.col("rainfall"))

    return tidy(reports.perturbation(rows, ["natural_flow", "rainfall"], score))


# The fitted experts, rescored through lags: inputs are moved in the test period, models stay.

_MOVED = ("natural_flow", "rainfall", "measured_flow")
_FACTORS = "(VALUES (0.9::double), (1.0::double), (1.1::double)) f(factor)"
register(
    "moved_rows",
    "SELECT section_id, date, split, input, factor, measured_flow AS y, evaporation, "
    + ", ".join(f"CASE WHEN input = '{c}' AND split = 'test' THEN {c} * factor ELSE {c} END AS {c}" for c in _MOVED)
    + f" FROM split, (VALUES {', '.join(f'({c!r})' for c in _MOVED)}) i(input), {_FACTORS}",
)
register(
    "moved_lags",
    """SELECT *, lag(measured_flow) OVER (PARTITION BY section_id, input, factor ORDER BY date) AS measured_flow_lag1,
      lag(natural_flow) OVER (PARTITION BY section_id, input, factor ORDER BY date) AS natural_flow_lag1 FROM moved_rows""",
)
register(
    "moved_near",
    f"""SELECT q.section_id, q.date, q.input, q.factor, q.y, t.measured_flow AS ty,
      row_number() OVER (PARTITION BY q.section_id, q.date, q.input, q.factor
        ORDER BY {" + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in BASE)}, t.date) AS r
    FROM moved_rows q JOIN split t ON q.section_id = t.section_id AND t.split = 'train' WHERE q.split = 'test' QUALIFY r <= 5""",
)


def _moved_line(alg: str, x: str, source: str) -> str:
    return f"""SELECT m.section_id, m.date, m.input, m.factor, m.y, '{alg}' AS alg, a + b * {x} AS pred FROM moved_lags m
      JOIN (SELECT section_id, regr_intercept(measured_flow, {x}) AS a, regr_slope(measured_flow, {x}) AS b FROM {source} WHERE split = 'train' GROUP BY 1) l
        ON l.section_id = m.section_id WHERE m.split = 'test' AND {x} IS NOT NULL"""


register(
    "moved_preds",
    " UNION ALL ".join(
        [
            _moved_line("MLR", "natural_flow", "based"), _moved_line("MLR_LAG", "measured_flow_lag1", "lagblocked"),
            "SELECT section_id, date, input, factor, any_value(y), 'KNN', avg(ty) FROM moved_near GROUP BY section_id, date, input, factor",
        ]
    ),
)
register("moved_suite", suite("moved_preds", "section_id, alg, input, factor"))


@query(
    "exp_perturbation_experts",
    compose(
        """SELECT s.section_id, s.alg, s.input, s.factor, round(s.NSE, 6) + 0.0 AS "NSE", round(s.RMSE, 4) + 0.0 AS "RMSE",
        round(s.NSE - b.NSE, 6) + 0.0 AS "dNSE", round(s.RMSE - b.RMSE, 4) + 0.0 AS "dRMSE"
        FROM moved_suite s JOIN moved_suite b ON b.section_id = s.section_id AND b.alg = s.alg AND b.input = s.input AND b.factor = 1"""
    ),
)
def exp_perturbation_experts(spark, folder):
    """Lines on a present and on a past flow, and neighbours."""
    rows = cut(split_flows(spark, folder))
    base, lag = write_views(rows)
    chosen = [
        experts.line("MLR", ("natural_flow",)), experts.line("MLR_LAG", ("measured_flow_lag1",)), experts.nearest_mean("KNN", KNN_INPUTS),
    ]
    models = {e.name: cut(e.fit(lag if e.needs_lags() else base)) for e in chosen}
    names = ["section_id", "date", "split", "measured_flow", "natural_flow", "rainfall", "evaporation"]
    found = experts.perturbation(rows.select(*names), chosen, models, list(_MOVED))
    return tidy(found.withColumns({c: F.round(c, 4) for c in ("RMSE", "dRMSE")}))


@query("exp_perturbation_trees")
def exp_perturbation_trees(spark, folder):
    """A whole tree on lags and splines on present inputs."""
    rows = cut(split_flows(spark, folder))
    base, lag = write_views(rows)
    chosen = [experts.tree("DT_LAG", features.LAG_INPUTS, least=5), experts.spline("GAM", KNN_INPUTS)]
    models = {e.name: cut(e.fit(lag if e.needs_lags() else base)) for e in chosen}
    names = ["section_id", "date", "split", "measured_flow", "natural_flow", "rainfall", "evaporation"]
    return tidy(experts.perturbation(rows.select(*names), chosen, models, list(_MOVED)))


@query("run_all_sections")
def run_all_sections(spark, folder):
    """From the two source tables to the best choice per section, in one call.

    Sections without a rule, an error in ``run``, are listed by ``join_rules_missing``.
    """
    rules = panel.station_rules(spark, folder)
    hydro, use = [f(spark, folder).join(rules, "section_id", "left_semi") for f in (panel.hydro, panel.water_use)]
    result = run(hydro, use, rules, Settings())
    return tidy(result.tables["summary"])
