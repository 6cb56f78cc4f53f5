"""Sources, sinks, row features, joins, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.operators import features, split
from weirline.plans.common import gate_ready, joined, split_flows, split_panel, tidy
from weirline.plans.oracle import compose, register, rounded
from weirline.plans.queries import query
from weirline.schema import HYDRO_CSV, OBSERVATIONS, RENAMED, USE_CSV, USES
from weirline.series import Series
from weirline.sources import panel, tables
from weirline.sources.scratch import new_path, stack

OBS = ", ".join(OBSERVATIONS)
USE4 = ", ".join(USES)
KEY = "section_id, date"
# Two years per chunk: every section of the panel spans several chunks.
LONG = Series(span_days=731)


def _round_trip(spark, df, schema, name, encoding="UTF-8"):
    """Write a source table as text with YYYYMM months and read it back."""
    path = new_path(spark, name)
    text = df.withColumn("date", F.date_format("date", "yyyyMM")).select(*schema.fieldNames())
    text.write.option("header", True).csv(path)
    return tables.coerce_types(tables.read_source_csv(spark, path, schema, encoding))


@query("src_hydro_csv", compose(f"SELECT {KEY}, {OBS} FROM hydro"))
def src_hydro_csv(spark, folder):
    return _round_trip(spark, panel.hydro(spark, folder), HYDRO_CSV, "hydro")


@query("src_wateruse_csv", compose(f"SELECT {KEY}, {USE4} FROM water"))
def src_wateruse_csv(spark, folder):
    return _round_trip(spark, panel.water_use(spark, folder), USE_CSV, "use")


@query(
    "src_panel_nation",
    """SELECT n_name AS section_id, CAST(date_trunc('month', o_orderdate) AS date) AS date,
       CAST(SUM(CAST(l_quantity AS decimal(18,2))) AS double) AS rainfall,
       CAST(25.5 AS double) * COUNT(*) AS evaporation,
       CAST(SUM(CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(4,2)))) AS double)
           / CAST(100 AS double) AS runoff_measured,
       CAST(SUM(CAST(l_extendedprice AS decimal(18,2))) AS double) / CAST(100 AS double) AS runoff_natural
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2""",
)
def src_panel_nation(spark, folder):
    return panel.hydro_by_nation(spark, folder)


_FEATURES = (
    "date, section_id, D_phase, round(runoff_measured, 6) + 0.0 AS measured_flow, "
    "round(runoff_natural, 6) + 0.0 AS natural_flow, "
    + rounded([*USES, "evaporation", "rainfall", "I_t", "U_total", "ag_share", "dom_share", "ind_share",
               "season_cos", "season_sin", "target"])
)


@query("src_features", compose(f"SELECT {_FEATURES} FROM rowf"))
def src_features(spark, folder):
    return tidy(tables.feature_table(features.row_features(joined(spark, folder))))


@query(
    "snk_features",
    compose(f"SELECT {_FEATURES}, rank FROM rowf JOIN rules USING (section_id)"),
)
def snk_features(spark, folder):
    full = tables.feature_table(features.row_features(joined(spark, folder)))
    ranks = panel.station_rules(spark, folder)
    path = new_path(spark, "features")
    tables.write_features(full, path, ranks)
    return tidy(tables.select_sections(tables.read_features(spark, path), ranks))


@query(
    "proj_coerce_types",
    """SELECT l_orderkey, l_linenumber,
        CAST(try_strptime(CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate, '%Y') || '13'
             WHEN l_returnflag = 'N' THEN 'abc' ELSE strftime(l_shipdate, '%Y%m') END, '%Y%m') AS date) AS date,
        CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_extendedprice END AS rainfall FROM lineitem""",
)
def proj_coerce_types(spark, folder):
    month = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("13")))
        .when(F.col("l_returnflag") == "N", "abc")
        .otherwise(F.date_format("l_shipdate", "yyyyMM"))
    )
    amount = F.when(F.col("l_linestatus") == "F", "missing").otherwise(F.col("l_extendedprice").cast("string"))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return tables.coerce_types(lines.select("l_orderkey", "l_linenumber", month.alias("date"), amount.alias("rainfall")))


@query("join_left_equi", compose(f"SELECT {KEY}, {OBS}, {USE4} FROM joined"))
def join_left_equi(spark, folder):
    return joined(spark, folder)


def _row_query(name, columns, step, source="joined"):
    @query(name, compose(f"SELECT {KEY}, {rounded(columns)} FROM rowf"))
    def run(spark, folder):
        return tidy(step(joined(spark, folder)).select("section_id", "date", *columns))


_row_query("proj_target_gap", ["target"], features.target_gap)
_row_query("feat_use_intensity", ["I_t"], features.use_intensity)
_row_query("feat_use_shares", ["ag_share", "ind_share", "dom_share"], features.use_shares)
_row_query("feat_season", ["season_sin", "season_cos"], features.season)
_row_query("feat_total_use", ["U_total"], features.total_use)


@query("feat_drought_phase", compose(f"SELECT {KEY}, D_phase FROM rowf"))
def feat_drought_phase(spark, folder):
    return features.drought_phase(panel.hydro(spark, folder)).select("section_id", "date", "D_phase")


@query("proj_phys_pred", compose(f"SELECT {KEY}, runoff_natural AS phys_pred FROM hydro"))
def proj_phys_pred(spark, folder):
    return features.physical_baseline(panel.hydro(spark, folder)).select("section_id", "date", "phys_pred")


@query(
    "proj_column_order",
    compose(
        "SELECT date, section_id, D_phase, "
        + rounded([*OBSERVATIONS, *USES, "target", "season_sin", "season_cos", "I_t", "ag_share", "ind_share", "dom_share"])
        + " FROM rowf"
    ),
)
def proj_column_order(spark, folder):
    return tidy(features.column_order(features.row_features(joined(spark, folder))))


@query(
    "proj_model_features",
    compose(
        "SELECT section_id, date, D_phase, round(runoff_natural, 6) + 0.0 AS natural_flow, "
        + rounded([*USES, "evaporation", "rainfall", "I_t", "ag_share", "dom_share", "ind_share", "season_cos", "season_sin"])
        + " FROM lagraw"
    ),
)
def proj_model_features(spark, folder):
    table = tables.feature_table(gate_ready(spark, folder))
    return tidy(table.select("section_id", "date", *features.model_inputs(table.columns)))


@query(
    "filt_train_test_year",
    compose(f"SELECT {KEY}, measured_flow, natural_flow, first_test_year, split, train_size, test_size FROM split"),
)
def filt_train_test_year(spark, folder):
    return split_flows(spark, folder).select(
        "section_id", "date", "measured_flow", "natural_flow", "first_test_year", "split", "train_size", "test_size"
    )


@query("join_rules", compose(f"SELECT {KEY}, runoff_measured, first_test_year, rank FROM hydro JOIN rules USING (section_id)"))
def join_rules(spark, folder):
    rules = panel.station_rules(spark, folder)
    return panel.hydro(spark, folder).select("section_id", "date", "runoff_measured").join(rules, "section_id")


@query(
    "join_rules_missing",
    compose("SELECT DISTINCT section_id FROM hydro WHERE section_id NOT IN (SELECT section_id FROM rules)"),
)
def join_rules_missing(spark, folder):
    # Sections come from the raw records; months play no role here.
    sections = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("section_id")
    )
    return split.missing_rules(sections, panel.station_rules(spark, folder))


@query("agg_distinct_sections", compose("SELECT DISTINCT section_id FROM hydro"))
def agg_distinct_sections(spark, folder):
    return panel.hydro(spark, folder).select("section_id").distinct()


@query("agg_station_sizes", compose("SELECT DISTINCT section_id, train_size, test_size FROM split"))
def agg_station_sizes(spark, folder):
    return split.section_sizes(split_flows(spark, folder))


_GATE_RAW = ["gate_logQ_t1_raw", "gate_HAI1_t1_raw", "gate_HAI3_t1_raw"]


@query("win_lag_gate_raw", compose(f"SELECT {KEY}, {rounded(_GATE_RAW)} FROM lagraw"))
def win_lag_gate_raw(spark, folder):
    total = features.total_use(joined(spark, folder))
    return tidy(features.lagged_gate_inputs(total).select("section_id", "date", *_GATE_RAW))


_LAGGED = [f"{c}_lag{k}" for c in ("measured_flow", "natural_flow") for k in features.LAGS]
_LAG_SQL = compose(f"SELECT {KEY}, split, measured_flow, natural_flow, rainfall, {', '.join(_LAGGED)} FROM lagview")


@query("win_lag6_view", _LAG_SQL)
def win_lag6_view(spark, folder):
    return features.lag_view(split_flows(spark, folder))


@query("win_lag6_view_chunked", _LAG_SQL)
def win_lag6_view_chunked(spark, folder):
    return features.lag_view(split_flows(spark, folder), LONG)


_MEMORY_SQL = compose(f"SELECT {KEY}, {rounded(['M_nat6'])} FROM memory")


@query("win_ewma_memory", _MEMORY_SQL)
def win_ewma_memory(spark, folder):
    flows = panel.hydro(spark, folder).select("section_id", "date", "runoff_natural")
    return tidy(features.flow_memory(flows).drop("runoff_natural"))


@query("win_ewma_memory_chunked", _MEMORY_SQL)
def win_ewma_memory_chunked(spark, folder):
    flows = panel.hydro(spark, folder).select("section_id", "date", "runoff_natural")
    return tidy(features.flow_memory(flows, LONG).drop("runoff_natural"))


@query(
    "win_rolling_mean6",
    compose(
        f"""SELECT {KEY}, {rounded(['M_nat6'])} FROM (SELECT {KEY}, avg(runoff_natural) OVER (PARTITION BY section_id
            ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS M_nat6 FROM hydro)"""
    ),
)
def win_rolling_mean6(spark, folder):
    flows = panel.hydro(spark, folder).select("section_id", "date", "runoff_natural")
    return tidy(features.rolling_memory(flows).drop("runoff_natural"))


_SEQ_SQL = compose(
    f"""SELECT {KEY}, unnest(range(12)) AS step, rains[step + 1] AS rainfall, flows[step + 1] AS natural_flow FROM (
    SELECT {KEY}, array_agg(rainfall) OVER w AS rains, array_agg(runoff_natural) OVER w AS flows FROM hydro
    WINDOW w AS (PARTITION BY section_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE len(rains) = 12"""
)


@query("win_seq_windows", _SEQ_SQL)
def win_seq_windows(spark, folder):
    flows = panel.hydro(spark, folder).withColumnsRenamed(RENAMED)
    windows = features.sequence_windows(flows, ["rainfall", "natural_flow"], 12)
    cells = windows.select("section_id", "date", F.posexplode("window").alias("step", "cell"))
    return cells.select(
        "section_id", "date", F.col("step").cast("long").alias("step"),
        F.col("cell")[0].alias("rainfall"), F.col("cell")[1].alias("natural_flow"),
    )


_FOLDS_SQL = compose(
    f"""SELECT {KEY}, CAST(fold AS integer) AS fold, CASE WHEN block = fold THEN 'val' ELSE 'train' END AS role
    FROM blocked, range(3) f(fold) WHERE split = 'train' AND block <= fold"""
)


@query("win_cv_folds", _FOLDS_SQL)
def win_cv_folds(spark, folder):
    return split.cv_folds(split_flows(spark, folder).where(F.col("split") == "train"), 3)


@query("win_cv_folds_chunked", _FOLDS_SQL)
def win_cv_folds_chunked(spark, folder):
    return split.cv_folds(split_flows(spark, folder).where(F.col("split") == "train"), 3, LONG)


@query(
    "win_holdout_tail",
    compose(
        f"""SELECT {KEY}, CASE WHEN pos <= floor(n * 0.8::double) THEN 'fit' ELSE 'check' END AS part FROM (
        SELECT {KEY}, row_number() OVER (PARTITION BY section_id ORDER BY date) AS pos,
        count(*) OVER (PARTITION BY section_id) AS n FROM split WHERE split = 'train')"""
    ),
)
def win_holdout_tail(spark, folder):
    train = split_flows(spark, folder).where(F.col("split") == "train").select("section_id", "date")
    return split.held_out_tail(train)


@query(
    "sort_panel",
    compose(
        f"""SELECT {KEY}, runoff_measured, row_number() OVER (PARTITION BY section_id ORDER BY date) AS pos FROM hydro"""
    ),
)
def sort_panel(spark, folder):
    from weirline.series import DEFAULT, number

    flows = panel.hydro(spark, folder).select("section_id", "date", "runoff_measured")
    return number(flows, DEFAULT).drop("n")


register(
    "custom_order",
    "SELECT h.section_id, h.date, runoff_measured, rank FROM hydro h LEFT JOIN rules USING (section_id)",
)


@query("sort_custom_order", compose(f"SELECT {KEY}, runoff_measured, COALESCE(rank, 1000000000) AS rank FROM custom_order"))
def sort_custom_order(spark, folder):
    ranks = panel.station_rules(spark, folder).select("section_id", "rank")
    flows = panel.hydro(spark, folder).select("section_id", "date", "runoff_measured")
    ranked = flows.join(ranks, "section_id", "left").withColumn("rank", F.coalesce("rank", F.lit(1_000_000_000)))
    # A range exchange sorts the whole table without one final task.
    return ranked.orderBy("rank", "section_id", "date")


@query("set_union_train_test", compose(f"SELECT {KEY}, split, measured_flow FROM split"))
def set_union_train_test(spark, folder):
    rows = split_flows(spark, folder).select("section_id", "date", "split", "measured_flow")
    return stack([rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")])


@query(
    "set_union_stations",
    compose(
        f"""SELECT {KEY}, split, measured_flow, natural_flow, CASE WHEN split = 'test' THEN rainfall END AS rainfall FROM split"""
    ),
)
def set_union_stations(spark, folder):
    rows = split_flows(spark, folder).select("section_id", "date", "split", "measured_flow", "natural_flow", "rainfall")
    train = rows.where(F.col("split") == "train").drop("rainfall")
    return stack([train, rows.where(F.col("split") == "test")], allow_missing=True)
