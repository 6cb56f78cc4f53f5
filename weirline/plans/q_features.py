"""Fitted transforms of the gate inputs, correlations, screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.operators import curve
from weirline.plans.common import gated, split_flows, split_panel, tidy
from weirline.plans.oracle import compose, rounded
from weirline.plans.queries import query
from weirline.schema import GATE_INPUTS
from weirline.sources.scratch import cut

KEY = "section_id, date"


@query(
    "agg_fdc_grid",
    compose("SELECT section_id, CAST(step AS integer) AS step, round(ln(q_grid[step + 1]), 9) AS log_q FROM meta, range(101) r(step)"),
)
def agg_fdc_grid(spark, folder):
    train = split_flows(spark, folder).where(F.col("split") == "train")
    return tidy(curve.fit_curve(train).select("section_id", F.posexplode("q_grid").alias("step", "q")).select("section_id", "step", F.ln("q").alias("log_q")), 9)


_SC = ["hai1_mu", "hai1_sd", "hai3_mu", "hai3_sd"]


@query("agg_scaler_fit", compose(f"SELECT section_id, {rounded(_SC)} FROM meta"))
def agg_scaler_fit(spark, folder):
    train = split_panel(spark, folder).where(F.col("split") == "train")
    return tidy(curve.fit_scalers(train).select("section_id", *_SC))


@query("join_meta_apply", compose(f"SELECT {KEY}, {rounded(['gate_r_t1', 'gate_HAI1_t1'])} FROM gated"))
def join_meta_apply(spark, folder):
    rows = cut(split_panel(spark, folder))
    meta = curve.fit_gate_meta(rows.where(F.col("split") == "train"))
    return tidy(curve.apply_gate_meta(rows, meta).select("section_id", "date", "gate_r_t1", "gate_HAI1_t1"))


_RANKS = ["gate_r_t1", "gate_r_t2", "gate_dr_t1"]


@query("win_fdc_rank", compose(f"SELECT {KEY}, {rounded(_RANKS)} FROM gated"))
def win_fdc_rank(spark, folder):
    return tidy(gated(spark, folder).select("section_id", "date", *_RANKS))


@query(
    "win_flow_flags",
    compose(
        f"""SELECT {KEY}, COALESCE(CAST(gate_r_t1 <= 0.30::double AS double), 0.0) AS "gate_LowFlag_t1",
        COALESCE(CAST(gate_r_t1 >= 0.90::double AS double), 0.0) AS "gate_HighFlag_t1" FROM gated"""
    ),
)
def win_flow_flags(spark, folder):
    return curve.flow_flags(gated(spark, folder)).select(
        "section_id", "date", "gate_LowFlag_t1", "gate_HighFlag_t1"
    )


_Z = ["gate_HAI1_t1", "gate_HAI3_t1"]


@query("scalar_tanh_zscore", compose(f"SELECT {KEY}, {rounded(_Z)} FROM gated"))
def scalar_tanh_zscore(spark, folder):
    return tidy(gated(spark, folder).select("section_id", "date", *_Z))


@query("feat_gate_inputs", compose(f"SELECT {KEY}, split, {rounded(['measured_flow', *GATE_INPUTS])} FROM gated"))
def feat_gate_inputs(spark, folder):
    return tidy(curve.gate_inputs(gated(spark, folder)))
