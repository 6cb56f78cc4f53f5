"""Column names and source schemas.

Fixed values: the names below are the data format users already have, so they
are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("section_id", "date")

USES = ("domestic", "agricultural", "industrial", "ecological")
SHARE_USES = ("agricultural", "industrial", "domestic")
SHARE_NAMES = {"agricultural": "ag_share", "industrial": "ind_share", "domestic": "dom_share"}
OBSERVATIONS = ("rainfall", "evaporation", "runoff_measured", "runoff_natural")

FEATURE_COLUMNS = (
    "date", "section_id", "rainfall", "evaporation", "runoff_measured", "runoff_natural",
    "domestic", "agricultural", "industrial", "ecological", "target",
    "season_sin", "season_cos", "I_t", "ag_share", "ind_share", "dom_share",
    "M_nat6", "D_phase",
)
GATE_RAW = ("gate_logQ_t1_raw", "gate_HAI1_t1_raw", "gate_HAI3_t1_raw")
GATE_INPUTS = (
    "season_sin", "season_cos", "gate_logQ_t1", "gate_r_t1",
    "gate_HAI1_t1", "gate_HAI3_t1", "gate_dr_t1",
)
RENAMED = {"runoff_measured": "measured_flow", "runoff_natural": "natural_flow"}
NOT_MODEL_INPUTS = ("date", "section_id", "measured_flow", "target", "U_total")

METRICS = ("NSE", "RMSE", "MAE", "logNSE", "FHV", "FLV")

HYDRO_CSV = T.StructType(
    [T.StructField("section_id", T.StringType()), T.StructField("date", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in OBSERVATIONS]
)
USE_CSV = T.StructType(
    [T.StructField("section_id", T.StringType()), T.StructField("date", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in USES]
)


def require_columns(df, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
