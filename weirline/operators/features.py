"""Row features, lag features and windows on the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.functions import columns as C
from weirline.schema import FEATURE_COLUMNS, GATE_RAW, NOT_MODEL_INPUTS, SHARE_NAMES, SHARE_USES, USES
from weirline.series import DEFAULT, Series, exponential_memory, lookback


def join_sources(hydro: DataFrame, use: DataFrame) -> DataFrame:
    """Every observation, with water use where there is some."""
    return hydro.join(use, ["date", "section_id"], "left")


def _flow(df: DataFrame) -> str | None:
    return next((c for c in ("runoff_natural", "runoff_measured") if c in df.columns), None)


def _uses(df: DataFrame) -> list[str]:
    return [c for c in USES if c in df.columns]


def target_gap(df: DataFrame) -> DataFrame:
    if "target" in df.columns or not {"runoff_natural", "runoff_measured"} <= set(df.columns):
        return df
    return df.withColumn("target", F.col("runoff_natural") - F.col("runoff_measured"))


def physical_baseline(df: DataFrame) -> DataFrame:
    return df.withColumn("phys_pred", F.col("runoff_natural"))


def use_intensity(df: DataFrame) -> DataFrame:
    flow, uses = _flow(df), _uses(df)
    if flow is None:
        return df.withColumn("I_t", F.lit(None).cast("double"))
    total = C.row_total(uses) if uses else F.lit(0.0)
    return df.withColumn("I_t", total / C.zero_becomes(C.not_below_zero(flow), 1e-9))


def use_shares(df: DataFrame) -> DataFrame:
    if not set(SHARE_USES) <= set(df.columns):
        return df.withColumns({s: F.lit(None).cast("double") for s in SHARE_NAMES.values()})
    parts = {u: C.not_below_zero(u) for u in SHARE_USES}
    first, second, third = (parts[u] for u in SHARE_USES)
    whole = C.zero_becomes(first + second + third, 1e-9)
    return df.withColumns({SHARE_NAMES[u]: parts[u] / whole for u in SHARE_USES})


def season(df: DataFrame) -> DataFrame:
    sin, cos = C.season_phase("date")
    return df.withColumns({"season_sin": sin, "season_cos": cos})


def drought_phase(df: DataFrame) -> DataFrame:
    dry = (F.col("rainfall") - F.col("evaporation") < 0).cast("int")
    return df.withColumn("D_phase", F.coalesce(dry, F.lit(0)))


def total_use(df: DataFrame) -> DataFrame:
    uses = _uses(df)
    return df.withColumn("U_total", C.row_total(uses) if uses else F.lit(0.0))


def flow_memory(df: DataFrame, series: Series = DEFAULT, alpha: float = 0.2) -> DataFrame:
    return exponential_memory(df, series, _flow(df), "M_nat6", alpha)


def rolling_memory(df: DataFrame, series: Series = DEFAULT, rows: int = 6) -> DataFrame:
    """Plain mean of the last ``rows`` rows, the alternative to ``flow_memory``."""
    flow = _flow(df)

    def add(d, w):
        return d.withColumn("M_nat6", F.avg(flow).over(w.rowsBetween(1 - rows, 0)))

    return lookback(df, series, rows - 1, add)


def lagged_gate_inputs(df: DataFrame, series: Series = DEFAULT) -> DataFrame:
    """Last month's log flow and human-activity ratios (rows, not calendar months)."""
    out = df if "U_total" in df.columns else total_use(df)

    def add(d, w):
        measured = F.lag("runoff_measured", 1).over(w)
        natural = F.lag("runoff_natural", 1).over(w)
        use = F.lag("U_total", 1).over(w)
        below = C.at_least(natural, 1e-6)
        values = (F.log1p(measured), (measured - natural) / below, use / below)
        return d.withColumns(dict(zip(GATE_RAW, values)))

    return lookback(out, series, 1, add)


def column_order(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Known columns that are present, in their fixed order, then ``extra`` ones."""
    return df.select(*[c for c in (*FEATURE_COLUMNS, *extra) if c in df.columns])


def row_features(df: DataFrame) -> DataFrame:
    for step in (target_gap, use_intensity, use_shares, season, drought_phase, total_use):
        df = step(df)
    return df


def engineer(joined: DataFrame, series: Series = DEFAULT) -> DataFrame:
    """The full feature table. All section-wise steps share one exchange."""
    full = lagged_gate_inputs(flow_memory(row_features(joined), series), series)
    return column_order(full, ("U_total", *GATE_RAW))


def model_inputs(names) -> list[str]:
    return [c for c in names if c not in NOT_MODEL_INPUTS and not c.startswith("gate_")]


LAGS = tuple(range(1, 7))
LAGGED = ("measured_flow", "natural_flow")
LAG_INPUTS = tuple(f"{c}_lag{k}" for c in LAGGED for k in LAGS) + ("rainfall", "natural_flow")


def lag_view(df: DataFrame, series: Series = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Six lags of both flows plus current rainfall, natural flow and the columns ``keep``.

    ``df`` holds train and test rows with a ``split`` column, so test rows see
    the train history. Train rows without a full history are left out.
    """

    def add(d, w):
        return d.withColumns(
            {
                f"{c}_lag{k}": F.lag(c, k).over(w)
                for c in LAGGED
                for k in LAGS
            }
        )

    last = LAGS[-1]
    complete = F.col(f"measured_flow_lag{last}").isNotNull() & F.col(f"natural_flow_lag{last}").isNotNull()
    need = df.select(*series.keys, series.order, "split", *LAGGED, "rainfall", *keep)
    return lookback(need, series, last, add).where((F.col("split") == "test") | complete)


def sequence_windows(
    df: DataFrame, features: list[str], length: int, series: Series = DEFAULT
) -> DataFrame:
    """The last ``length`` rows of features at every row that has that many."""

    def add(d, w):
        cell = F.array(*[F.col(c).cast("double") for c in features])
        return d.withColumn("window", F.collect_list(cell).over(w.rowsBetween(1 - length, 0)))

    return lookback(df, series, length - 1, add).where(F.size("window") == length)


def densify_months(df: DataFrame) -> DataFrame:
    """Insert a row for every missing month, so that row lags become calendar lags."""
    span = df.groupBy("section_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    months = span.select(
        "section_id",
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("date"),
    )
    return months.join(df, ["section_id", "date"], "left").select(*df.columns)
