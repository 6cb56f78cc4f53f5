"""Skill of predictions, grouped by any keys, in one exchange.

Input is long: one row per prediction with the truth beside it. Rows missing
either side do not count; a group without usable rows keeps null metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirline.functions import columns as C
from weirline.schema import METRICS

HIGH_SHARE = 0.02
LOW_SHARE = 0.30


def log_offset(y, over: WindowSpec | None = None) -> Column:
    """A hundredth of the median positive truth, at least 0.1; an aggregate, or a window value."""
    y = C.col(y)
    middle = F.percentile(F.when(y > 0, y), F.lit(0.5))
    if over is not None:
        middle = middle.over(over)
    return F.coalesce(F.greatest(F.lit(0.01) * middle, F.lit(0.1)), F.lit(0.1))


def _efficiency(error: Column, spread: Column) -> Column:
    return F.when(spread > 0, F.lit(1.0) - error / spread)


def _volume_bias(rank: str, share: float) -> Column:
    """Percent bias of the summed flow over the first rows by ``rank``."""
    taken = (F.col(rank) <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_n")))) & F.col("_y").isNotNull()
    truth = F.sum(F.when(taken, F.col("_y")))
    gap = F.sum(F.when(taken, F.col("_p") - F.col("_y")))
    return F.when(truth > 0, F.lit(100.0) * gap / truth)


def prepared(
    df: DataFrame, by: list[str], y: str, pred: str, order: str, ranks: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Truth and prediction with the group-wise values the metrics need."""
    group = Window.partitionBy(*by)
    both = F.col(y).isNotNull() & F.col(pred).isNotNull()
    base = df.select(
        *by,
        *keep,
        F.col(order).alias("_o"),
        F.when(both, F.col(y)).alias("_y"),
        F.when(both, F.col(pred)).alias("_p"),
    )
    out = base.withColumns(
        {
            "_n": F.count("_y").over(group),
            "_mean": F.avg("_y").over(group),
            "_eps": log_offset("_y", group),
        }
    )
    out = out.withColumns(
        {
            "_ly": F.ln(C.not_below_zero("_y") + F.col("_eps")),
            "_lp": F.ln(C.not_below_zero("_p") + F.col("_eps")),
        }
    ).withColumn("_lmean", F.avg("_ly").over(group))
    if not ranks:
        return out
    # Equal flows are taken in date order.
    return out.withColumns(
        {
            "_high": F.row_number().over(group.orderBy(F.col("_y").desc_nulls_last(), "_o")),
            "_low": F.row_number().over(group.orderBy(F.col("_y").asc_nulls_last(), "_o")),
        }
    )


def _square(c: Column) -> Column:
    return c * c


def nse_column() -> Column:
    return _efficiency(F.sum(_square(F.col("_y") - F.col("_p"))), F.sum(_square(F.col("_y") - F.col("_mean"))))


def log_nse_column() -> Column:
    return _efficiency(
        F.sum(_square(F.col("_ly") - F.col("_lp"))), F.sum(_square(F.col("_ly") - F.col("_lmean")))
    )


def metric_columns() -> dict[str, Column]:
    miss = F.col("_p") - F.col("_y")
    return {
        "NSE": nse_column(),
        "RMSE": F.sqrt(F.avg(_square(miss))),
        "MAE": F.avg(F.abs(miss)),
        "logNSE": log_nse_column(),
        "FHV": _volume_bias("_high", HIGH_SHARE),
        "FLV": _volume_bias("_low", LOW_SHARE),
    }


def metric_suite(
    df: DataFrame,
    by: list[str],
    y: str = "y",
    pred: str = "pred",
    order: str = "date",
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """All metrics per group. The windows and the aggregate share one exchange on ``by``."""
    columns = metric_columns()
    ranks = bool({"FHV", "FLV"} & set(metrics))
    ready = prepared(df, by, y, pred, order, ranks)
    return ready.groupBy(*by).agg(*[columns[m].alias(m) for m in metrics])


def scores(df: DataFrame, by: list[str], rule: dict, name: str = "hmean", **kw) -> DataFrame:
    """NSE, logNSE and their harmonic mean under one of the rules in ``columns``."""
    two = metric_suite(df, by, metrics=("NSE", "logNSE"), **kw)
    return two.withColumn(name, C.harmonic("NSE", "logNSE", **rule))


def fold_means(oof: DataFrame, by: list[str]) -> DataFrame:
    """Mean over folds of every metric and of the clamped harmonic mean; null folds skipped."""
    per_fold = metric_suite(oof, [*by, "fold"]).withColumn(
        "Hmean", C.harmonic("NSE", "logNSE", **C.HMEAN_GRID)
    )
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(f"cv_mean_{m}") for m in (*METRICS, "Hmean")])


def mse_logmse(
    df: DataFrame, by: list[str], weight: float = 0.3, eps: float = 1e-3, y: str = "y", pred: str = "pred"
) -> DataFrame:
    """Squared error plus weighted squared error of logs, as a score."""
    both = F.col(y).isNotNull() & F.col(pred).isNotNull()
    truth, guess = F.when(both, F.col(y)), F.when(both, F.col(pred))
    logs = F.ln(C.not_below_zero(guess) + F.lit(eps)) - F.ln(truth + F.lit(eps))
    return df.groupBy(*by).agg(
        (F.avg(_square(guess - truth)) + F.lit(weight) * F.avg(_square(logs))).alias("loss")
    )


def gate_loss(
    blended: DataFrame, by: list[str], beta: float = 0.01, y: str = "y", pred: str = "pred_MoE", w: str = "w"
) -> DataFrame:
    """(1 - NSE) minus beta times the mean weight entropy."""
    group = Window.partitionBy(*by)
    entropy = -F.aggregate(
        F.col(w), F.lit(0.0), lambda acc, v: acc + v * F.ln(F.greatest(v, F.lit(1e-8)))
    )
    ready = blended.withColumns({"_mean": F.avg(y).over(group), "_ent": entropy})
    spread = F.greatest(F.sum(_square(F.col(y) - F.col("_mean"))), F.lit(1e-6))
    error = F.sum(_square(F.col(y) - F.col(pred)))
    return ready.groupBy(*by).agg((error / spread - F.lit(beta) * F.avg("_ent")).alias("gate_loss"))
