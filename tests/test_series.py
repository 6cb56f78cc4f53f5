"""Ordered work: plain and chunked forms against pandas, edges, no look into the future."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirline.operators import features, split
from weirline.series import DEFAULT, Series, exponential_memory, number, series_for
from weirline.sources import tables

CHUNKED = Series(span_days=40)
BOTH = pytest.mark.parametrize("series", [DEFAULT, CHUNKED])


def days(n, start="2000-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n)]


@pytest.fixture(scope="module")
def gaps():
    """Two sections with missing days and missing values, long empty stretches among them."""
    draw = np.random.default_rng(7)
    parts = []
    for s in ("A", "B"):
        day = np.array(days(400))[draw.random(400) < 0.5]
        x = draw.gamma(2.0, 50.0, len(day))
        x[draw.random(len(day)) < 0.3] = np.nan
        x[30:75] = np.nan
        parts.append(pd.DataFrame({"section_id": s, "date": day, "x": x}))
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf, schema):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@BOTH
def test_memory_equals_pandas(spark, gaps, series):
    df = frame(spark, gaps, "section_id string, date date, x double")
    got = exponential_memory(df, series, "x", "m").toPandas().sort_values(["section_id", "date"])
    want = gaps.groupby("section_id")["x"].transform(lambda s: s.ewm(alpha=0.2, adjust=False).mean())
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-12)


@BOTH
def test_memory_edge_gaps(spark, series):
    x = [np.nan, np.nan, 5.0, np.nan, 7.0, np.nan, np.nan, 1.0]
    pdf = pd.DataFrame({"section_id": "A", "date": days(8)[::1], "x": x})
    pdf["date"] = [d + dt.timedelta(days=30 * i) for i, d in enumerate(pdf["date"])]
    got = exponential_memory(frame(spark, pdf, "section_id string, date date, x double"), series, "x", "m")
    want = pd.Series(x).ewm(alpha=0.2, adjust=False).mean()
    np.testing.assert_allclose(got.orderBy("date").toPandas()["m"].astype(float), want, rtol=1e-12)


@BOTH
def test_positions_and_lags(spark, gaps, series):
    df = frame(spark, gaps, "section_id string, date date, x double")
    got = number(df, series).toPandas().sort_values(["section_id", "date"])
    assert (got["pos"].to_numpy() == gaps.groupby("section_id").cumcount().to_numpy() + 1).all()
    assert (got["n"].to_numpy() == gaps.groupby("section_id")["x"].transform("size").to_numpy()).all()
    flows = df.select("section_id", "date", F.lit("test").alias("split"), F.col("x").alias("measured_flow"),
                      F.col("x").alias("natural_flow"), F.col("x").alias("rainfall"))
    lagged = features.lag_view(flows, series).toPandas().sort_values(["section_id", "date"])
    for k in (1, 3, 6):
        want = gaps.groupby("section_id")["x"].shift(k)
        np.testing.assert_allclose(lagged[f"measured_flow_lag{k}"].astype(float), want)


@BOTH
def test_rolling_and_windows(spark, gaps, series):
    df = frame(spark, gaps, "section_id string, date date, runoff_natural double")
    got = features.rolling_memory(df, series).toPandas().sort_values(["section_id", "date"])
    want = gaps.groupby("section_id")["x"].transform(lambda s: s.rolling(6, min_periods=1).mean())
    np.testing.assert_allclose(got["M_nat6"].astype(float), want, rtol=1e-9)
    whole = df.withColumn("one", F.lit(1.0))
    wide = features.sequence_windows(whole, ["one"], 5, series)
    assert wide.count() == len(gaps) - 2 * 4


def test_memory_of_a_very_long_section(spark):
    n = 70_000
    df = spark.range(n).select(F.lit("A").alias("section_id"), F.date_add(F.lit(dt.date(1900, 1, 1)), F.col("id").cast("int")).alias("date"),
                               F.when(F.col("id") % 7 > 0, (F.col("id") % 101).cast("double")).alias("x"))
    got = exponential_memory(df, DEFAULT, "x", "m").orderBy("date").toPandas()
    want = got["x"].astype(float).ewm(alpha=0.2, adjust=False).mean()
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-9)


def test_one_row_per_date(spark):
    one = spark.createDataFrame([("A", dt.date(2000, 1, i)) for i in range(1, 9)], "section_id string, date date")
    assert series_for(one) == DEFAULT and series_for(one, CHUNKED) == CHUNKED
    with pytest.raises(ValueError):
        series_for(one.union(one))


def test_no_look_into_the_future(spark, gaps):
    df = frame(spark, gaps.fillna(1.0), "section_id string, date date, runoff_natural double")
    cut = dt.date(2000, 9, 1)
    later = df.withColumn("runoff_natural", F.when(F.col("date") >= F.lit(cut), F.lit(1e6)).otherwise(F.col("runoff_natural")))

    def past(d):
        d = d.withColumns({"runoff_measured": F.col("runoff_natural"), "U_total": F.lit(1.0)})
        full = features.flow_memory(features.lagged_gate_inputs(d))
        return full.where(F.col("date") < F.lit(cut)).orderBy("section_id", "date").toPandas()

    pd.testing.assert_frame_equal(past(df), past(later))


def test_missing_month_row_and_calendar_lag(spark):
    months = [dt.date(2000, m, 1) for m in (1, 2, 4, 5)]
    rows = [("A", d, float(d.month), 1.0) for d in months]
    df = spark.createDataFrame(rows, "section_id string, date date, runoff_measured double, runoff_natural double")

    def lag_of_april(d):
        out = features.lagged_gate_inputs(d.withColumn("U_total", F.col("runoff_measured")))
        return out.where(F.col("date") == F.lit(dt.date(2000, 4, 1))).first()["gate_HAI3_t1_raw"]

    assert lag_of_april(df) == 2.0
    assert lag_of_april(features.densify_months(df)) is None
    assert features.densify_months(df).count() == 5


@pytest.mark.parametrize("n,k", [(4, 3), (7, 3), (61, 3), (10, 2)])
def test_folds(spark, n, k):
    df = spark.createDataFrame([("A", d) for d in days(n)], "section_id string, date date")
    step, got = n // (k + 1), split.cv_folds(df, k).toPandas()
    for f in range(k):
        part = got[got["fold"] == f].sort_values("date")
        val, train = (part[part["role"] == r]["date"].tolist() for r in ("val", "train"))
        start = n - (k - f) * step
        assert val == days(n)[start : start + step] and train == days(n)[:start]


def test_too_short_for_folds(spark):
    df = spark.createDataFrame([("A", d) for d in days(3)], "section_id string, date date")
    with pytest.raises(Exception, match="3 folds need more than 3 rows"):
        split.cv_folds(df, 3).collect()


def test_rules(spark):
    df = spark.createDataFrame(
        [("A", dt.date(1999, 1, 1)), ("A", dt.date(2000, 1, 1)), ("B", dt.date(1999, 1, 1)), ("C", dt.date(2000, 1, 1))],
        "section_id string, date date",
    )
    rules = spark.createDataFrame([("A", 2000), ("B", 2000)], "section_id string, first_test_year int")
    got = split.train_test(df, rules).orderBy("date").collect()
    assert [(r["section_id"], r["split"]) for r in got] == [("A", "train"), ("A", "test")]
    with pytest.raises(ValueError, match="C"):
        split.require_rules(df, rules)


def test_bad_text(spark):
    rows = [("A", "200001", "1.5"), ("A", "202013", "x"), ("A", "abc", ""), ("A", None, "NaN")]
    got = tables.coerce_types(spark.createDataFrame(rows, "section_id string, date string, rainfall string")).collect()
    assert [r["date"] for r in got] == [dt.date(2000, 1, 1), None, None, None]
    assert [r["rainfall"] for r in got] == [1.5, None, None, None]


def test_double_key_on_the_right_multiplies(spark):
    left = spark.createDataFrame([("A", dt.date(2000, 1, 1), 1.0)], "section_id string, date date, rainfall double")
    right = spark.createDataFrame([("A", dt.date(2000, 1, 1), v) for v in (1.0, 2.0)], "section_id string, date date, domestic double")
    assert features.join_sources(left, right).count() == 2


def test_row_feature_edges(spark):
    cols = "rainfall double, evaporation double, runoff_measured double, runoff_natural double, domestic double, agricultural double, industrial double, ecological double"
    rows = [
        (1.0, 2.0, 3.0, 0.0, 1.0, 1.0, 2.0, 1.0),
        (None, 2.0, 3.0, -5.0, None, 1.0, 2.0, 1.0),
        (2.0, 2.0, 3.0, None, None, None, None, None),
        (2.0, 1.0, 3.0, 4.0, -1.0, 0.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame([("A", dt.date(2000, 1 + i, 1), *r) for i, r in enumerate(rows)], "section_id string, date date, " + cols)
    a, b, c, d = features.row_features(df).orderBy("date").collect()
    assert a["I_t"] == 5.0 / 1e-9 and a["D_phase"] == 1 and a["ag_share"] == 0.25
    assert b["I_t"] == 4.0 / 1e-9 and b["D_phase"] == 0 and b["ag_share"] is None and b["U_total"] == 4.0
    assert c["I_t"] is None and c["U_total"] == 0.0 and c["target"] is None
    assert d["dom_share"] == 0.0 and d["I_t"] == -0.25


def test_gbk_source(spark, tmp_path):
    """Text in the encoding the source files come in."""
    from weirline.schema import HYDRO_CSV

    header = "section_id,date,rainfall,evaporation,runoff_measured,runoff_natural"
    (tmp_path / "h.csv").write_bytes((header + "\n三两,200001,1.5,2,3,4\n").encode("gbk"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        row = tables.coerce_types(tables.read_source_csv(spark, str(tmp_path / "h.csv"), HYDRO_CSV, "GBK")).first()
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert row["section_id"] == "三两" and row["date"] == dt.date(2000, 1, 1) and row["runoff_natural"] == 4.0
