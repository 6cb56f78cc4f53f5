"""Experts as tables, their pyspark.ml form, and moved inputs, against plain numpy."""

import os

import numpy as np
import pandas as pd
import pytest
from test_trees import plain_tree

from weirline.operators import estimators, experts, neighbours, skill, splines, split

BASE = ("natural_flow", "rainfall", "evaporation")


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(6)
    rows = []
    for s, n in (("A", 60), ("B", 48)):
        nat, rain, evap = draw.gamma(4, 5, n), draw.gamma(2, 2, n), draw.gamma(3, 1, n)
        flow = nat * 0.8 + rain + draw.normal(0, 1, n) + 5
        for i, d in enumerate(pd.date_range("2000-01-01", periods=n)):
            rows.append((s, d.date(), "test" if i >= n - 12 else "train", *map(float, (flow[i], nat[i], rain[i], evap[i]))))
    return spark.createDataFrame(rows, "section_id string, date date, split string, measured_flow double, natural_flow double, rainfall double, evaporation double").cache()


def test_models_are_tables_that_can_be_written(spark, panel, tmp_path):
    blocks = split.forward_blocks(panel, 3)
    pdf = panel.toPandas()
    for e in (experts.line("L", BASE), experts.nearest_mean("K", BASE, 3), experts.tree("T", BASE, 3, 2), experts.spline("S", BASE, 6, 1.0)):
        e.fit(blocks).write.parquet(str(tmp_path / e.name))
        model = spark.read.parquet(str(tmp_path / e.name))
        got = e.predict(panel.where("split = 'test'"), model).toPandas().sort_values("date")
        for s, own in pdf.groupby("section_id"):
            train, test = own[own["split"] == "train"], own[own["split"] == "test"]
            x, y, ask = train[list(BASE)].to_numpy(), train["measured_flow"].to_numpy(), test[list(BASE)].to_numpy()
            if e.name == "L":
                beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
                want = np.column_stack([np.ones(len(ask)), ask]) @ beta
            elif e.name == "K":
                want = [y[np.argsort(((x - a) ** 2).sum(axis=1), kind="stable")[:3]].mean() for a in ask]
            elif e.name == "T":
                want = plain_tree(x, y, np.ones(len(y)), 3, 2)(ask)
            else:
                design = lambda r: np.column_stack([np.ones(len(r)), *[splines.basis(r[:, f], x[:, f].min(), x[:, f].max(), 6) for f in range(3)]])  # noqa: B023, E731
                total = np.column_stack([design(x), y])
                want = design(ask) @ splines.solve(total.T @ total, 6, 3, 1.0)
            np.testing.assert_allclose(got[got["section_id"] == s]["pred"], want, rtol=1e-6)


def test_moved_inputs_reach_the_lags_and_models_stay(panel):
    lagged = experts.line("LAG", ("measured_flow_lag1",))
    tree = experts.tree("DT", BASE, 4)
    blocks = split.forward_blocks(panel, 3)
    lag_rows = experts.features.lag_view(panel)
    models = {"LAG": lagged.fit(split.forward_blocks(lag_rows, 3)), "DT": tree.fit(blocks)}
    got = experts.perturbation(panel, [lagged, tree], models, ["measured_flow", "natural_flow"], (0.9, 1.0, 1.1)).toPandas()
    got = got.set_index(["section_id", "alg", "input", "factor"])
    for s, own in panel.toPandas().sort_values("date").groupby("section_id"):
        flow, train = own["measured_flow"].to_numpy(), (own["split"] == "train").to_numpy()
        x = own[list(BASE)].to_numpy()
        fit = np.flatnonzero(train)[6:]  # lag rows have six rows before them
        slope, icept = np.polyfit(flow[fit - 1], flow[fit], 1)
        said = plain_tree(x[train], flow[train], np.ones(train.sum()), 4)
        test = np.flatnonzero(~train)
        for f in (0.9, 1.0, 1.1):
            off = np.where(train, flow, flow * f)
            want = np.sqrt(np.mean((icept + slope * off[test - 1] - flow[test]) ** 2))
            assert got.loc[(s, "LAG", "measured_flow", f), "RMSE"] == pytest.approx(want, rel=1e-6)
            assert got.loc[(s, "LAG", "natural_flow", f), "dRMSE"] == 0.0
            shifted = x[test].copy()
            shifted[:, 0] *= f
            want = np.sqrt(np.mean((said(shifted) - flow[test]) ** 2))
            assert got.loc[(s, "DT", "natural_flow", f), "RMSE"] == pytest.approx(want, rel=1e-9)
            assert got.loc[(s, "DT", "measured_flow", f), "dNSE"] == 0.0


def test_estimators_take_grids_and_evaluate(panel):
    train = split.fold_blocks(panel.where("split = 'train'"), 3)
    line = estimators.LineEstimator(inputs=list(BASE))
    model = line.fit(panel.where("split = 'train'"))
    said = model.transform(panel.where("split = 'test'"))
    score = estimators.HmeanEvaluator().evaluate(said)
    want = skill.scores(said.withColumnRenamed("prediction", "pred"), ["section_id"], estimators.C.HMEAN_GRID, y="measured_flow")
    assert score == pytest.approx(np.mean([r["hmean"] for r in want.collect()]))
    assert estimators.HmeanEvaluator().isLargerBetter()

    tree = estimators.TreeEstimator(inputs=list(BASE))
    found = estimators.ForwardFoldValidator(tree, [{tree.maxDepth: 1}, {tree.maxDepth: 4, tree.minInstancesPerNode: 2}]).fit(train)
    scores = found.scores.toPandas()
    best = {r["section_id"]: r["point"] for r in found.best.collect()}
    for s, own in scores.groupby("section_id"):
        assert own.set_index("point")["score"].idxmax() == best[s]
    deep = tree.fit(train, {tree.maxDepth: 4, tree.minInstancesPerNode: 2}).transform(panel.where("split = 'test'")).toPandas()
    kept = found.transform(panel.where("split = 'test'")).toPandas()
    for s in [s for s, p in best.items() if p == 1]:
        a, b = (d[d["section_id"] == s].sort_values("date")["prediction"].to_numpy() for d in (deep, kept))
        np.testing.assert_allclose(a, b)
    assert len(kept) == 24


def test_moved_copies_are_not_written_and_a_day_may_have_many(spark, panel):
    blocks = split.forward_blocks(panel, 3)
    near = experts.nearest_mean("KNN", BASE, 3)
    lagged = experts.line("LAG", ("measured_flow_lag1",))
    models = {"KNN": near.fit(blocks), "LAG": lagged.fit(split.forward_blocks(experts.features.lag_view(panel), 3))}
    folder = spark.conf.get("spark.checkpoint.dir")
    held = set(os.listdir(folder))
    got = experts.perturbation(panel, [near, lagged], models, ["natural_flow"], (0.5, 1.0, 2.0)).toPandas()
    assert set(os.listdir(folder)) == held  # copies, once per input and factor, were written three times
    got = got.set_index(["section_id", "alg", "factor"])
    for s, own in panel.toPandas().sort_values("date").groupby("section_id"):
        train, test = own[own["split"] == "train"], own[own["split"] == "test"]
        x, y, truth = train[list(BASE)].to_numpy(), train["measured_flow"].to_numpy(), test["measured_flow"].to_numpy()
        for f in (0.5, 1.0, 2.0):
            ask = test[list(BASE)].to_numpy() * [f, 1, 1]
            want = np.array([y[np.argsort(((x - a) ** 2).sum(axis=1), kind="stable")[:3]].mean() for a in ask])
            assert got.loc[(s, "KNN", f), "RMSE"] == pytest.approx(np.sqrt(np.mean((want - truth) ** 2)), rel=1e-9)


def test_neighbours_need_no_merge(panel):
    found = neighbours.nearest(split.forward_blocks(panel, 3), list(BASE), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Aggregate" not in above and "Join" not in above


def test_a_repeated_day_is_answered_once(panel):
    blocks = split.forward_blocks(panel.where("section_id = 'A'"), 3)
    once, twice = (neighbours.nearest(b, list(BASE), 3).toPandas().sort_values("date") for b in (blocks, blocks.unionByName(blocks)))
    assert list(once["date"]) == list(twice["date"]) and list(once["block"]) == list(twice["block"])
    for a, b in zip(once["near"], twice["near"]):
        assert [t["date"] for t in b] == [a[0]["date"]] * 3  # two rows of the day, each next to both copies of its nearest
