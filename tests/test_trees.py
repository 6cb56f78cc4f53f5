"""Trees, forests and boosting per section against plain recursive trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.operators import ensembles, trees

GOOD = dict(rtol=1e-9, atol=1e-9)


def plain_tree(x, y, w, depth, least=1, allowed=None):
    """A function from rows (n, inputs) and a depth to values: greedy least squares, ties by input, then value."""
    fit = w > 0
    value = float(np.average(y[fit], weights=w[fit]))
    total, mean2 = w[fit].sum(), (w[fit] * y[fit] ** 2).sum()
    spread = mean2 - total * value**2
    best = None
    if depth > 0 and spread > 1e-12 * mean2:
        for f in range(x.shape[1]):
            if allowed is not None and not allowed[f]:
                continue
            for a, b in zip(np.unique(x[fit, f])[:-1], np.unique(x[fit, f])[1:]):
                left, right = fit & (x[:, f] <= a), fit & (x[:, f] > a)
                if min(left.sum(), right.sum()) < least:
                    continue
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, right)) - total * value**2
                gain = round(gain / spread, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, (a + b) / 2, left, right
    if best is None:
        return lambda rows, d=None: np.full(len(rows), value)
    _, f, cut, left, right = best
    kids = [plain_tree(x, y, np.where(s, w, 0), depth - 1, least, allowed) for s in (left, right)]

    def say(rows, d=None):
        if d == 0:
            return np.full(len(rows), value)
        down = None if d is None else d - 1
        return np.where(rows[:, f] > cut, kids[1](rows, down), kids[0](rows, down))

    return say


def panel(seed=5, n=(33, 40, 1, 26)):
    draw = np.random.default_rng(seed)
    rows = []
    for s, size in enumerate(n):
        x = np.round(draw.normal(size=(size, 3)), 1)  # ties in values
        x[:, 2] = x[:, 0] * 2 if s == 1 else x[:, 2]  # two inputs that split alike
        y = np.round(20 + 5 * x[:, 0] + np.where(x[:, 1] > 0, 4, 0) + draw.normal(size=size), 2)
        if s == 3:
            y[:] = 7.0  # nothing to learn
        for i in range(size):
            block = min(3, i * 5 // max(size, 5) - 1)
            rows.append((f"S{s}", i, "test" if block == 3 else "train", block, float(y[i]), *map(float, x[i])))
    rows[4] = (*rows[4][:6], None, rows[4][7])  # an input is missing
    rows[9] = (*rows[9][:4], None, *rows[9][5:])  # the truth is missing
    return rows


@pytest.fixture(scope="module")
def blocks(spark):
    df = spark.createDataFrame(panel(), "section_id string, i int, split string, block int, measured_flow double, a double, b double, c double")
    return df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i"))).cache()


def folds():
    """(section, fold, train x, train y, asked x, asked rows)"""
    rows = [r for r in panel() if r[6] is not None]
    for s in sorted({r[0] for r in rows}):
        for b in range(4):
            train = [r for r in rows if r[0] == s and r[3] < b and r[2] == "train" and r[4] is not None]
            asked = [r for r in rows if r[0] == s and r[3] == b]
            if train and asked:
                yield s, b, np.array([r[5:] for r in train]), np.array([r[4] for r in train]), np.array([r[5:] for r in asked]), asked


def by_row(df, columns):
    got = df.withColumn("i", F.datediff("date", F.lit("2000-01-01"))).collect()
    return {(r["section_id"], r["i"], *[r[c] for c in columns]): r["pred"] for r in got}


NAMES = ["a", "b", "c"]


def test_tree_grid_from_one_growth(blocks):
    grid = [{"maxDepth": d, "minInstancesPerNode": m} for d in (None, 5, 2, 1, 0) for m in (1, 5)]
    got = by_row(trees.tree_predictions(blocks, NAMES, "DT", grid), ["point"])
    n = 0
    for s, _, x, y, ask, asked in folds():
        for p, g in enumerate(grid):
            tree = plain_tree(x, y, np.ones(len(y)), 99 if g["maxDepth"] is None else g["maxDepth"], g["minInstancesPerNode"])
            for r, want in zip(asked, tree(ask)):
                assert got[s, r[1], p] == pytest.approx(want, rel=1e-9), (s, r, g)
                n += 1
    assert len(got) == n


def test_model_table_gives_the_same_predictions(blocks):
    rows, model = trees.grow(blocks, NAMES, (1, 5))
    want = by_row(rows.withColumn("pred", trees.at_depth(None)), ["least"])
    asked = blocks.where("block >= 0").dropna(subset=NAMES).withColumn("fold", F.col("block")).withColumn("least", F.explode(F.array(F.lit(1), F.lit(5))))
    got = by_row(trees.predict(asked, model, NAMES), ["least"])
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    leaves = model.where("input IS NULL").groupBy("section_id", "fold", "least").agg(F.sum("n").alias("n")).collect()
    teaching = {(s, b): len(y) for s, b, _, y, _, _ in folds()}
    assert all(r["n"] == teaching[r["section_id"], r["fold"]] for r in leaves if (r["section_id"], r["fold"]) in teaching)


def test_forest_points_are_prefixes_of_one_forest(blocks):
    grid = [{"numTrees": t, "maxDepth": d} for t in (100, 130) for d in (2, ensembles.UNLIMITED)]
    got = by_row(ensembles.staged_predictions(blocks, NAMES, "RF", grid, seed=3), ["point"])
    alone = by_row(ensembles.staged_predictions(blocks, NAMES, "RF", grid[:1], seed=3), [])
    assert {k[:2]: v for k, v in got.items() if k[2] == 0} == pytest.approx(alone)
    for s, b, x, y, ask, asked in folds():
        batch = ensembles.Batch(x.T, y, np.zeros(len(y), int), np.ones(len(y), bool), [(s, b, 0)])
        every = []
        for t in range(130):
            drawn = batch.rng(3, 0, t).integers(0, len(y), len(y))
            every.append(plain_tree(x, y, np.bincount(drawn, minlength=len(y)).astype(float), 99))
        for p, g in enumerate(grid):
            d = None if g["maxDepth"] == ensembles.UNLIMITED else g["maxDepth"]
            want = np.mean([t(ask, d) for t in every[: g["numTrees"]]], axis=0)
            np.testing.assert_allclose([got[s, r[1], p] for r in asked], want, **GOOD)


def test_boosting_points_are_stages_of_one_run(blocks):
    grid = [{"maxIter": n, "maxDepth": d} for n in (3, 12) for d in (2, 3)] + [{"maxIter": 5, "maxDepth": 2, "stepSize": 0.3, "minInstancesPerNode": 4}]
    got = by_row(ensembles.staged_predictions(blocks, NAMES, "GB", grid), ["point"])
    for s, _, x, y, ask, asked in folds():
        for p, g in enumerate(grid):
            here, there = np.full(len(y), y.mean()), np.full(len(ask), y.mean())
            for _ in range(g["maxIter"]):
                tree = plain_tree(x, y - here, np.ones(len(y)), g["maxDepth"], g.get("minInstancesPerNode", 1))
                here, there = here + g.get("stepSize", 0.1) * tree(x), there + g.get("stepSize", 0.1) * tree(ask)
            np.testing.assert_allclose([got[s, r[1], p] for r in asked], there, rtol=1e-7)


def plain_adaboost(x, y, ask, rounds, rate, depth=3):
    w, says, values = np.full(len(y), 1 / len(y)), [], []
    for r in range(rounds):
        tree = plain_tree(x, y, w, depth)
        error = np.abs(y - tree(x))
        loss = error / error.max() if error.max() > 0 else error
        bar = (w * loss).sum()
        if bar <= 0:
            says.append(1.0)
            values.append(tree(ask))
            break
        if bar >= 0.5:
            if not r:
                says.append(1e-12)
                values.append(tree(ask))
            break
        beta = bar / (1 - bar)
        says.append(-rate * np.log(beta))
        values.append(tree(ask))
        w = w * beta ** ((1 - loss) * rate)
        w = w / w.sum()
    return ensembles.weighted_medians(np.array(values), np.repeat(np.array(says)[:, None], len(ask), axis=1))


def test_adaboost_rates_and_stages(blocks):
    grid = [{"rounds": n, "rate": r} for n in (1, 4, 20) for r in (0.1, 0.5)]
    got = by_row(ensembles.staged_predictions(blocks, NAMES, "AdaB", grid), ["point"])
    for s, _, x, y, ask, asked in folds():
        for p, g in enumerate(grid):
            want = plain_adaboost(x, y, ask, g["rounds"], g["rate"])
            np.testing.assert_allclose([got[s, r[1], p] for r in asked], want, rtol=1e-7)


def test_rounds_do_not_grow_the_plan(blocks):
    few, many = (ensembles.staged_predictions(blocks, NAMES, "AdaB", [{"rounds": n, "rate": 0.1}]) for n in (2, 300))
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(few) == size(many)


def test_subsamples_are_alike_in_every_run(blocks):
    grid = [{"maxIter": 8, "maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 2}]
    first = by_row(ensembles.staged_predictions(blocks, NAMES, "LGBM", grid, seed=1), [])
    again = by_row(ensembles.staged_predictions(blocks.repartition(5), NAMES, "LGBM", grid, seed=1), [])
    other = by_row(ensembles.staged_predictions(blocks, NAMES, "LGBM", grid, seed=2), [])
    assert first == again and first != other


def test_small_passes_give_the_same_results(blocks, monkeypatch):
    x = np.random.default_rng(0).normal(size=(3, 50))
    y = x[0] * 3 + x[1]
    whole = ensembles.Batch(x, y, np.repeat([0, 1], 25), np.arange(50) % 25 < 20, [("A", 0, 0), ("B", 1, 0)])
    grid = [{"numTrees": 30, "maxDepth": 4}]
    want = ensembles._forest(whole, grid, 1)
    monkeypatch.setattr(ensembles, "ELEMENTS", 1)
    np.testing.assert_allclose(ensembles._forest(whole, grid, 1), want, rtol=1e-12)


def test_no_rows(blocks):
    none = blocks.where("false")
    assert ensembles.staged_predictions(none, NAMES, "GB", [{"maxIter": 2, "maxDepth": 2}]).count() == 0
    assert trees.tree_predictions(none, NAMES, "DT", [{"maxDepth": 2}]).count() == 0


def test_equal_splits_take_the_first_input_though_truths_hardly_differ():
    draw = np.random.default_rng(1)
    x = np.stack([draw.normal(size=4000), np.zeros(4000)])
    root, w = np.repeat(np.arange(100), 40), np.tile(np.arange(40) % 4 > 0, 100).astype(float)
    x[1] = np.where(w > 0, -x[0], 0)  # splits the train cases alike, but not the others
    y = 1 + 1e-5 * draw.normal(size=4000)
    got, _ = ensembles.grow(x, np.arange(4000), root, w, y, 4)
    want, _ = ensembles.grow(x[:1], np.arange(4000), root, w, y, 4)
    np.testing.assert_allclose(got - 1, want - 1, rtol=1e-6, atol=1e-14)


def test_a_grown_grid_needs_one_job_for_all_levels(blocks, spark):
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one growth", "")
    trees.grow(blocks, NAMES, (1, 5))
    jobs = len(before.getJobIdsForGroup("one growth"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6  # one per stage of the write, whatever the depth
