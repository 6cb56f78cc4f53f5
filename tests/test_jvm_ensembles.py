"""The kernels in the JVM against those in numpy, pack by pack."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.operators import ensembles, trees
from weirline.sources.scratch import cut

NAMES = ["a", "b", "c"]
GRIDS = {
    "RF": [{"numTrees": t, "maxDepth": d} for t in (100, 230) for d in (3, ensembles.UNLIMITED)],
    "GB": [{"maxIter": n, "maxDepth": d} for n in (5, 40) for d in (2, 3)],
    "LGBM": [
        {"maxIter": n, "stepSize": s, "maxDepth": 5, "minInstancesPerNode": m, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6"}
        for n in (10, 30) for s in (0.05, 0.1) for m in (2, 5)
    ],
    "AdaB": [{"rounds": n, "rate": r} for n in (10, 40) for r in (0.05, 0.2)],
}


@pytest.fixture(scope="module")
def blocks(spark):
    draw = np.random.default_rng(17)
    rows = []
    for s, n in (("A", 70), (None, 45), ("C", 300), ("D", 6), ("E", 40)):
        x = np.round(draw.normal(size=(n, 3)), 1 if s == "A" else 6)
        y = 100 + 9 * x[:, 0] + np.where(x[:, 1] > 0, 7, 0) + draw.normal(size=n)
        if s == "E":
            y[:] = 3.0
        for i in range(n):
            block = min(3, i * 5 // n - 1)
            truth = None if i % 11 == 7 else float(y[i])
            rows.append((s, i, "test" if block == 3 else "train", block, truth, *map(float, x[i])))
    df = spark.createDataFrame(rows, "section_id string, i int, split string, block int, measured_flow double, a double, b double, c double")
    return df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i"))).cache()


@pytest.mark.parametrize("alg", list(GRIDS))
def test_jvm_equals_numpy(blocks, alg):
    cases, grid = ensembles.forward_cases(blocks, NAMES), GRIDS[alg]
    got = {(r["section_id"], r["fold"], r["tag"]): r for r in ensembles.case_predictions(cases, 3, alg, grid).collect()}
    chunk = F.explode(F.sequence(F.lit(0), F.lit(2 if alg == "RF" else 0))).alias("chunk")
    packs = ensembles.packed(cases, chunk).toArrow().to_batches()
    run, want = ensembles._fit(alg, grid, 42, 3), {}
    for batch in packs:
        for i in range(batch.num_rows):
            for out in run(iter([batch.slice(i, 1)])):
                for r in out.to_pylist():
                    key = r["section_id"], r["fold"], r["tag"]
                    want[key] = np.array(r["preds"]) + (want[key] if key in want else 0)
    assert got.keys() == want.keys() and len(want) > 300
    for key, preds in want.items():
        np.testing.assert_allclose(got[key]["preds"], preds, rtol=1e-12)
    assert sum(r["y"] is None for r in got.values()) > 30


@pytest.mark.parametrize("alg", list(GRIDS))
def test_a_pack_is_fitted_once_and_in_the_jvm(blocks, alg):
    preds = ensembles.staged_predictions(blocks, NAMES, alg, GRIDS[alg])
    plan = preds.where("pred > 0")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.split("Initial Plan")[0].count("UDF(section_id") == 1


def test_single_trees_are_dealt_to_all_tasks(blocks, spark, monkeypatch):
    """A second deal by the keys of the first was dropped, and tasks were merged by their bytes."""
    plans = []
    monkeypatch.setattr(trees, "cut", lambda df: plans.append(df) or cut(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), spark.sparkContext.defaultParallelism)))
    trees.grow(blocks, NAMES, (1, 5))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("trees_,times", [(60, 1), (130, 2)])
def test_rows_of_a_repeated_day(blocks, trees_, times):
    """As before: one row each, or added up where the trees come from several chunks."""
    grid = [{"numTrees": trees_, "maxDepth": 3}]
    more = blocks.where("section_id = 'A'").union(blocks.where("section_id = 'A' AND i = 69"))
    rows = {(r["block"], r["date"].isoformat()): [] for r in blocks.where("section_id = 'A' AND block >= 0").collect()}
    for r in ensembles.staged_predictions(more, NAMES, "RF", grid).collect():
        rows[r["block"], r["date"].isoformat()].append(r["pred"])
    last = rows.pop((3, "2000-03-10"))
    once = [r["pred"] for r in ensembles.staged_predictions(blocks.where("section_id = 'A'"), NAMES, "RF", grid).where("date = '2000-03-10'").collect()]
    assert all(len(v) == 1 for v in rows.values())
    assert last == pytest.approx(once * 2 if times == 1 else [2 * once[0]])
