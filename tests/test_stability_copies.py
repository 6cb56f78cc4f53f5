"""Permuted copies made inside the kernel against a table of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.operators import ensembles, forest, screening
from weirline.sources.scratch import cut, stack

NAMES = ["a", "b", "c"]
MODELS = {"RF": {"numTrees": 30, "maxDepth": None}, "LGBM": {"maxIter": 25, "stepSize": 0.1, "maxDepth": 4, "minInstancesPerNode": 3}}


@pytest.fixture(scope="module")
def blocks(spark):
    draw, rows = np.random.default_rng(8), []
    for s, n in (("A", 50), (None, 35), ("C", 7)):
        x = np.round(draw.normal(size=(n, 3)), 1)
        y = 10 + 4 * x[:, 0] - x[:, 1] + draw.normal(size=n)
        rows += [(s, i, "test" if i * 5 // n == 4 else "train", i * 5 // n - 1, None if i % 13 == 5 else float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "section_id string, i int, split string, block int, measured_flow double, a double, b double, c double")
    return df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i"))).cache()


def by_table(blocks, seeds, k, repeats):
    ready = blocks.where("split = 'train'").dropna(subset=[*NAMES, "measured_flow"]).withColumn("y", F.col("measured_flow"))
    x = F.array(*NAMES)
    runs = ready.withColumn("seed", F.explode(F.array(*map(F.lit, range(len(seeds))))))
    teach = runs.where(F.col("block") < k - 1).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block") + 1, F.lit(0)), F.lit(k - 1)))).withColumn("fold", F.col("fold") + F.col("seed") * k)
    asked = runs.where("block >= 0").withColumn("fold", F.col("block") + F.col("seed") * k)
    copies = screening.permuted_copies(asked.select("section_id", "fold", "date", "y", *NAMES), NAMES, 0, repeats, ["section_id", "fold"])
    number = F.coalesce(F.array_position(F.array(*map(F.lit, NAMES)), F.col("shuffled")), F.lit(0))
    tag = F.unix_date("date").cast("long") + 100_000 * number + 1_000_000 * F.col("repeat")
    cases = stack([teach.select("section_id", "fold", F.lit(True).alias("train"), F.unix_date("date").cast("long").alias("tag"), "y", x.alias("x")), copies.select("section_id", "fold", F.lit(False).alias("train"), tag.alias("tag"), "y", x.alias("x"))])
    out = {}
    for name, g in MODELS.items():
        g = {**g, "maxDepth": g["maxDepth"] or ensembles.UNLIMITED}
        found = ensembles.case_predictions(cases, 3, name, [g])
        place = F.expr("(tag % 1000000) div 100000").cast("int")
        scored = found.select("section_id", F.col("fold").alias("run"), "y", F.col("preds")[0].alias("pred"), F.expr("tag div 1000000").alias("repeat"), F.when(place > 0, F.get(F.array(*map(F.lit, NAMES)), place - 1)).alias("shuffled"))
        for r in screening.importance_from_copies(scored, ["section_id", "run"]).collect():
            out[r["section_id"], seeds[r["run"] // k], name, r["run"] % k, r["feature"]] = r["importance"]
    return out


def test_importances_equal_those_of_a_table_of_copies(blocks):
    seeds, k, repeats = (0, 5), 3, 4
    got = forest.stability_importances(blocks, NAMES, seeds, k, repeats, MODELS)
    got = {tuple(r[c] for c in ("section_id", "seed", "model", "fold", "feature")): r["importance"] for r in got.collect()}
    want = by_table(blocks, seeds, k, repeats)
    assert got.keys() == want.keys() and len(want) > 60
    known = {key: v for key, v in want.items() if v is not None}
    assert {key: v for key, v in got.items() if v is not None} == pytest.approx(known, rel=1e-9, abs=1e-12)


def test_no_table_of_copies_is_written(blocks, monkeypatch):
    written = []
    monkeypatch.setattr(forest, "cut", lambda df: written.append(cut(df)) or written[-1])
    forest.stability_importances(blocks, NAMES, (0, 1), 3, 6, {"LGBM": MODELS["LGBM"]})
    assert max(t.count() for t in written) <= blocks.count()
