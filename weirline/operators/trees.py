"""Regression trees of all sections, folds and leaf sizes in one job.

Cases are packed by (section, fold), which the calendar bounds, and spread over the
cluster; a task grows the trees of several packs level by level (``ensembles.grow``).
A row collects the mean of every node on its way, so one growth holds the trees of
every smaller depth.

The nodes form a table of their own, the fitted model: ``predict`` walks any rows
through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.operators import ensembles
from weirline.operators.ensembles import forward_cases
from weirline.sources.scratch import cut, spread

#: Node numbers are those of a heap (children 2i and 2i + 1) in a long.
DEEPEST = 60
_TREE = ["section_id", "fold", "least"]
_GROWN = "section_id string, fold int, least int, tag long, y double, path array<double>, node long, value double, n long, input int, threshold double"


def _nodes(root: np.ndarray, w: np.ndarray, y: np.ndarray, levels: list[ensembles.Level]) -> pd.DataFrame:
    """(root, node, value, n, input, threshold) of all nodes; input and threshold of inner ones only."""
    taught = np.unique(root[w > 0])
    n = np.bincount(root, w)[taught]
    parts = [pd.DataFrame({"root": taught, "node": 1, "value": np.bincount(root, w * y)[taught] / n, "n": n.astype(np.int64)})]
    for level in levels:
        parts += [pd.DataFrame({"root": level.root, "node": 2 * level.heap + i, "value": level.sides[i], "n": level.sizes[i]}) for i in (0, 1)]
    inner = [pd.DataFrame({"root": v.root, "node": v.heap, "input": v.feature, "threshold": v.cut}) for v in levels]
    if not inner:
        return parts[0].assign(input=None, threshold=None)
    return pd.concat(parts).merge(pd.concat(inner), on=["root", "node"], how="left")


def _grown(width: int, least: tuple[int, ...], depth: int):
    """Asked cases with their path, and the nodes of all trees, in one table."""

    def answers(packs: list[dict]) -> Iterator[pa.RecordBatch]:
        sizes, sides = [len(p["tag"]) for p in packs], len(least)
        x = np.concatenate([p["x"].reshape(-1, width) for p in packs]).T.copy()
        tag, train, y = (np.tile(np.concatenate([p[c] for p in packs]), sides) for c in ("tag", "train", "y"))
        row = np.tile(np.arange(x.shape[1]), sides)
        root = np.concatenate([np.repeat(np.arange(len(packs)), sizes) + i * len(packs) for i in range(sides)])
        w, known = train.astype(float), np.where(train, y, 0.0)
        levels: list[ensembles.Level] = []
        _, at = ensembles.grow(x, row, root, w, known, depth, np.repeat(least, len(packs)), levels=levels, want=(0,))
        start = at[0]
        section, folds = [p["section_id"] for p in packs] * sides, np.tile([p["fold"] for p in packs], sides)
        own = lambda r: {"section_id": pa.array(section, pa.string()).take(pa.array(r)), "fold": pa.array(folds[r], pa.int32()), "least": pa.array(np.repeat(least, len(packs))[r], pa.int32())}

        def table(columns: dict, n: int) -> pa.RecordBatch:
            kinds = {"tag": pa.int64(), "y": pa.float64(), "path": pa.list_(pa.float64()), "node": pa.int64(), "value": pa.float64(), "n": pa.int64(), "input": pa.int32(), "threshold": pa.float64()}
            return pa.RecordBatch.from_pydict(columns | {c: pa.nulls(n, t) for c, t in kinds.items() if c not in columns})

        asked = np.flatnonzero(~train)
        case = np.concatenate([asked, *[v.moved for v in levels]])
        said = np.concatenate([start[asked], *[v.value for v in levels]])
        said, case = said[~train[case]], case[~train[case]]
        by_case = np.argsort(case, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(case, minlength=len(tag))[asked])])
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(said[by_case]))
        rows = own(root[asked]) | {"tag": tag[asked], "y": pa.array(y[asked], mask=np.isnan(y[asked])), "path": path}
        yield _ordered(table(rows, len(asked)))
        nodes = _nodes(root, w, known, levels)
        columns = own(nodes["root"].to_numpy()) | {"node": pa.array(nodes["node"], pa.int64()), "value": pa.array(nodes["value"], pa.float64()), "n": pa.array(nodes["n"], pa.int64())}
        columns |= {"input": pa.array(nodes["input"], pa.int32(), from_pandas=True), "threshold": pa.array(nodes["threshold"], pa.float64(), from_pandas=True)}
        yield _ordered(table(columns, len(nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packs in ensembles.packs_in(batches, ("section_id", "fold"), max(1, ensembles.ELEMENTS // len(least)), lambda train: train.any()):
            yield from answers(packs)

    return run


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select([c.split()[0] for c in _GROWN.split(", ")])


def grow(
    blocks: DataFrame, features: list[str], least: tuple[int, ...] = (1, 5), depth: int = DEEPEST, k: int = 3, y: str = "measured_flow"
) -> tuple[DataFrame, DataFrame]:
    """(rows to predict with their path, model).

    Rows: section_id, date, split, block, y, least, path; path holds the node means from the root down. Model: section_id,
    fold, least, node, value, n and, for inner nodes, input (0-based), threshold. Depth is limited to 60 levels.
    """
    if depth > DEEPEST:
        raise ValueError(f"depth is at most {DEEPEST}")
    # A key of its own: Spark drops a second deal by the keys of the first, and then merges tasks by their bytes.
    packs = spread(ensembles.packed(forward_cases(blocks, features, k, y)), F.xxhash64("section_id", "fold"))
    grown = cut(packs.mapInArrow(_grown(len(features), least, depth), _GROWN))
    rows = grown.where("node IS NULL").select(
        "section_id", F.date_from_unix_date(F.col("tag").cast("int")).alias("date"), F.when(F.col("fold") == k, "test").otherwise("train").alias("split"),
        F.col("fold").alias("block"), "y", "least", "path",
    )
    return rows, grown.where("node IS NOT NULL").select(*_TREE, "node", "value", "n", "input", "threshold")


def at_depth(depth: int | None) -> Column:
    """What a tree of that depth says, from the path; None: the whole tree."""
    last = F.size("path") if depth is None else F.least(F.size("path"), F.lit(depth + 1))
    return F.get("path", last - 1)


def predict(rows: DataFrame, model: DataFrame, features: list[str], depth: int = DEEPEST) -> DataFrame:
    """rows (section_id, fold, least and the inputs) with pred, by walking the model's nodes; null for an unknown tree.

    A tree travels as one map of its nodes, no larger than its train rows.
    """
    entry = F.struct("node", F.struct("input", "threshold", "value"))
    trees = model.groupBy(*_TREE).agg(F.map_from_entries(F.collect_list(entry)).alias("_nodes"))
    x = F.array(*[F.col(c).cast("double") for c in features])
    start = F.struct(F.lit(1).cast("long").alias("node"), F.lit(False).alias("over"))

    def down(at: Column, _: Column) -> Column:
        here = F.try_element_at("_nodes", at["node"])
        over = at["over"] | here["input"].isNull()
        child = at["node"] * 2 + (F.get("_x", here["input"]) > here["threshold"]).cast("long")
        return F.struct(F.when(over, at["node"]).otherwise(child).alias("node"), over.alias("over"))

    met = rows.withColumn("_x", x).join(trees, _TREE, "left")
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, down, lambda at: at["node"])
    return met.withColumn("pred", F.try_element_at("_nodes", leaf)["value"]).drop("_nodes", "_x")


def tree_predictions(
    blocks: DataFrame, features: list[str], alg: str, grid: list[dict], k: int = 3, y: str = "measured_flow"
) -> DataFrame:
    """Predictions of every point (maxDepth, None for no limit; minInstancesPerNode) of the grid from one growth."""
    deepest = [g.get("maxDepth") for g in grid]
    depth = DEEPEST if None in deepest else min(DEEPEST, max(deepest))
    rows, _ = grow(blocks, features, tuple(sorted({g.get("minInstancesPerNode", 1) for g in grid})), depth, k, y)
    said = F.array(
        *[
            F.struct(F.lit(g.get("minInstancesPerNode", 1)).alias("own"), F.lit(i).alias("point"), at_depth(g.get("maxDepth")).alias("pred"))
            for i, g in enumerate(grid)
        ]
    )
    return (
        rows.select("section_id", "date", "split", F.lit(alg).alias("alg"), "block", "y", "least", F.inline(said))
        .where("own = least")
        .drop("own", "least")
    )
