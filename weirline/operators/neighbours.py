"""Nearest-neighbour prediction within a section, for all folds and k at once.

Rows of a section travel packed: the train rows, which the calendar bounds, in one
pack, the query rows in parts of bounded size. A task compares a query part with
all train rows of its section and keeps the nearest few per query row, so nothing
is left to merge. Pairs of rows exist only as a small numeric tile inside a task,
never as rows of a table. The train rows of a section lie in boxes of near rows; a
query row meets a box only if the box can hold one of its nearest, so that long
sections compare few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.sources.scratch import spread

PART_DAYS = 10_000  # with one row a day at most this many query rows per part
TILE = 256
BOX = 128
FLUSH = 20_000  # rows of a batch that goes back to Spark, or a pack's if it has more

_FOUND = "d array<double>, near_day array<int>, near_y array<double>, met long"


def _part(day, part_days: int) -> Column:
    """Number of the part that a date, or a count of days, lies in."""
    return F.floor((day - F.unix_date(F.lit("1900-01-01").cast("date"))) / F.lit(part_days)).cast("int")


def _inputs(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


class Boxes:
    """Train rows in boxes of at most BOX rows, halved along the widest side."""

    def __init__(self, t: np.ndarray, block: np.ndarray) -> None:
        self.t, self.block = t, block
        self.rows: list[np.ndarray] = []
        todo = [np.arange(len(t))]
        while todo:
            own = todo.pop()
            if len(own) <= BOX:
                self.rows.append(own)
                continue
            wide = np.ptp(t[own], axis=0).argmax() if t.shape[1] else 0
            half = np.argpartition(t[own, wide], len(own) // 2) if t.shape[1] else np.arange(len(own))
            todo += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
        self.rows = [np.sort(r) for r in self.rows if len(r)]
        self.low = np.array([t[r].min(axis=0) for r in self.rows])
        self.high = np.array([t[r].max(axis=0) for r in self.rows])
        self.first = np.array([block[r].min() for r in self.rows])

    def nearest(self, q: np.ndarray, q_block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query row the squared distances and positions of its k nearest earlier train rows (inf where there are fewer), and the rows met."""
        best, at = np.full((len(q), k), np.inf), np.full((len(q), k), len(self.t))
        if len(self.rows) == 1:
            return self._in_one_box(q, q_block, best, at)
        met = np.zeros(len(q), np.int64)
        bound = np.zeros((len(q), len(self.rows)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - q[:, j, None], q[:, j, None] - self.high[:, j]), 0.0)
            bound += gap * gap
        bound[self.first >= q_block[:, None]] = np.inf

        def meet(b: int, asks: np.ndarray) -> None:
            if not len(asks):
                return
            own = self.rows[b]
            total = np.zeros((len(asks), len(own)))
            for j in range(q.shape[1]):
                gap = q[asks, j, None] - self.t[own, j]
                total += gap * gap
            total[self.block[own] >= q_block[asks, None]] = np.inf
            met[asks] += len(own)
            bound[asks, b] = np.inf
            d = np.concatenate([best[asks], total], axis=1)
            p = np.concatenate([at[asks], np.broadcast_to(own, total.shape)], axis=1)
            # Positions are in date order: of rows equally far the earlier comes first.
            order = np.lexsort((p, d), axis=1)[:, :k]
            best[asks], at[asks] = np.take_along_axis(d, order, axis=1), np.take_along_axis(p, order, axis=1)

        # First each row's own box, then the boxes that can still hold a nearer one.
        home = bound.argmin(axis=1)
        for b in np.unique(home):
            meet(b, np.flatnonzero((home == b) & np.isfinite(bound[:, b])))
        for b in range(len(self.rows)):
            # A row as far as the k-th may still win by its date; the bound is rounded like the distances.
            meet(b, np.flatnonzero((bound[:, b] <= best[:, -1] * (1 + 1e-12)) & np.isfinite(bound[:, b])))
        return best, at, met

    def _in_one_box(self, q: np.ndarray, q_block: np.ndarray, best: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a short section, whose rows are all met at once."""
        total = np.zeros((len(q), len(self.t)))
        for j in range(q.shape[1]):
            gap = q[:, j, None] - self.t[:, j]
            total += gap * gap
        total[self.block >= q_block[:, None]] = np.inf
        order = np.argsort(total, axis=1, kind="stable")[:, : best.shape[1]]
        best[:, : order.shape[1]], at[:, : order.shape[1]] = np.take_along_axis(total, order, axis=1), order
        return best, at, np.where(self.first[0] < q_block, len(self.t), 0)


def _one_per_day(days: np.ndarray, blocks: np.ndarray, d: np.ndarray, day: np.ndarray, y: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of one day as one row: the earliest block's, with the nearest of all of them by distance, day and truth.

    ``d``, ``day`` and ``y`` have a row per query row, inf where there are fewer neighbours.
    """
    order = np.lexsort((blocks, days))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(days[order]) != 0]))
    merged = [a.copy() for a in (d, day, y)]
    for own in np.split(order, starts[1:]):
        flat = [a[own].ravel() for a in (d, day, y)]
        best = np.lexsort(flat[::-1])[: d.shape[1]]
        for a, v in zip(merged, flat):
            a[own[0]] = v[best]
    kept = order[starts]
    return kept, *(a[kept] for a in merged), np.add.reduceat(met[order], starts)


def _search(width: int, k: int, one_per_day: bool):
    def one(own: dict[str, pa.Array], section: str) -> pa.RecordBatch:
        q, t = (own[c].to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("q_x", "t_x"))
        q_block, boxes = own["q_b"].to_numpy(), Boxes(t, own["t_b"].to_numpy())
        tiles = [boxes.nearest(q[a : a + TILE], q_block[a : a + TILE], k) for a in range(0, len(q), TILE)]
        d, at, met = (np.concatenate(x) for x in zip(*tiles))
        kept, days, t_days = own["q_kept"], own["q_day"].to_numpy(), own["t_day"].to_numpy()
        at[~np.isfinite(d)] = 0
        near_day, near_y = t_days[at], own["t_y"].to_numpy()[at]
        if one_per_day and (len(np.unique(days)) < len(days) or len(np.unique(t_days)) < len(t_days)):
            rows, d, near_day, near_y, met = _one_per_day(days, q_block, d, near_day, near_y, met)
            kept = kept.take(pa.array(rows))
        held = np.isfinite(d)
        ends = pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]), type=pa.int32())
        near = [pa.ListArray.from_arrays(ends, pa.array(v[held])) for v in (d, near_day, near_y)]
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(section, pa.string()), len(kept)), kept, *near, pa.array(met)],
            names=["section_id", "kept", "d", "near_day", "near_y", "met"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.RecordBatch] = []
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names if c != "section_id"}
            for i, section in enumerate(batch.column("section_id").to_pylist()):
                found.append(one({c: v[i].values for c, v in columns.items()}, section))
                if sum(b.num_rows for b in found) >= FLUSH or len(found) >= 1_000:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                    found = []
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return search


def search(
    train: DataFrame, asked: DataFrame, features: list[str], k: int, kept: Column, y: str = "measured_flow", part_days: int = PART_DAYS,
    one_per_day: bool = False,
) -> DataFrame:
    """(section_id, kept, d, near_day, near_y, met) of the ``asked`` rows (section_id, date, block, features) with complete inputs.

    ``kept`` is a struct of what an asked row takes along. The arrays hold distance, day and
    truth of the k nearest ``train`` rows of earlier blocks, by ascending distance, earlier
    date first. Any number of asked rows may share a date; ``one_per_day`` answers them with
    one row. A part that ends before its section's first train row has no answer.
    """
    known = train.dropna(subset=features).where(F.col("date").isNotNull() & F.col(y).isNotNull())
    row = F.struct(
        F.unix_date("date").alias("day"), F.col("block").alias("b"), F.col(y).cast("double").alias("y"), _inputs(features).alias("x")
    )
    r = F.col("r")
    taught = known.groupBy("section_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    taught = taught.select("section_id", r["day"].alias("t_day"), r["b"].alias("t_b"), r["y"].alias("t_y"), F.flatten(r["x"]).alias("t_x"))
    ready = asked.dropna(subset=features).withColumn("q_part", _part(F.unix_date("date"), part_days))
    ask = F.struct(F.unix_date("date").alias("day"), F.col("block").alias("b"), kept.alias("kept"), _inputs(features).alias("x"))
    # Rows are dealt once, by section and part: the parts of a section lie apart, packing and join need no exchange.
    queries = spread(ready.select("section_id", "q_part", ask.alias("a")), "section_id", "q_part").groupBy("section_id", "q_part")
    queries = queries.agg(F.collect_list("a").alias("r")).select(
        "section_id", "q_part", r["day"].alias("q_day"), r["b"].alias("q_b"), r["kept"].alias("q_kept"), F.flatten(r["x"]).alias("q_x")
    )
    wanted = ready.select("section_id", "q_part").distinct()
    sent = taught.join(wanted, "section_id").where(_part(F.get("t_day", F.lit(0)), part_days) <= F.col("q_part"))
    met = queries.join(sent, ["section_id", "q_part"]).drop("q_part")
    own = T.StructType([T.StructField(f.name, f.dataType) for f in asked.select(kept.alias("kept")).schema["kept"].dataType])
    schema = T.StructType([T.StructField("section_id", T.StringType()), T.StructField("kept", own), *T.StructType.fromDDL(_FOUND)])
    return met.mapInArrow(_search(len(features), k, one_per_day), schema)


def _answers(blocks: DataFrame, features: list[str], k: int, y: str, part_days: int) -> DataFrame:
    kept = F.struct("date", "split", "block", F.col(y).cast("double").alias("y"))
    found = search(blocks.where("split = 'train'"), blocks.where("block >= 0"), features, k, kept, y, part_days, True)
    return found.select("section_id", "kept.*", "d", "near_day", "near_y", "met")


def nearest(
    blocks: DataFrame, features: list[str], k: int, y: str = "measured_flow", part_days: int = PART_DAYS
) -> DataFrame:
    """(section_id, date, split, block, y, near, met) of all rows with block >= 0.

    ``near`` holds (d, date, y) of the k nearest train rows of earlier blocks, by
    ascending distance, earlier date first. Blocks grow with the date within a
    section. Rows with a missing input are left out on both sides. ``met`` is the number of
    train rows that the row was compared with.
    """
    near = F.zip_with(
        F.arrays_zip("d", "near_day"),
        "near_y",
        lambda a, v: F.struct(a["d"].alias("d"), F.date_from_unix_date(a["near_day"]).alias("date"), v.alias("y")),
    )
    found = _answers(blocks, features, k, y, part_days)
    return found.select("section_id", "date", "split", "block", "y", near.alias("near"), "met")


def near_mean(k: int, near_y: str = "near_y") -> Column:
    """Mean truth of the first k neighbours."""
    first = F.slice(F.col(near_y), 1, k)
    total = F.aggregate(first, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(first) > 0, total / F.size(first))


def knn_predictions(
    blocks: DataFrame, features: list[str], ks: tuple[int, ...] = (3, 5, 7), alg: str = "KNN", y: str = "measured_flow"
) -> DataFrame:
    """Out-of-fold and test predictions for every k, from one neighbour search."""
    found = _answers(blocks, features, max(ks), y, PART_DAYS)
    per_k = F.array(*[F.struct(F.lit(k).alias("k"), near_mean(k).alias("pred")) for k in ks])
    return found.select("section_id", "date", "split", F.lit(alg).alias("alg"), "block", "y", F.inline(per_k))
