"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a unit vector; its bucket in a table is the signed axis nearest to it. A
query looks into its `probes` nearest axes of each of `tables` tables and ranks
all it finds by the inner product of the original vectors in double precision.

Vectors are told apart by bands of their norm, a quarter of a doubling wide, within
which the order by angle is nearly the order by inner product; a query looks into
each band. A band of at most `few` vectors is one bucket, compared whole: a norm
outlier meets every query. A query that finds less than it could
(k, or all others of its dimension) is compared with all of them, in blocks.

Buckets are a fixed number per band (tables * 2 * dimension). A bucket with more than
`room` vectors is dealt over several keys, and its queries to all of them, so no
task holds more. Of equal vectors only the k + 1 smallest vec_ids can be in any
answer; the others leave by a ranked window before any exchange of vectors.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null vec_id, take no part, neither as query nor as candidate. Vectors of
different dimension do not meet. Ties go to the smaller vec_id; rows repeated
with the same vec_id and vector count once. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirline.llm.common import tasks
from weirline.sources.scratch import cut, stack

ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, seed: int, table: int) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, d]).integers(0, 2, (ROUNDS, d)) * 2.0 - 1.0
    for s in signs:
        y = hadamard(y * s)
    return y


def axes(x: np.ndarray, seed: int, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first."""
    y = rotated(x, seed, table)
    both = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    near = np.argpartition(-both, min(probes, both.shape[1]) - 1, axis=1)[:, :probes]
    return near


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (doubles) and norm of the rows that take part."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        .where("id is not null and vec is not null")
        .where(finite)
        .withColumn("norm", norm)
        .where("norm > 0")
    )


def search(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    tables: int = 12, probes: int = 9, room: int = 16_384, seed: int = 7, few: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found; is_query is a condition on `id`."""
    rows = usable(vectors, key, vector)
    spark = vectors.sparkSession
    most = rows.agg(F.max("norm")).first()[0] or 1.0
    equal = W.partitionBy("vec").orderBy("id")
    members = rows.dropDuplicates(["id", "vec"]).withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1)
    members = members.withColumn("band", F.round(4 * F.log2(F.lit(most) / F.col("norm"))).cast("int"))
    sizes = members.groupBy(F.size("vec").alias("d"), "band").agg(F.count_distinct("id").alias("n")).collect()
    bands: dict[int, dict[int, bool]] = {}  # per dimension, whether a band is compared whole
    for r in sizes:
        bands.setdefault(r["d"], {})[r["band"]] = r["n"] <= few

    def hashed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, vecs = b.column("id").to_pylist(), b.column("vec").to_pylist()
                mine = [None] * len(ids) if query else b.column("band").to_pylist()
                groups: dict[tuple, list[int]] = {}
                for i, v in enumerate(vecs):
                    groups.setdefault((len(v), mine[i]), []).append(i)
                for (d, band), at in groups.items():
                    x = np.array([vecs[i] for i in at])
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    blob = [v.tobytes() for v in x]

                    def made(names: list[str], n: int) -> pa.RecordBatch:
                        return pa.RecordBatch.from_pydict(
                            {
                                "bucket": pa.array(names, type=pa.string()),
                                "id": pa.array(np.repeat([ids[i] for i in at], n), type=pa.int64()),  # noqa: B023
                                "vec": pa.array([v for v in blob for _ in range(n)], type=pa.binary()),  # noqa: B023
                            }
                        )

                    to = bands.get(d, {}) if query else {band: bands[d][band]}
                    for whole in (c for c, w in to.items() if w):
                        yield made([f"{d}:{whole}:all"] * len(at), 1)
                    hashed_to = [c for c, w in to.items() if not w]
                    for t in range(tables if hashed_to else 0):
                        near = axes(unit, seed, t, probes if query else 1)
                        for c in hashed_to:
                            yield made([f"{d}:{c}:{t}:{a}" for a in near.ravel()], near.shape[1])

        return run

    kind = "bucket string, id long, vec binary"
    index = members.select("id", "vec", "band").mapInArrow(hashed(False), kind)
    asking = rows.dropDuplicates(["id", "vec"]).where(is_query).select("id", "vec")
    asked = asking.mapInArrow(hashed(True), kind)
    crowded = {r["bucket"]: -(-r["count"] // room) for r in index.groupBy("bucket").count().where(F.col("count") > room).collect()}
    parts = F.lit(1)
    if crowded:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in crowded.items() for x in kv])[F.col("bucket")], F.lit(1))

    def dealt(index: DataFrame, asked: DataFrame, parts: Column) -> DataFrame:
        index = index.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long"))).withColumn("kind", F.lit(0))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).withColumn("kind", F.lit(1))
        both = stack([index.select("bucket", "part", "kind", "id", "vec"), asked.select("bucket", "part", "kind", "id", "vec")])
        return both.repartition(tasks(spark), "bucket", "part").sortWithinPartitions("bucket", "part", "kind", "id")

    def best(ids: np.ndarray, vecs: np.ndarray, own: int, query: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the candidates, scored once more row by row so that equal vectors score alike."""
        mine = np.flatnonzero(ids != own)
        if len(mine) > k:
            least = np.partition(rough[mine], len(mine) - k)[len(mine) - k]
            mine = mine[rough[mine] >= least - 1e-9 * max(1.0, abs(least))]
        score = (vecs[mine] * query).sum(axis=1)
        order = np.lexsort((ids[mine], -score))[:k]
        return ids[mine][order], score[order]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}
        cell, ids, vecs, block, waiting = None, [], [], None, []

        def answer() -> None:
            nonlocal block
            if not waiting or not ids:
                waiting.clear()
                return
            if block is None:
                block = np.array(ids, dtype=np.int64), np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
            queries = np.frombuffer(b"".join(v for _, v in waiting)).reshape(len(waiting), -1)
            rough = queries @ block[1].T
            for (q, v), r, vec in zip(waiting, rough, queries, strict=True):
                at, score = best(*block, q, vec, r)
                if (q, v) in found:
                    at, first = np.unique(np.concatenate([found[q, v][0], at]), return_index=True)
                    score = np.concatenate([found[q, v][1], score])[first]
                    order = np.lexsort((at, -score))[:k]
                    at, score = at[order], score[order]
                found[q, v] = at, score
            waiting.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array([q for q, _ in found], type=pa.int64()),
                    "ids": pa.array([x[0] for x in found.values()], type=pa.list_(pa.int64())),
                    "scores": pa.array([x[1] for x in found.values()], type=pa.list_(pa.float64())),
                }
            )
            found.clear()
            return made

        for b in batches:
            for bucket, part, kind_, i, v in zip(*[b.column(c).to_pylist() for c in ("bucket", "part", "kind", "id", "vec")], strict=True):
                if (bucket, part) != cell:
                    answer()
                    cell, ids, vecs, block = (bucket, part), [], [], None
                if kind_ == 0:
                    ids.append(i)
                    vecs.append(v)
                else:
                    waiting.append((i, v))
                    if len(waiting) == 256:
                        answer()
            if len(found) > 20_000:
                yield out()
        answer()
        if found:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of one query come together; they are merged as they come."""
        query, held = None, {}

        def out() -> pa.RecordBatch:
            order = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k]
            return pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array([query] * len(order), type=pa.int64()), "rank": pa.array(range(1, len(order) + 1), type=pa.int32()),
                    "vec_id": pa.array([x[0] for x in order], type=pa.int64()), "score": pa.array([x[1] for x in order], type=pa.float64()),
                }
            )

        for b in batches:
            for q, ids, scores in zip(*[b.column(c).to_pylist() for c in ("query_id", "ids", "scores")], strict=True):
                if q != query:
                    if held:
                        yield out()
                    query, held = q, {}
                held.update(zip(ids, scores, strict=True))
        if held:
            yield out()

    def nearest(cells: DataFrame) -> DataFrame:
        partial = cells.mapInArrow(tile, "query_id long, ids array<long>, scores array<double>")
        lists = partial.repartition(tasks(spark), "query_id").sortWithinPartitions("query_id")
        return lists.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

    found = cut(nearest(dealt(index, asked, parts)))
    others = members.groupBy(F.size("vec").alias("d")).agg((F.count_distinct("id") - 1).alias("others"))
    answers = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("got"))
    could = asking.select("id", F.size("vec").alias("d")).join(others, "d").join(answers, "id", "left")
    short = cut(could.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "others")).select("id").distinct())
    if short.limit(1).count() == 0:
        return found
    # Few queries, if any: their whole dimension, block against block.
    again = asking.join(short, "id").withColumn("d", F.size("vec"))
    rest = members.withColumn("d", F.size("vec")).join(again.select("d").distinct(), "d", "left_semi")
    blocks = {r["d"]: -(-r["n"] // room) for r in rest.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for kv in blocks.items() for x in (str(kv[0]), kv[1])])[F.col("bucket")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([str(len(v)) for v in vecs], type=pa.string()), "id": b.column("id"),
                    "vec": pa.array([np.array(v, dtype=np.float64).tobytes() for v in vecs], type=pa.binary()),
                }
            )

    filled = nearest(dealt(*[x.select("id", "vec").mapInArrow(whole, kind) for x in (rest, again)], parts))
    return stack([found.join(short, F.col("query_id") == F.col("id"), "left_anti"), filled])
