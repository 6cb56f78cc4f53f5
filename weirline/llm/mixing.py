"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a shuffled queue. The virtual finish time
of a document is the source's tokens up to and including it, divided by the
source's target. A source whose target exceeds its size queues a second time
behind its own end. All appearances are cut, in order of finish time, where the
total budget is used up.

Nulls: a null text has size 0, a null source is a source of its own (last), a
null doc_id is kept. Documents of size 0 take nothing. Repeated rows queue one
by one. Empty tables give empty results. Columns other than doc_id, text and
source are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirline.llm.common import as_row, shuffled, word_count
from weirline.sources.scratch import cut

#: Finish times lie in (0, 2]; the cut is searched in one of so many slices per unit.
SLICES = 16384


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Target per source: shares of the budget by weight, none above most times the source.

    sizes has one row per source (source, source_size). The level L solves
    sum(min(most * size, L * weight)) = share * sum(size); sources are sorted by the
    level at which they are full, and L is the first level that fits the rest.
    Its windows run over one row per source.
    """
    everyone = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_full = W.orderBy("full_at", F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1))
        .withColumn("full_at", F.col("source_size") * most / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everyone))
        .withColumn("place", F.row_number().over(by_full))
        .withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * most).over(by_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_full.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    )
    level = F.min_by("level_here", F.when(F.col("level_here") <= F.col("full_at"), F.col("place"))).over(everyone)
    return ranked.withColumn("level", level).select(
        "source", "source_size", F.least((F.col("source_size") * most).cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words taken, repeats counted), and the columns to carry."""
    sized = cut(docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"), shuffled(F.lit(seed), F.col("doc_id")).alias("key")))
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))

    # The running sum of a source, in pieces: sums before a piece, plus the sum within it.
    pieced = sized.withColumn("piece", F.substring("key", 1, 3))
    before = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieced.groupBy("source", "piece").agg(F.sum("size").alias("piece_size")).select(
        F.col("source").alias("o_source"), F.col("piece").alias("o_piece"), F.coalesce(F.sum("piece_size").over(before), F.lit(0)).alias("offset")
    )
    within = W.partitionBy("source", "piece").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        pieced.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("piece") == F.col("o_piece")))
        .withColumn("upto", F.col("offset") + F.sum("size").over(within))
        .select("doc_id", "source", *carry, "size", "upto")
    )
    plan = plan.withColumnRenamed("source", "p_source")
    finish = [F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * n) / F.col("target")).alias(f"finish{n}") for n in range(most)]
    timed = cut(queued.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select("doc_id", "source", *carry, "size", "source_size", "target", *finish))

    # The last finish time within the budget: sums per slice of time first, then row by row in one slice.
    seen = timed.select("size", F.explode(F.array(*[f"finish{n}" for n in range(most)])).alias("finish")).where("size > 0 and finish <= 2")
    slices = seen.groupBy(F.floor(F.col("finish") * SLICES).alias("slice")).agg(F.sum("size").alias("slice_size"))
    up_to = F.sum("slice_size").over(W.orderBy("slice"))
    budget = plan.agg(F.sum("target").alias("budget")).first()["budget"] or 0.0
    over = slices.withColumn("up_to", up_to).where(F.col("up_to") > F.lit(budget + 0.5)).orderBy("slice").limit(1).collect()
    if not over:
        last = float("inf")
    else:
        slice_, used = over[0]["slice"], over[0]["up_to"] - over[0]["slice_size"]
        inside = seen.where(F.floor(F.col("finish") * SLICES) == slice_).groupBy("finish").agg(F.sum("size").alias("size"))
        run = F.sum("size").over(W.orderBy("finish")) + F.lit(used)
        last = inside.withColumn("run", run).where(F.col("run") <= F.lit(budget + 0.5)).agg(F.max("finish")).first()[0]
        last = math.nextafter(slice_ / SLICES, 0.0) if last is None else last
    takes = sum((F.when((F.col(f"finish{n}") <= F.lit(last)) & (F.col(f"finish{n}") <= 2), 1).otherwise(0) for n in range(most)), F.lit(0))
    return timed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * takes).cast("long").alias("taken"), *carry)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, all columns kept, each as often as the mix takes it (repeated rows together)."""
    own = F.xxhash64("doc_id", "source", "text")
    times = (
        mix(docs.select("doc_id", "source", "text", own.alias("own")), carry=("own",), **how)
        .groupBy(F.col("own").alias("of"))
        .agg(F.try_divide(F.sum("taken"), F.max("size")).cast("int").alias("times"))
        .where("times > 0")
    )
    once = as_row(docs, own=own).dropDuplicates(["own"])
    return once.join(times, F.col("own") == F.col("of")).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The same mix in DuckDB's SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2 / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         row_number() OVER (ORDER BY source_size * 2 / weight, source NULLS LAST) AS place
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(source_size * 2) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level_here
  FROM ranked),
targets AS (
  SELECT source, source_size, least((source_size * 2)::DOUBLE, weight * (SELECT arg_min(level_here, place) FROM levels WHERE level_here <= full_at)) AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
timed AS (
  SELECT *, CASE WHEN target > 0 THEN upto / target END AS f0, CASE WHEN target > 0 THEN (upto + source_size) / target END AS f1 FROM queued),
seen AS (SELECT f0 AS finish, size FROM timed WHERE size > 0 AND f0 <= 2 UNION ALL SELECT f1, size FROM timed WHERE size > 0 AND f1 <= 2),
running AS (SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS run FROM seen GROUP BY finish),
last AS (SELECT max(finish) AS finish FROM running WHERE run <= (SELECT sum(target) FROM targets) + 0.5)
SELECT doc_id, source, size, source_size, target,
       (size * (CASE WHEN f0 <= (SELECT finish FROM last) THEN 1 ELSE 0 END + CASE WHEN f1 <= (SELECT finish FROM last) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM timed
"""
