"""Packing documents into batches by optimal length buckets.

Lengths (words) are rounded up to a step, counted once in a global histogram,
and dynamic programming over it picks the bucket bounds that waste the least
padding. Inside a bucket every row is padded to the bucket's bound, and batches
take as many rows as the token budget holds.

The histogram has a proven size: steps of 8 up to 16,384 words, then 1/128 of
the next power of two, some 4,000 lines for texts of any length.

Nulls: a null text has length 0 and is padded to the smallest step; a null
doc_id is kept. Repeated rows are packed one by one. A document longer than the
budget makes a batch of its own. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirline.llm.common import shuffled, word_count
from weirline.sources.scratch import cut

STEP, FINE = 8, 16384


def rounded(length: Column) -> Column:
    """Length rounded up to its step."""
    octave = F.floor(F.log2(F.greatest(length, F.lit(FINE + 1)) - 1))
    step = F.when(length <= FINE, F.lit(STEP)).otherwise(F.pow(F.lit(2), octave - 7)).cast("long")
    return F.greatest(F.lit(STEP), F.ceil(length / step) * step).cast("long")


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padded tokens.

    lengths ascend; cost of a bucket is its bound times its rows. best[j] is the
    cost of the first j lengths in the buckets allowed so far.
    """
    m = len(lengths)
    if not m:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = np.concatenate([[0.0], lengths * rows[1:]])
    froms = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(min(buckets, m) - 1):
        nxt, where = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            i = int(cost.argmin())
            if cost[i] < nxt[j]:
                nxt[j], where[j] = cost[i], i
        froms.append(where)
        if (where < 0).all():
            break
        best = nxt
    out, j, level = [], m, len(froms) - 1
    while j > 0:
        while level > 0 and froms[level][j] < 0:
            level -= 1
        out.append(int(lengths[j - 1]))
        j, level = int(froms[level][j]), max(0, level - 1)
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 32, budget: int = 65536, seed: str = "pack") -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded (its bound), batch (from 0 in the bucket), slot, batch_rows."""
    sized = cut(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), shuffled(F.lit(seed), F.col("doc_id")).alias("key")))
    sized = sized.withColumn("rounded", rounded(F.col("n_tokens")))
    lines = sized.groupBy("rounded").count().orderBy("rounded").collect()
    ends = bounds(np.array([r[0] for r in lines], dtype=np.float64), np.array([r[1] for r in lines]), buckets)
    if not ends:
        ends = [STEP]
    lit = F.array(*[F.lit(e).cast("long") for e in ends])
    placed = (
        sized.withColumn("bucket", F.size(F.filter(lit, lambda e: e < F.col("rounded"))))
        .withColumn("padded", F.element_at(lit, F.col("bucket") + 1))
        .withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long"))
        .withColumn("piece", F.substring("key", 1, 3))
    )
    # Row numbers of a bucket in pieces: rows before a piece, plus the number within it.
    before = W.partitionBy("o_bucket").orderBy("o_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(F.col("bucket").alias("o_bucket"), F.col("piece").alias("o_piece"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("o_bucket", "o_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(W.partitionBy("o_bucket")).alias("bucket_rows"))
    )
    within = W.partitionBy("bucket", "piece").orderBy("key", "doc_id", "n_tokens")
    numbered = placed.join(offsets, (F.col("bucket") == F.col("o_bucket")) & (F.col("piece") == F.col("o_piece"))).withColumn(
        "at", F.col("offset") + F.row_number().over(within) - 1
    )
    batch = F.floor(F.col("at") / F.col("room"))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "padded", batch.alias("batch"), (F.col("at") % F.col("room")).alias("slot"),
        F.least(F.col("room"), F.col("bucket_rows") - batch * F.col("room")).alias("batch_rows"),
    )
