"""Ordered per-section work, for short and for very long sections.

A section is a series of rows in date order. With one row per (section, date)
and a DateType order, the number of rows of a section is bounded by the
calendar (two centuries of days are 73,050 rows) no matter how many raw records
fed it, and a plain window over the section is safe. ``series_for`` checks that
on the data. A caller may set ``span_days``: the functions here then cut the
calendar into chunks, work on (section, chunk) groups and pass only the small
border state between chunks. The exponential memory always works in chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirline.sources.scratch import stack

#: Days in a chunk of the exponential memory, whose cost grows with the square of a chunk's rows.
MEMORY_DAYS = 1_024


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...] = ("section_id",)
    order: str = "date"
    span_days: int | None = None

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(self.order)

    def chunk(self) -> Column:
        days = F.datediff(F.col(self.order), F.lit("1900-01-01").cast("date"))
        return F.floor(days / F.lit(self.span_days)).cast("long")


DEFAULT = Series()


def series_for(df: DataFrame, series: Series = DEFAULT) -> Series:
    """``series``, once the data are known to have one row per (section, date).

    Such a section is bounded by the calendar. Rejects panels with several rows
    for one (section, date), whose order is undefined; one flag reaches the driver.
    """
    if not isinstance(df.schema[series.order].dataType, T.DateType):
        raise TypeError(f"{series.order} must be a date column")
    per_day = df.groupBy(*series.keys, series.order).agg(F.count("*").alias("_c"))
    if per_day.agg(F.max("_c")).first()[0] not in (None, 1):
        raise ValueError(f"several rows share one {series.keys + (series.order,)}")
    return series


def _key_order(series: Series) -> WindowSpec:
    return Window.partitionBy(*series.keys).orderBy("_chunk")


def _chunk_counts(rows: DataFrame, series: Series) -> DataFrame:
    """(keys, _chunk, _n, _before): rows in a chunk and in the chunks before it."""
    counts = rows.groupBy(*series.keys, "_chunk").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(_key_order(series))
    return counts.withColumn("_before", upto - F.col("_n"))


def lookback(
    df: DataFrame,
    series: Series,
    rows: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Apply ``add(df, window)``, where the window may look at most ``rows`` rows back."""
    if series.span_days is None:
        return add(df, series.window())
    chunked = df.withColumn("_chunk", series.chunk())
    group = [*series.keys, "_chunk"]
    # Each chunk receives copies of the last `rows` rows before it; a thin chunk
    # may pass rows on to more than one successor.
    next_chunks = F.collect_list(F.struct("_chunk", "_before")).over(
        _key_order(series).rowsBetween(1, rows)
    )
    counts = _chunk_counts(chunked, series).withColumn("_next", next_chunks)
    from_end = F.row_number().over(
        Window.partitionBy(*group).orderBy(F.col(series.order).desc())
    )
    tails = (
        chunked.withColumn("_from_end", from_end)
        .where(F.col("_from_end") <= rows)
        .join(counts, group)
        .withColumn(
            "_to",
            F.explode(
                F.filter(
                    "_next",
                    lambda c: c["_before"] - F.col("_before") - F.col("_n") + F.col("_from_end")
                    <= rows,
                )
            ),
        )
        .withColumn("_chunk", F.col("_to._chunk"))
        .select(*chunked.columns, F.lit(True).alias("_copy"))
    )
    both = stack([chunked.withColumn("_copy", F.lit(False)), tails])
    done = add(both, series.window("_chunk"))
    return done.where(~F.col("_copy")).drop("_copy", "_chunk")


def number(df: DataFrame, series: Series, pos: str = "pos", total: str = "n") -> DataFrame:
    """1-based position in date order and size of the section."""
    if series.span_days is None:
        whole = Window.partitionBy(*series.keys)
        return df.withColumn(pos, F.row_number().over(series.window()).cast("long")).withColumn(
            total, F.count("*").over(whole)
        )
    chunked = df.withColumn("_chunk", series.chunk())
    counts = _chunk_counts(chunked, series).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(*series.keys))
    )
    local = F.row_number().over(series.window("_chunk"))
    return (
        chunked.withColumn("_local", local)
        .join(counts, [*series.keys, "_chunk"])
        .withColumn(pos, F.col("_local") + F.col("_before"))
        .withColumn(total, F.col("_all"))
        .drop("_chunk", "_local", "_n", "_before", "_all")
    )


def _memory_step(alpha: float):
    """One step of the memory: state (y, w), missing values only fade the weight."""
    keep, new = 1 - alpha, alpha

    def step(y: Column, w: Column, x: Column) -> tuple[Column, Column]:
        faded = w * F.lit(keep)
        mixed = (y * faded + F.lit(new) * x) / (faded + F.lit(new))
        y2 = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(mixed)
        w2 = F.when(x.isNotNull(), F.lit(1.0)).when(y.isNull(), w).otherwise(faded)
        return y2, w2

    return step


def exponential_memory(
    df: DataFrame, series: Series, value: str, name: str, alpha: float = 0.2
) -> DataFrame:
    """Exponentially weighted mean along each section.

    The first observation seeds the mean. A missing observation keeps the mean
    and fades its weight by (1 - alpha). Chunks keep the work linear in the rows.
    """
    step = _memory_step(alpha)
    if series.span_days is None:
        series = replace(series, span_days=MEMORY_DAYS)
    group = [*series.keys, "_chunk"]
    rest = [c for c in df.columns if c not in series.keys]
    src = df.withColumn("_chunk", series.chunk())
    entry = F.struct(F.col(series.order).alias("_o"), F.col(value).alias("_x"), F.struct(*rest).alias("_row"))
    packed = src.groupBy(*group).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    xs = F.transform("_rows", lambda r: r["_x"])
    packed = packed.join(_memory_carry(packed.select(*group, xs.alias("_xs")), series, alpha), group)

    def merge(acc, x):
        y, w = step(acc["y"], acc["w"], x)
        return F.struct(y.alias("y"), w.alias("w"), F.concat(acc["out"], F.array(y)).alias("out"))

    start = F.struct(
        F.col("_y").alias("y"), F.col("_w").alias("w"), F.array().cast("array<double>").alias("out")
    )
    memory = F.aggregate(xs, start, merge, lambda acc: acc["out"])
    zipped = F.zip_with("_rows", memory, lambda r, m: F.struct(r["_row"].alias("r"), m.alias("m")))
    return (
        packed.select(*series.keys, F.explode(zipped).alias("_z"))
        .select(*series.keys, "_z.r.*", F.col("_z.m").alias(name))
        .select(*df.columns, name)
    )


def _memory_carry(chunks: DataFrame, series: Series, alpha: float) -> DataFrame:
    """State entering each chunk.

    Within a chunk the mean after its first observation is carried through an
    affine map y -> a*y + b, so a chunk is summed up by six numbers and only
    these are walked in order.
    """
    keep, new = 1 - alpha, alpha
    none = F.lit(None).cast("double")

    def merge(acc, x):
        faded = acc["w"] * F.lit(keep)
        started = acc["first"].isNotNull()
        seen = x.isNotNull()
        return F.struct(
            F.coalesce(acc["first"], x).alias("first"),
            F.when(~started & ~seen, acc["lead"] + 1).otherwise(acc["lead"]).alias("lead"),
            F.when(started & seen, acc["a"] * faded / (faded + F.lit(new))).otherwise(acc["a"]).alias("a"),
            F.when(started & seen, (acc["b"] * faded + F.lit(new) * x) / (faded + F.lit(new)))
            .otherwise(acc["b"])
            .alias("b"),
            F.when(seen, F.lit(1.0)).when(started, faded).otherwise(acc["w"]).alias("w"),
        )

    start = F.struct(
        none.alias("first"), F.lit(0.0).alias("lead"), F.lit(1.0).alias("a"),
        F.lit(0.0).alias("b"), F.lit(1.0).alias("w"),
    )
    summed = chunks.select(*series.keys, "_chunk", F.aggregate("_xs", start, merge).alias("s"))
    state_type = "array<struct<_chunk:bigint,_y:double,_w:double>>"

    def walk(acc, c):
        s, y, w = c["s"], acc["y"], acc["w"]
        faded = w * F.pow(F.lit(keep), s["lead"] + 1)
        opened = F.when(y.isNull(), s["first"]).otherwise(
            (y * faded + F.lit(new) * s["first"]) / (faded + F.lit(new))
        )
        empty = s["first"].isNull()
        # In an empty chunk `lead` counts all of its rows.
        waited = F.when(y.isNull(), w).otherwise(w * F.pow(F.lit(keep), s["lead"]))
        return F.struct(
            F.when(empty, y).otherwise(s["a"] * opened + s["b"]).alias("y"),
            F.when(empty, waited).otherwise(s["w"]).alias("w"),
            F.concat(
                acc["out"],
                F.array(F.struct(c["_chunk"].alias("_chunk"), y.alias("_y"), w.alias("_w"))),
            ).alias("out"),
        )

    begin = F.struct(none.alias("y"), F.lit(1.0).alias("w"), F.array().cast(state_type).alias("out"))
    return (
        summed.groupBy(*series.keys)
        .agg(F.sort_array(F.collect_list(F.struct("_chunk", "s"))).alias("cs"))
        .select(*series.keys, F.inline(F.aggregate("cs", begin, walk, lambda acc: acc["out"])))
    )
