"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a run of anything but ASCII white space. bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def shuffled(*parts: Column) -> Column:
    """A hex string that orders rows at random, alike in every run."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def as_row(df: DataFrame, **own: Column) -> DataFrame:
    """One struct `row` of all columns of df beside columns of one's own, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def map_texts(
    df: DataFrame, keep: list[str], columns: list[str], fields: dict[str, str], work: Callable[..., dict], piece: int = 4_000_000
) -> DataFrame:
    """Columns keep of df unchanged, and beside them what work makes of the string columns.

    work gets a list per column (null as empty) and returns a list or array per
    field; it sees so many rows at once that their text stays near `piece` characters.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    made_ = StructType.fromDDL(", ".join(f"{k} {t}" for k, t in fields.items()))
    schema = StructType([StructField(k, kinds[k]) for k in keep] + made_.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [[x or "" for x in b.column(c).to_pylist()] for c in columns]
            at = 0
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and (end == at or size < piece):
                    size += sum(len(t[end]) for t in texts)
                    end += 1
                made = work(*[t[at:end] for t in texts])
                arrays = [b.column(k).slice(at, end - at) for k in keep] + [pa.array(made[k], type=ARROW[t]) for k, t in fields.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *fields])
                at = end

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)
