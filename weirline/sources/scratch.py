"""Tables written to the shared folder to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; without one, the session's warehouse, and that in local runs only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/weirline-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and go on from there.

    Drops the lineage like a checkpoint, survives lost executors, and unlike a
    checkpoint later steps read only the columns they need.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stack(parts: Iterable[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by name.

    Spark 4.1.2 may take a union to be partitioned like its inputs and then
    skip an exchange that a later window or aggregate needs, which loses rows
    without an error. The setting below switches that off for the session.
    """
    parts = list(parts)
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Hash-partition by key over at least as many tasks as run at once, and at least ``least``.

    For work that costs far more time than bytes: adaptive execution merges small
    partitions by their bytes alone, and would leave such work to a few tasks. A
    fixed number of partitions is kept as it is.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)
    return df.repartition(tasks, *keys)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this library has written and no longer needs."""
    if "/weirline-" not in path:
        raise ValueError(f"not a table of this library: {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
