"""Run a query beside its SQL and report differences. Also a command line tool:

python tests/compare.py FOLDER [name ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_session(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype))
        for c in sorted(got.columns)
        if got[c].dtype != want[c].dtype and object not in (got[c].dtype, want[c].dtype)
        and not str(want[c].dtype).startswith(("datetime", "int", "float"))
        or (str(got[c].dtype)[:3], str(want[c].dtype)[:3]) in (("int", "flo"), ("flo", "int"))
    ]
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            same = (a[c].astype(float) == b[c].astype(float)) | (a[c].isna() & b[c].isna())
        else:
            same = a[c].astype(str) == b[c].astype(str)
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} of {len(same)} differ, e.g.\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return f"types {kinds}" if kinds else None


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, names = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weirline-"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = sql_session(folder), 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            t1 = time.time()
            if name in sqls:
                diff = differences(got, con.execute(sqls[name]).df())
            else:
                diff = None if len(got) else "no rows"
        except Exception as e:  # noqa: BLE001
            diff, t1, got = f"{type(e).__name__}: {str(e)[:400]}", time.time(), []
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} {len(got):7d} rows  spark {t1 - t0:5.1f}s  sql {time.time() - t1:5.1f}s"
              f"{'' if name in sqls else '  (rows only)'}" + (f"\n    {diff}" if diff else ""), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
