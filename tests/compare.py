"""Compare the catalogue's queries with their SQL in DuckDB."""

from __future__ import annotations

import os
import sys
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}" if abs(float(v)) < 1e15 else str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.api.types.is_scalar(v) and pd.isna(v) else cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: ("number" if pd.api.types.is_numeric_dtype(t) and t != bool else "time" if "datetime" in str(t) else "bool" if t == bool else "object") for c, t in df.dtypes.items()}


def difference(spark_df, con, sql: str) -> str:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import time

    from gridstone import catalog
    from gridstone.session import build

    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("OFF")
    con, names = connect(sys.argv[1]), sys.argv[2:]
    queries, sql, good = catalog.queries(), catalog.oracle_sql(), 0
    for name, q in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            said = difference(q(spark, sys.argv[1]), con, sql[name]) if name in sql else f"rows only: {q(spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        good += not said or said.startswith("rows only")
        if said or time.time() - began > 8:
            print(name, f"{time.time() - began:.1f} s", said, flush=True)
    print(good, "good of", len(queries))
