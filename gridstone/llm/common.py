"""Helpers that several operators share: written stages, range keys."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.session import shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; each call gives another, so reruns never meet old files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends at files that any executor can read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_index(key: Column, bounds: list[tuple], schema: str) -> Column:
    """How many of the sorted ``bounds`` (rows of ``schema``, as ``key`` is one) are at most ``key``; a binary search in one expression.

    The bounds are one literal, read from text while the query is planned, so plans stay small however many there are.
    """
    if not bounds:
        return F.lit(0)
    names = [c.split()[0] for c in schema.split(", ")]
    table = F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in bounds])), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(table, at + step) <= key), at + step).otherwise(at),
    )
