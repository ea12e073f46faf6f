"""The catalogue's registry, and the driver tables seen as listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, listing: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is the same in DuckDB, after the listing view where ``listing`` is set."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (LISTING_SQL + sql) if listing else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LISTING_SQL = """WITH listing AS (
  SELECT l_orderkey * 10 + l_linenumber AS url, l_returnflag AS source, l_extendedprice AS price, l_quantity AS surface,
    l_extendedprice / nullif(l_quantity, 0) AS ppm2, p_type AS property_type, p_name AS title, p_size AS rooms, n_name AS city, r_name AS region,
    l_shipdate AS seen, l_partkey AS part, l_linestatus AS status, l_suppkey AS seller
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings: price, surface, price per m2, type, title, rooms, city, region, source and time. Small dimensions are left to Catalyst to broadcast by their size."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("url"), F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("surface"),
        F.try_divide("l_extendedprice", "l_quantity").alias("ppm2"), F.col("p_type").alias("property_type"), F.col("p_name").alias("title"), F.col("p_size").alias("rooms"),
        F.col("n_name").alias("city"), F.col("r_name").alias("region"), F.col("l_shipdate").alias("seen"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("seller"),
    )


def r(column, digits: int = 4):
    return F.round(column, digits)
