"""Streaming queries over the events table, each drained once, so that it equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import micro_batch as M
from .base import query, r, table


def _stream(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "events")
    return spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def z1_micro_batch_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "z1")

    def body(batch: DataFrame, number: int) -> None:
        batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    M.each_batch(_stream(spark, d), path, body)
    # a batch that is run again overwrites its own folder, so the sum over batches holds each row once
    return spark.read.parquet(*[f"{path}/batch=*"]).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))


@query("SELECT event_id, user_id FROM events")
def z4_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """A feed that delivers every event at least once, here twice: each id comes out once."""
    s = M.first_seen(_stream(spark, d).union(_stream(spark, d)), "event_id", "ts").select("event_id", "user_id")
    return M.drain(s, _path(spark, "z4"))


@query("WITH h AS (SELECT user_id AS key, value AS new, event_id AS place, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) SELECT key, old, new, place FROM h WHERE old <> new")
def z5_change_log(spark: SparkSession, d: str) -> DataFrame:
    return M.drain(M.change_log(_stream(spark, d), "user_id", "value", "event_id"), _path(spark, "z5"))


@query("SELECT count(*) AS batches_rows, round(sum(value), 2) AS total FROM events")
def z2_process_each_batch(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "z2")
    M.each_batch(_stream(spark, d), path, lambda b, i: b.select("value").write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return spark.read.parquet(f"{path}/batch=*").agg(F.count("*").alias("batches_rows"), r(F.sum("value"), 2).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def z3_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return M.newest(M.tumbling(_stream(spark, d), "ts", "1 day", "1 hour", "event_type"), _path(spark, "z3"), "start", "event_type")


@query("SELECT 'new_data' AS type, event_type || ' by user ' || user_id AS message, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events WHERE value > 50 AND strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-10T00:00:00'")
def z6_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Events of a high value are put on the notification log; a reader asks for those since its last visit."""
    path = _path(spark, "z6")
    M.notify(_stream(spark, d).where("value > 50"), path, "new_data", F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")), "ts", "event_id")
    return M.notifications(spark, path, "event_id: bigint", "2024-01-10T00:00:00").select("type", "message", "data.event_id", "timestamp")
