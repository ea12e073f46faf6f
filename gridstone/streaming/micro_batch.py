"""Micro-batches of a growing folder: upserts, deduplicated reading, change logs, windows, notifications and run logs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet at ``path``, and read the result."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def each_batch(stream: DataFrame, path: str, body: Callable[[DataFrame, int], None]) -> None:
    """Run ``body`` on every micro-batch of what is there now; batches never overlap."""
    stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped as time moves on."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of ``value`` for each event-time window; state is dropped when the watermark passes a window's end."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", F.round("total", 2).alias("total"))


def newest(windows: DataFrame, path: str, *key: str) -> DataFrame:
    """Run a stream of windows over all that is there now, in update mode, and read each window's newest state, open windows too.

    Every micro-batch writes the windows that it changed to a folder of its own (a batch that is run again overwrites it).
    """
    spark = windows.sparkSession
    schema = StructType([*windows.schema.fields, StructField("__batch", IntegerType())])

    def body(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number:08d}")

    windows.writeStream.foreachBatch(body).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(schema).parquet(f"{path}/out/*")
    rest = [c for c in seen.columns if c not in (*key, "__batch")]
    return seen.groupBy(*key).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*key, *(f"x.{c}" for c in rest))


def notify(stream: DataFrame, path: str, kind: str, message: Column, at: str, *data: str) -> None:
    """Append a notification for each row of what is there now to the log at ``path``: JSON lines of type, message, data and time, each written once."""
    payload = F.to_json(F.struct(F.lit(kind).alias("type"), message.alias("message"), F.struct(*data).alias("data"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
    stream.select(payload.alias("value")).writeStream.format("text").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def notifications(spark: SparkSession, path: str, data: str, after: str | None = None) -> DataFrame:
    """``(type, message, data, timestamp)`` of the log's notifications that are later than ``after`` (all by default), as a reader that comes back asks for them."""
    x = F.from_json("value", f"type string, message string, data struct<{data}>, timestamp string").alias("x")
    log = spark.read.text(f"{path}/out").select(x).select("x.*")
    return log if after is None else log.where(F.col("timestamp") > after)


class RunLog(StreamingQueryListener):
    """The event stream of running queries: a line for each start, micro-batch and end, handed to ``write`` (by default kept in ``lines``)."""

    def __init__(self, write: Callable[[dict], None] | None = None):
        self.lines: list[dict] = []
        self.write = write or self.lines.append

    def onQueryStarted(self, event) -> None:
        self.write({"event": "started", "run": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        self.write({"event": "batch", "run": str(event.progress.runId), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write({"event": "ended", "run": str(event.runId), "error": event.exception})


def change_log(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, old, new, place)`` whenever a key's value differs from that before, in the order of ``order`` within a batch; one value a key is held as state."""

    def step(k, batches, state):
        old = state.get[0] if state.exists else None
        rows = []
        for pdf in sorted(pd.concat(list(batches)).sort_values(order)[[order, value]].itertuples(index=False)):
            if old is not None and pdf[1] != old:
                rows.append((k[0], old, pdf[1], pdf[0]))
            old = pdf[1]
        state.update((old,))
        yield pd.DataFrame(rows, columns=["key", "old", "new", "place"]).astype({"key": "int64", "old": "float64", "new": "float64", "place": "int64"})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, "key long, old double, new double, place long", "old double", "append", GroupStateTimeout.NoTimeout)
