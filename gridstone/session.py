"""Session settings that results depend on, the workers' import path, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # long texts: a batch is held whole by a worker,
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",  # so its bytes are bounded too, and with them the copies that a worker makes
}


def build(master: str = "local[*]", name: str = "gridstone", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable by Python workers (for a session that was started elsewhere), and set what may be set late."""
    root, path = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{path}".rstrip(":")
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``. Where the session has none, a temporary one in local mode (as in tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridstone-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: for rows that cost joins and are passed over several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
