"""Delimited text with unknown separators and encodings, and a registry of sources with one contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATORS = (";", ",", "\t")
ENCODINGS = ("UTF-8", "ISO-8859-1")


def sniff(spark: SparkSession, path: str) -> str:
    """The separator that the header line has most often; only the first line is read, by Spark's reader."""
    first = spark.read.text(path).limit(1).collect()
    return max(SEPARATORS, key=first[0][0].count) if first else ","


def read_robust(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file or folder: sniffed separator, UTF-8 or else Latin-1, malformed lines dropped, blank and unnamed columns removed."""
    sep = sniff(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).option("encoding", ENCODINGS[0]).csv(path)
    bad = F.lit(False)
    for c, t in df.dtypes:
        bad = bad | (F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False)) if t == "string" else F.lit(False))
    if df.where(bad).limit(1).count():
        df = (reader.schema(schema) if schema else reader).option("encoding", ENCODINGS[1]).csv(path)
    return df.select([c for c in df.columns if c and not c.startswith(("Unnamed", "_c"))])


def read_latin(spark: SparkSession, path: str, names: dict[str, str], sep: str = ";") -> DataFrame:
    """Latin-1 text whose headers get other names; the columns stay text."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").csv(path).withColumnsRenamed(names)


def newest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """The path of the file under ``folder`` that was changed last (ties: the greatest path). Only file listings are read, no contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    last = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return last and last.path


def read_upload(spark: SparkSession, content: bytes, path: str) -> DataFrame:
    """A delimited upload (UTF-8, else Latin-1), kept at ``path``, where executors can read it; unnamed columns go."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("iso-8859-1")
    spark.createDataFrame([(text.rstrip("\r\n"),)], "value string").coalesce(1).write.text(path)
    return read_robust(spark, path)


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of differing columns as one frame, missing columns null, with ``_source_file``."""
    parts = [read_robust(spark, p).withColumn("_source_file", F.lit(p.rsplit("/", 1)[-1])) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class Registry:
    """Sources by name and priority: each loads a frame and maps it to the wanted columns; the union keeps the best source of each key."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns
        self.sources: list[tuple[int, str, Callable[[SparkSession], DataFrame], dict[str, str]]] = []

    def register(self, name: str, priority: int, load: Callable[[SparkSession], DataFrame], names: dict[str, str]) -> None:
        self.sources.append((priority, name, load, names))

    def conform(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        held = {names.get(c, c): c for c in df.columns}
        return df.select(*((F.col(held[c]) if c in held else F.lit(None)).cast(t).alias(c) for c, t in self.columns.items()))

    def ingest(self, spark: SparkSession) -> DataFrame:
        parts = [self.conform(load(spark), names).withColumns({"source": F.lit(name), "priority": F.lit(p)}) for p, name, load, names in sorted(self.sources, key=lambda s: s[:2])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
