"""The corpus pipeline: language, quality, near duplicates, secrets, packing.

Null and empty texts have no letters, so the language stage rejects them; null ids, repeated rows and columns besides those of documents are kept by
every stage, but for repeated ids, of which the near-duplicate stage keeps one; an empty table stays empty. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import langid, packing, quality, secrets, simhash
from gridstone.llm.common import written
from gridstone.llm.queries import _tokenizer
from gridstone.session import prepare

#: The score below which a document is rejected by the quality stage, and the token that ends a packed document.
LEAST_QUALITY, END_ID = 0.5, 1
#: Bytes of an Arrow batch: the workers of all stages run one after another beside the same executors, and each keeps the memory of its largest batches.
BATCH = "4m"


def _prepared(spark: SparkSession) -> None:
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; those without letters (``und``) go. The prediction becomes ``lang``."""
    _prepared(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs, model, also=tuple(docs.columns), names=("__lang", "__sure"))
    return told.where("__lang <> 'und'").select(*(F.col("__lang").alias(c) if c == "lang" else c for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer takes for good stay."""
    _prepared(spark)
    scored = quality.scored(docs, quality.fit(docs), also=tuple(docs.columns), names=("__posterior", "__quality"))
    return scored.where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id."""
    _prepared(spark)
    return simhash.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` follows; all documents stay."""
    _prepared(spark)
    forest = secrets.fit(words=_tokenizer("word_bpe_49k.json"))
    return secrets.redacted(docs, forest).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents, with their ids' checksum."""
    _prepared(spark)
    return packing.digests(packing.pack(docs, _tokenizer("byte_bpe_50k.json"), END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", good_quality), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("packing", packed),
]

#: No stage can be told in SQL (trained models, sets of shingles, tokens); test_pipeline_stages_match_plain_versions compares each, on its own input, with a plain loop
#: over rows (near duplicates: over all pairs of them).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
