"""Texts as TF-IDF vectors, and their truncated singular value decomposition over row blocks: dense vectors for what texts are about."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a block of the sum over all rows; partial sums are added by block.
BLOCK = 256


def weighted_terms(docs: DataFrame, text_col: str = "text", out: str = "terms", dims: int = 4096):
    """``(model, rows)``: a fitted model that adds ``out``, and ``docs`` with it: hashed words by frequency and rarity, of length 1 (a text without words has none). A null text is empty."""
    known = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2)
    model = Pipeline(stages=[words, HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dims), IDF(inputCol="__counts", outputCol="__weights"), Normalizer(inputCol="__weights", outputCol=out)]).fit(known)
    return model, with_terms(model, docs, text_col, out)


def with_terms(model, docs: DataFrame, text_col: str = "text", out: str = "terms") -> DataFrame:
    return model.transform(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))).select(*docs.columns, out)


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every stored number of a batch of ML vectors."""
    column = column.storage if isinstance(column, pa.ExtensionArray) else column
    parts = dict(zip((f.name for f in column.type), column.flatten()))
    size = [pc.fill_null(pc.list_value_length(parts[c]), 0).to_numpy(zero_copy_only=False) for c in ("indices", "values")]
    if (size[0] == size[1]).all():  # all are sparse, or missing
        return np.repeat(np.arange(len(column)), size[1]), parts["indices"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), parts["values"].flatten().to_numpy(zero_copy_only=False).astype(float)
    rows, features, values = [], [], []
    for i, v in enumerate(column.to_pylist()):
        numbers = np.array(v["values"] if v else [], float)
        places = np.array(v["indices"], np.int64) if v and v["indices"] is not None else np.arange(len(numbers))
        rows.append(np.full(len(numbers), i))
        features.append(places)
        values.append(numbers)
    return (np.concatenate(rows), np.concatenate(features), np.concatenate(values)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _times(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """A sparse block times a dense matrix, a column at a time."""
    return np.column_stack([np.bincount(row, value * right[feature, j], n) for j in range(right.shape[1])]).astype(float)


def _gram_times(rows: DataFrame, terms: str, right: np.ndarray) -> np.ndarray:
    """``A' A right`` for the matrix A of all rows: one pass, a partial sum a task, added by blocks of features in two steps."""
    dims, wide = right.shape
    shared = rows.sparkSession.sparkContext.broadcast(right)  # features x a few columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, wide))
        for batch in batches:
            row, feature, value = _sparse(batch.column(0))
            if len(row):
                y = _times(row, feature, value, batch.num_rows, shared.value)
                total += np.column_stack([np.bincount(feature, value * y[row, j], dims) for j in range(wide)])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(0, dims, BLOCK), pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in range(0, dims, BLOCK)], pa.binary())], names=["block", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s.as_py()) for s in table["sums"]], axis=0)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select(terms).mapInArrow(part, "block int, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy("block", "salt").applyInArrow(added, "block int, sums binary")
    out = np.zeros((dims, wide))
    for r in some.groupBy("block").applyInArrow(added, "block int, sums binary").collect():  # features x a few columns in all
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["sums"]).reshape(-1, wide)
    shared.unpersist()
    return out


@dataclass
class Decomposition:
    """The largest singular values of the matrix of all rows, and their right vectors (features x k)."""

    values: np.ndarray
    vectors: np.ndarray


def truncated_svd(rows: DataFrame, terms: str = "terms", k: int = 16, dims: int = 4096, extra: int = 8, tolerance: float = 1e-5, passes: int = 14, seed: int = 3) -> Decomposition:
    """The ``k`` largest singular values and right vectors of the rows' vectors, by a randomised range finder that keeps every block it has seen (block Lanczos).

    A pass over the rows multiplies a block of ``k + extra`` directions by A' A; what it adds beyond the blocks before is the next block. It ends when the residuals of the k leading pairs are below
    ``tolerance`` of the largest (an error of their values of about its square), or after ``passes``. The driver holds ``passes`` blocks of dims x (k + extra) numbers, whatever the number of rows.
    """
    rng = np.random.default_rng(seed)
    rows = rows.select(terms)
    block = np.linalg.qr(rng.normal(size=(dims, min(k + extra, dims))))[0]
    basis, images = block, np.empty((dims, 0))
    for at in range(passes):
        image = _gram_times(rows, terms, block)
        images = np.hstack((images, image))
        inner = basis.T @ images
        power, turn = np.linalg.eigh((inner + inner.T) / 2)
        power, turn = power[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        rest = np.linalg.norm(images @ turn - vectors * power, axis=0)
        if at == passes - 1 or basis.shape[1] == dims or rest.max(initial=0) <= tolerance * max(power[0], 1e-300):
            break
        new = image - basis @ (basis.T @ image)
        new -= basis @ (basis.T @ new)
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        block = left[:, size > 1e-10 * max(power[0], 1e-300)][:, : dims - basis.shape[1]]
        if not block.shape[1]:
            break
        basis = np.hstack((basis, block))
    return Decomposition(np.sqrt(np.maximum(power, 0)), vectors)


def dense(rows: DataFrame, found: Decomposition, terms: str = "terms", out: str = "dense") -> DataFrame:
    """``rows`` with ``out``, each row's coordinates along the right vectors and without ``terms``; a row without terms has zeros."""
    shared = rows.sparkSession.sparkContext.broadcast(found.vectors)
    at = rows.columns.index(terms)
    keep = [i for i in range(len(rows.columns)) if i != at]
    names = [*(rows.columns[i] for i in keep), out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, value = _sparse(batch.column(at))
            y = _times(row, feature, value, batch.num_rows, shared.value)
            sizes = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.ListArray.from_arrays(sizes, pa.array(y.ravel()))], names=names)

    schema = ", ".join(f"`{rows.columns[i]}` {rows.schema[i].dataType.simpleString()}" for i in keep)
    return rows.mapInArrow(run, f"{schema}, `{out}` array<double>")
