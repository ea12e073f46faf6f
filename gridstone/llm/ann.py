"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Maximum inner product on unit vectors is cosine. A coarse k-means deals the vectors into lists; each
vector's residual is coded by 4-bit codes (16 centroids for each subspace), trained and chosen by a loss that weighs the
residual's part along the vector ``eta`` times as heavily as the part across it, since only the parallel
part changes large inner products. A query scans the codes of its nearest lists by look-up tables (one table look-up
for a byte, so two codes), and the best of each block are ranked again by exact cosine in double precision.

The codes are fitted on ``sample`` vectors and the lists on 16 each (documented bounds: those of the smallest hashes, at most 65,536); every row is indexed. How
many lists a query visits is chosen on the sample, so that its measured recall reaches ``target``. Beyond 4096 lists of ``list_rows`` rows (4 million), lists grow with
the table: a query then scans a like share of all codes, half a byte for each ``width`` numbers, in blocks over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = 16
#: Vectors that are gathered at a time to be ranked again.
RERANK_BYTES = 64 << 20
#: Products of vectors with all centres that are held at a time.
CELL_BYTES = 64 << 20


def _near(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` centres of largest product for each row, the largest first, in blocks of rows."""
    out, few = np.empty((len(x), k), np.int64), max(1, CELL_BYTES // (8 * len(centres)))
    for at in range(0, len(x), few):
        score = x[at : at + few] @ centres.T
        if k == 1:
            out[at : at + few, 0] = score.argmax(1)
            continue
        top = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1) if k < len(centres) else np.broadcast_to(np.arange(k), score.shape)
        out[at : at + few] = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square leaves the range of doubles; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; an empty cell takes over a random point."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        cell = _near(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        empty = np.bincount(cell, minlength=k) == 0
        total[empty] = x[rng.integers(0, len(x), empty.sum())]
        centres = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Codebook:
    """Coarse centres (lists x dims), code centres (subspaces x 16 x width) and the loss's weight of the parallel part."""

    coarse: np.ndarray
    codes: np.ndarray
    eta: float
    probes: int = 1

    @property
    def padded(self) -> int:
        return self.codes.shape[0] * self.codes.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _near(x, self.coarse, 1)[:, 0]

    def encode(self, x: np.ndarray, cell: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) <r, x>^2, r being what is left of the residual."""
        subspaces, _, width = self.codes.shape
        target = self.pad(x - self.coarse[cell]).reshape(len(x), subspaces, width)
        along = self.pad(x).reshape(len(x), subspaces, width)
        miss = ((target[:, :, None, :] - self.codes[None]) ** 2).sum(3)  # rows x subspaces x 16
        slope = (target * along).sum(2)[:, :, None] - np.einsum("nsw,skw->nsk", along, self.codes)
        code = miss.argmin(2)
        held = np.take_along_axis(slope, code[:, :, None], 2)[:, :, 0]
        for _ in range(passes):
            for s in range(subspaces):
                rest = held.sum(1) - held[:, s]
                code[:, s] = (miss[:, s] + (self.eta - 1) * (slope[:, s] + rest[:, None]) ** 2).argmin(1)
                held[:, s] = np.take_along_axis(slope[:, s], code[:, s, None], 1)[:, 0]
        return code.astype(np.uint8)

    def pack(self, code: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte."""
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return code[:, ::2] | code[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte position, the inner products of all 256 byte values."""
        subspaces, _, width = self.codes.shape
        one = np.einsum("qsw,skw->qsk", self.pad(q).reshape(len(q), subspaces, width), self.codes)
        if subspaces % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)

    def scan(self, q: np.ndarray, cell: int, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x rows, by one look-up a byte."""
        table = self.tables(q)
        out = np.repeat((q @ self.coarse[cell])[:, None].astype(np.float32), len(packed), 1)
        for at in range(packed.shape[1]):
            out += table[:, at, :][:, packed[:, at]]
        return out


def fit(points: np.ndarray, lists: int, sample: int = 8192, width: int = 2, threshold: float = 0.2, target: float = 0.995, k: int = 5, seed: int = 7) -> Codebook:
    """Train on unit vectors: lists on all ``points``, codes on the first ``sample``; eta = (dims - 1) t^2 / (1 - t^2) for the score threshold t, at least 1."""
    rng = np.random.default_rng(seed)
    dims = points.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    subspaces = -(-dims // width)
    book, sample = Codebook(_kmeans(points, lists, rng), np.zeros((subspaces, LEVELS, width)), eta), points[:sample]
    left = book.pad(sample - book.coarse[book.cells(sample)]).reshape(len(sample), subspaces, width)
    along = book.pad(sample).reshape(len(sample), subspaces, width)
    for s in range(subspaces):
        r, a = left[:, s], along[:, s]
        weigh = np.eye(width) + (eta - 1) * a[:, :, None] * a[:, None, :]  # a row's quadratic form
        centres = r[rng.choice(len(r), LEVELS, replace=len(r) < LEVELS)].copy()
        for _ in range(8):
            gap = r[:, None, :] - centres[None]
            code = ((gap**2).sum(2) + (eta - 1) * np.einsum("nkw,nw->nk", gap, a) ** 2).argmin(1)
            for c in np.unique(code):
                mine = code == c
                centres[c] = np.linalg.solve(weigh[mine].sum(0) + 1e-9 * np.eye(width), np.einsum("nij,nj->i", weigh[mine], r[mine]))
        book.codes[s] = centres
    book.probes = _probes(book, sample, target, k, rng)
    return book


def _probes(book: Codebook, sample: np.ndarray, target: float, k: int, rng: np.random.Generator) -> int:
    """The fewest lists to visit so that the nearest k of sampled queries lie in them with share ``target``."""
    picks = rng.choice(len(sample), min(256, len(sample)), replace=False)
    score = sample[picks] @ sample.T
    score[np.arange(len(picks)), picks] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    order = _near(sample[picks], book.coarse, len(book.coarse))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    needed = np.sort(np.take_along_axis(place, book.cells(sample)[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))]) + 1 if len(needed) else 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` with double components: rows with an id and a vector that is not null, empty, zero or holding null or non-finite numbers."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    both = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return both.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, sample: int = 8192, list_rows: int = 1024, block_rows: int = 4096, block_queries: int = 256, rerank: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest ``k`` found for each query, by cosine, ties to the smaller id.

    ``base`` and ``queries`` have ``(vec_id, vec)``, as from ``usable``. A query's own id is no candidate. Vectors that haven't the dimension of most of ``base`` (of equally
    common ones, the smaller) take no part.
    Repeated rows count once, among queries too. An id with several vectors has one list, of the best scores of any of its vectors; as a hit it comes once, with its best score.
    Equal vectors: only the k + 1 smallest ids of a vector can be among any query's nearest k, so only those are indexed; that
    is exact, however often a vector occurs. A list is dealt into blocks of about ``block_rows`` rows and ``block_queries`` queries, so no task
    gets a whole hot list. With fewer than 64 vectors to fit on, or no base, all lists are visited. Empty inputs give an empty result.
    """
    spark = base.sparkSession
    first = Window.partitionBy("vec").orderBy("vec_id")
    copies = written(base.distinct().withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).select("vec_id", "vec"), "ann-rows")
    dims = copies.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    copies, rows = copies.where(F.size("vec") == dims[0]), dims[1]
    lists = max(1, min(4096, rows // list_rows))
    fitted = copies.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 16 * lists)).select("vec").toArrow()
    points = unit(_matrix(fitted.column(0)))
    lists = max(1, min(lists, len(points) // 16))
    book = fit(points, lists, sample, k=k)
    shared = spark.sparkContext.broadcast(book)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = unit(_matrix(batch.column(1)))
                cell = shared.value.cells(x)
                packed = shared.value.pack(shared.value.encode(x, cell))
                code = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), code], names=["vec_id", "vec", "cell", "code"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = _near(unit(_matrix(batch.column(1))), shared.value.coarse, min(shared.value.probes, len(shared.value.coarse)))
                rank = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, rank], names=["query_id", "q", "cells"])

    indexed = written(copies.mapInArrow(index, "vec_id long, vec array<double>, cell int, code binary"), "ann-index")
    asked = written(queries.where(F.size("vec") == dims[0]).distinct().select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")).mapInArrow(visit, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell")), "ann-asked")
    counts = {r[0]: [r[1], 0] for r in indexed.groupBy("cell").count().collect()}  # at most 4096 lists
    for r in asked.groupBy("cell").count().collect():
        counts.setdefault(r[0], [0, 0])[1] = r[1]
    grid = spark.createDataFrame([(c, max(1, -(-n // block_rows)), max(1, -(-m // block_queries))) for c, (n, m) in counts.items()], "cell int, down int, across int")
    down, across = F.sequence(F.lit(0), F.col("down") - 1), F.sequence(F.lit(0), F.col("across") - 1)
    left = indexed.join(F.broadcast(grid), "cell").withColumns({"row_block": F.pmod(F.xxhash64("vec_id"), "down").cast("int"), "query_block": F.explode(across)}).drop("down", "across")
    right = asked.join(F.broadcast(grid), "cell").withColumns({"query_block": F.pmod(F.xxhash64("query_id", F.lit(1)), "across").cast("int"), "row_block": F.explode(down)}).drop("down", "across")

    def block(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, found = [np.empty(0, np.int64)] * 2, [np.empty(0)]
        if len(rows) and len(asks):
            vec_id, query_id = rows["vec_id"].to_numpy(), asks["query_id"].to_numpy()
            x, q = _matrix(rows["vec"]), _matrix(asks["q"])
            packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
            rough = shared.value.scan(unit(q), rows["cell"][0].as_py(), packed)
            rough[query_id[:, None] == vec_id[None]] = -np.inf
            top = np.argpartition(-rough, min(rerank, len(vec_id)) - 1, axis=1)[:, :rerank]
            x, q = scaled(x), scaled(q)
            few, size = max(1, RERANK_BYTES // (8 * x.shape[1] * top.shape[1])), np.linalg.norm(x, axis=1)
            exact = np.concatenate([np.einsum("qd,qrd->qr", q[i : i + few], x[top[i : i + few]]) for i in range(0, len(q), few)])
            exact /= np.linalg.norm(q, axis=1)[:, None] * size[top]
            own = vec_id[top] == query_id[:, None]
            order = np.lexsort((vec_id[top], -np.where(own, -np.inf, exact)))
            if len(np.unique(vec_id)) < len(vec_id):  # ids with several vectors: all but their best go behind the others
                later = [~np.isin(np.arange(len(r)), np.unique(r, return_index=True)[1]) for r in np.take_along_axis(vec_id[top], order, 1)]
                order = np.take_along_axis(order, np.argsort(later, axis=1, kind="stable"), 1)
            order = order[:, :k]
            keep = ~np.take_along_axis(own, order, 1)
            ids = [np.repeat(query_id, order.shape[1]).reshape(order.shape)[keep], np.take_along_axis(vec_id[top], order, 1)[keep]]
            found = [np.take_along_axis(exact, order, 1)[keep]]
        return pa.table({"query_id": pa.array(ids[0], pa.int64()), "vec_id": pa.array(ids[1], pa.int64()), "score": pa.array(found[0], pa.float64())})

    keys = ["cell", "row_block", "query_block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
