"""Hard-negative mining by blocked dense products.

Anchors and rows are dealt into blocks of bounded bytes, and each pair of blocks meets once in a task that multiplies the two matrices in
double precision. Components are integers, so products are exact while no partial sum reaches 2^53, which the blocks' longest vectors tell beforehand; blocks
beyond that are multiplied in whole numbers of any size. A first pass gives each block's best positives of every anchor, which merge by taking the best
of the best. With these a second pass knows every positive's window, and keeps each block's best negatives in it, which merge likewise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a block's vectors as doubles, and of the products that a task holds at a time.
BLOCK_BYTES = 4 << 20
STRIP_BYTES = 32 << 20
EXACT = 2.0**53
ANCHOR = ["anchor_id", "anchor_key"]


def whole_numbers(rows: DataFrame, scale: float = 256.0, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, vec)``: vectors with components ``floor(scale * x)``, of the rows that take part.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; nor do those whose integer vector has a squared length of
    2^63 or more, as their scores are no 64-bit numbers.
    """
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where((F.size("vec") > 0) & finite)
    short = F.forall("vec", lambda x: F.abs(x * scale) < 2.0**32)
    some = some.where(short).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    return some.where(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) < 2.0**63)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of integers, as 64-bit integers."""
    if np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0) * (1 + 1e-9) < EXACT:
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)).astype(np.int64)


def _met(rows: DataFrame, anchors: DataFrame, answer: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows_a_block: int, anchors_a_block: int, counts: tuple[int, int]) -> DataFrame:
    """Every block of rows with every block of anchors, in a task each."""
    across, down = max(1, -(-counts[0] // rows_a_block)), max(1, -(-counts[1] // anchors_a_block))
    row_block, anchor_block = F.pmod(F.xxhash64("vec_id"), F.lit(across)), F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(down))
    left = rows.withColumns({"row_block": row_block, "anchor_block": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    right = anchors.withColumns({"anchor_block": anchor_block, "row_block": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    left, right = (x.withColumns({"row_block": F.col("row_block").cast("int"), "anchor_block": F.col("anchor_block").cast("int")}) for x in (left, right))
    keys = ["row_block", "anchor_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, schema)


def _strips(rows: pa.Table, anchors: pa.Table, dims: int):
    """The block's rows by ascending id, each once, with products for strips of anchors: ``(from, to, scores)``."""
    x, y = _matrix(rows["vec"]), _matrix(anchors["vec"])
    step = max(1, STRIP_BYTES // (8 * max(1, len(x))))
    for at in range(0, len(y), step):
        yield at, min(len(y), at + step), products(y[at : at + step], x)


def _distinct(rows: pa.Table) -> pa.Table:
    """Rows by ascending id; repeated rows, which always meet in a block, count once."""
    rows = rows.sort_by("vec_id")
    ids = rows["vec_id"].to_numpy()
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        place = lambda x: np.unique(x, return_inverse=True)[1].astype(float)  # noqa: E731  (ids may have more digits than a double)
        key = np.column_stack((place(ids), place(rows["label"].to_numpy()), _matrix(rows["vec"])))
        rows = rows.take(np.sort(np.unique(key, axis=0, return_index=True)[1]))
    return rows


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``rows`` as ``whole_numbers`` gives them, of which ``anchors`` holds for the anchors.

    A score is the integer inner product; higher ones come first, ties by the smaller id. An anchor's positives are its first ``positives`` other rows of its label, and for each
    of them the first ``negatives`` rows of other labels are returned for which ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows of another id are other rows. Repeated rows count once. Rows of one id that differ in label or vector are rows of their own, as anchors too (their results all bear that id).
    Vectors that haven't the dimension of most rows (of equally common ones, the smaller) take no part. An empty table, or one without anchors, gives an empty result.

    A block's vectors take at most ``block_bytes`` as doubles (one vector at least), so a task's memory is bounded whatever labels or vectors recur. Rows are shuffled once for each
    block of anchors and anchors once for each block of rows; a block leaves at most ``positives`` rows an anchor in the first pass and ``negatives`` rows a positive in the second.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(rows.select("vec_id", "label", "vec"), "negatives-rows")
    dims = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"), F.count_if(anchors).alias("m")).orderBy(F.desc("n"), "dims").first()
    if dims is None or not dims["m"]:
        return spark.createDataFrame([], schema)
    rows, counts, wide = rows.where(F.size("vec") == dims["dims"]), (dims["n"], dims["m"]), dims["dims"]
    a_block = max(1, block_bytes // (8 * wide))  # rows, and half as many anchors
    mined = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vec").alias("anchor_key"), "label", "vec").distinct()
    first = "anchor_id long, anchor_key long, positive_id long, positive_score long"
    second = "anchor_id long, anchor_key long, place int, positive_id long, positive_score long, negative_id long, negative_score long"

    def positive(found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(found) and len(asked):
            found = _distinct(found)
            ids, labels, own, own_label, key = (t[c].to_numpy() for t, c in ((found, "vec_id"), (found, "label"), (asked, "anchor_id"), (asked, "label"), (asked, "anchor_key")))
            for a, b, score in _strips(found, asked, wide):
                for i in range(a, b):
                    which = np.flatnonzero((labels == own_label[i]) & (ids != own[i]))
                    s = score[i - a, which]
                    if len(s) > positives:  # ties at the last place stay for the order below
                        near = s >= np.partition(s, len(s) - positives)[len(s) - positives]
                        which, s = which[near], s[near]
                    best = np.argsort(-s, kind="stable")[:positives]
                    out.append((np.full(len(best), own[i]), np.full(len(best), key[i]), ids[which[best]], s[best]))
        return _table(out, first)

    def negative(found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(found) and len(asked):
            found = _distinct(found)
            ids, labels, own, own_label, key = (t[c].to_numpy() for t, c in ((found, "vec_id"), (found, "label"), (asked, "anchor_id"), (asked, "label"), (asked, "anchor_key")))
            best = asked["best"].to_pylist()
            for a, b, score in _strips(found, asked, wide):
                for i in range(a, b):
                    # whole bounds: 100 s <= high p is s <= floor(high p / 100)
                    windows = [(p, -(-low * p["score"] // 100), high * p["score"] // 100) for p in best[i]]
                    windows = [w for w in windows if w[1] <= w[2]]
                    if not windows:
                        continue
                    s = score[i - a]
                    which = np.flatnonzero((s >= min(w[1] for w in windows)) & (s <= max(w[2] for w in windows)) & (labels != own_label[i]) & (ids != own[i]))
                    which = which[np.argsort(-s[which], kind="stable")]
                    down = -s[which]
                    for p, least, most in windows:
                        at = np.searchsorted(down, -most)
                        hits = which[at : min(at + negatives, np.searchsorted(down, -least, "right"))]
                        out.append((*(np.full(len(hits), x) for x in (own[i], key[i], p["place"], p["id"], p["score"])), ids[hits], s[hits]))
        return _table(out, second)

    order = Window.partitionBy(*ANCHOR).orderBy(F.desc("positive_score"), "positive_id")
    few = _met(rows, mined, positive, first, a_block, -(-a_block // 2), counts).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    few = few.groupBy(*ANCHOR).agg(F.collect_list(F.struct(F.col("place"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("best"))
    known = written(mined.join(few, ANCHOR), "negatives-positives")
    order = Window.partitionBy(*ANCHOR, "place").orderBy(F.desc("negative_score"), "negative_id")
    many = _met(rows, known, negative, second, a_block, -(-a_block // 2), counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return many.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _table(parts: list[tuple[np.ndarray, ...]], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    kind = {"long": pa.int64(), "int": pa.int32()}
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(fields)
    return pa.table({name: pa.array(c.astype(np.int64)).cast(kind[t]) for (name, t), c in zip(fields, columns)})
