"""Shards by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, id), so equal texts lie together. A size-weighted sample of these keys gives quantile boundaries,
which deal the records into ranges; ranges that turn out overfull are subdivided by further samples inside them until none is. Exact sums of
the ranges and running sums within them then place every record, so shards are as even as single records allow. Samples
and boundaries stay tables: a record finds its range through the boundaries that share the first 16 bits of its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes that a record has besides its text.
OVERHEAD = 16
#: Keys drawn for each range, on average; ranges for each shard; rows that a range should hold at most.
DRAWN, RANGES, RANGE_ROWS = 32, 4, 1_000_000
#: A range of over so many times the mean, besides its largest record, is subdivided.
OVERFULL = 2.0
#: Leading bits of a hash; a table with a row for each of their values is the largest that is broadcast, besides the boundaries.
CELL_BITS = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, h, copy, cell)``, written once: copy tells repeated rows of one id and text apart, cell is the start of the hash h."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("copy"),
    )
    return written(rows.withColumn("cell", F.shiftright("h", 64 - CELL_BITS).cast("int")), "shard-records")


def _key() -> Column:
    return F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "copy")


def _drawn(rows: DataFrame, total: int, wanted: int, salt: int) -> DataFrame:
    """Keys drawn with a chance by size, by a hash and not by a random state: about ``wanted`` of them."""
    u = F.pmod(F.xxhash64("h", "doc_id", "copy", F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    return rows.where(u * float(total) < F.col("size") * float(wanted))


def _earlier(counts: DataFrame, by: str, n: str) -> Column:
    """The sum of ``n`` over the rows of smaller ``by``, of a table with one row for each ``by``: a cell or a range."""
    return F.coalesce(F.sum(n).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _quantiles(drawn: DataFrame) -> DataFrame:
    """Every DRAWN-th of the sorted keys: ranks within a cell, after the number of keys in the cells before."""
    per = drawn.groupBy("cell").agg(F.count("*").alias("n"))
    before = per.select("cell", _earlier(per, "cell", "n").alias("before"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("k")) - 1 + F.col("before")
    return drawn.join(F.broadcast(before), "cell").withColumn("rank", rank).where((F.col("rank") > 0) & (F.col("rank") % DRAWN == 0)).select("cell", "k")


def dealt(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with ``range``: how many of the boundaries ``(cell, k)`` are at most a record's key. A binary search among those of its cell."""
    none = F.array().cast(f"array<{bounds.schema['k'].dataType.simpleString()}>")
    cells = rows.sparkSession.range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1).select(F.col("id").cast("int").alias("cell"))
    keys = bounds.groupBy("cell").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    table = cells.join(keys, "cell", "left").select("cell", F.coalesce("ks", none).alias("ks")).withColumn("inside", F.size("ks"))
    table = table.select("cell", "ks", _earlier(table, "cell", "inside").alias("before"))
    steps = F.when(F.size("ks") > 0, F.transform(F.sequence(F.floor(F.log2(F.size("ks"))).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int"))).otherwise(F.array().cast("array<int>"))
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("ks")) & (F.try_element_at("ks", at + step) <= _key()), at + step).otherwise(at))
    return rows.join(F.broadcast(table), "cell").withColumn("range", F.col("before") + upto).drop("ks", "before")


def split(rows: DataFrame, ranges: int, overfull: float = OVERFULL) -> DataFrame:
    """``rows`` with ``range``: which range of sampled quantile boundaries a record falls in. No range has over ``overfull`` times the mean bytes, its largest record left out, or times the mean rows."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.withColumn("range", F.lit(0).cast("long"))
    bounds, had, salt = written(_quantiles(written(_drawn(rows, total, ranges * DRAWN, 0).select("cell", _key().alias("k")), "shard-sample")), "shard-bounds"), -1, 0
    while True:
        now = dealt(rows, bounds)
        per = now.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("n"))
        times = F.greatest((F.col("bytes") - F.col("largest")) * (ranges / total), F.col("n") * (ranges / count))
        over = written(per.select("range", times.alias("times")).where(F.col("times") > overfull), "shard-overfull")
        have = bounds.count()
        if not over.limit(1).count() or have == had:
            return now
        had, salt = have, salt + 1
        even = now.join(F.broadcast(over), "range").withColumn("size", F.greatest(F.col("size"), F.lit(total // count)))  # many small records fill a range as well
        mine = Window.partitionBy("range")
        more = _drawn(even, total, ranges * DRAWN, salt).select("range", "cell", "times", _key().alias("k"))
        more = more.withColumns({"rank": F.row_number().over(mine.orderBy("k")) - 1, "m": F.count("*").over(mine), "pieces": F.floor("times") + 1})
        piece = lambda rank: F.floor(rank * F.col("pieces") / F.col("m"))
        cuts = more.where((F.col("rank") > 0) & (piece(F.col("rank")) > piece(F.col("rank") - 1))).select("cell", "k")
        bounds = written(bounds.union(cuts).distinct(), "shard-bounds")


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes", whole: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``: every record's shard, and its place there from 0 without gaps.

    ``law``: ``bytes`` (shards hold nearly equal bytes) or ``rows`` (counts at most one apart). Under ``bytes``, ``whole`` is how far, as a share of a shard, evenness may be given up to keep
    equal texts together: a group that takes no more is never parted, a larger one is cut where a shard is full.
    A null text has no bytes of its own; null ids and repeated rows are records like any other. ``grown_shard`` is null: a range law moves rows when shards are
    added. Fewer records than shards leave shards empty; an empty table gives an empty result.
    """
    rows = records(docs, id_col, text_col)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total, count = total or 0, count or 0
    ranges = max(1, min(count, max(RANGES * shards, -(-count // RANGE_ROWS))))
    order = Window.partitionBy("range").orderBy("h", F.col("doc_id").asc_nulls_first(), "copy")
    sums = written(split(rows, ranges).withColumns({"below": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "at": F.row_number().over(order) - 1}), "shard-ranges")
    per = sums.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = per.select("range", _earlier(per, "range", "bytes").alias("bytes0"), _earlier(per, "range", "n").alias("n0"))  # one row a range
    placed = sums.join(F.broadcast(offsets), "range").withColumns({"below": F.col("below") + F.col("bytes0"), "at": F.col("at") + F.col("n0")})
    if law == "bytes":
        # a group's part in each range first, so that a hot text never meets in one task
        parts = placed.groupBy("range", "h").agg(F.sum("size").alias("bytes"), F.min("below").alias("low"), F.count("*").alias("n"))
        group = Window.partitionBy("h")
        parts = parts.withColumns({"bytes": F.sum("bytes").over(group), "start": F.min("low").over(group), "n": F.sum("n").over(group)})
        small = parts.where((F.col("n") > 1) & (F.col("bytes") <= whole * total / shards)).select("range", "h", "bytes", "start")
        placed = placed.join(small, ["range", "h"], "left")
        middle = F.coalesce(F.col("start") + F.col("bytes") / 2, F.col("below") + F.col("size") / 2)
        number = F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(total, 1))))
    elif law == "rows":
        number = F.floor(F.col("at") * shards / max(count, 1))
    else:
        raise ValueError(f"no such law: {law}")
    placed = written(placed.select("doc_id", "size", "text_crc32", "at", number.cast("int").alias("shard")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
