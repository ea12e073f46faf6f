"""Exact and fuzzy deduplication, keyed snapshots and change sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from decimal import ROUND_CEILING, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalised, trigrams
from ..session import shared_folder, stored

#: Rows of a part of a block; larger blocks are dealt into parts.
BLOCK_ROWS = 2000


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order; null keys are equal to each other. Copies are cut before the shuffle (a group limit)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def keep_first_where_known(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """As ``keep_first``, but rows with a null in the key all stay."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return keep_first(df.where(known), key, order).unionByName(df.where(~known))


def price_block(price: Column, width: int = 15000) -> Column:
    """The floor of the price's bucket; -1 for null and non-positive prices."""
    return F.when(price.isNull() | (price <= 0), -1).otherwise(F.floor(price / width) * width).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b); 0.5 where one is missing."""
    return F.coalesce(1 - F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)).cast("double")), F.lit(0.5))


def alike(a: str, b: str) -> Column:
    """Weighted likeness of price, surface, title and city of two aliased rows."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    title = jaccard(trigrams(normalised(x("title"))), trigrams(normalised(y("title"))))
    city = F.when(x("city").isNull() | y("city").isNull(), 0.5).when(normalised(x("city")) == normalised(y("city")), 1.0).otherwise(0.0)
    return 0.30 * ratio(x("price"), y("price")) + 0.25 * ratio(x("surface"), y("surface")) + 0.25 * title + 0.20 * city


def met_in_blocks(df: DataFrame, block: Sequence[str], key: str, most: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``one`` and ``two`` (aliases) of each pair within a block, ``one`` with the smaller key: an equi-join on the block.

    A block of over ``most`` rows is dealt into parts, and each two parts meet under a key of their own, so that no task gets more than about twice ``most`` rows of it
    a side, however large it is. Every pair meets once.
    """
    large = df.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).where("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1))
    dealt = df.join(large, [*block], "left").withColumn("__own", F.pmod(F.xxhash64(key), parts).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")})
    met = F.lit(True)
    for c in (*block, "__i", "__j"):
        met = met & (F.col(f"one.{c}") == F.col(f"two.{c}"))
    once = (F.col("one.__i") == F.col("one.__j")) | (F.col("one.__own") != F.col("two.__own"))
    return dealt.alias("one").join(dealt.alias("two"), met & (F.col(f"one.{key}") < F.col(f"two.{key}")) & once)


def block_pairs(df: DataFrame, key: str = "id", width: int = 15000, most: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``one`` and ``two`` (aliases) of each pair within a block of price bucket and city."""
    blocked = df.withColumns({"block": price_block(F.col("price"), width), "place": F.substring(normalised(F.col("city")), 1, 20)})
    return met_in_blocks(blocked, ["block", "place"], key, most)


def _prepared(df: DataFrame, key: str, width: int) -> DataFrame:
    """What likeness needs of each row, made once a row: its block, price, surface, plain city and the trigrams of its title as whole numbers (a plain title is ASCII)."""
    letter = lambda g, i: F.ascii(F.substring(g, i, 1))
    grams = F.transform(trigrams(normalised(F.col("title"))), lambda g: letter(g, 1) * 16384 + letter(g, 2) * 128 + letter(g, 3))
    plain = normalised(F.col("city"))
    return df.select(key, "price", "surface", F.when(F.col("city").isNotNull(), plain).alias("city"), grams.alias("grams"), price_block(F.col("price"), width).alias("block"), F.substring(plain, 1, 20).alias("place"))


def fuzzy_pairs(df: DataFrame, key: str = "id", threshold: float = 0.85, width: int = 15000) -> DataFrame:
    """``(a, b, score)`` of pairs within a block whose likeness (that of ``alike``) reaches the threshold. Trigrams are made once a row, and met only where the rest leaves the threshold in reach."""
    met = met_in_blocks(_prepared(df, key, width), ["block", "place"], key)
    one, two = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"two.{c}"))
    both, sizes = F.size(F.array_intersect(one("grams"), two("grams"))), F.size(one("grams")) + F.size(two("grams"))
    title = F.when(sizes == 0, 1.0).otherwise(both / F.greatest(sizes - both, F.lit(1)))
    city = F.when(one("city").isNull() | two("city").isNull(), 0.5).when(one("city") == two("city"), 1.0).otherwise(0.0)
    score = lambda t: F.round(0.30 * ratio(one("price"), two("price")) + 0.25 * ratio(one("surface"), two("surface")) + 0.25 * t + 0.20 * city, 4)
    return met.where(score(F.lit(1.0)) >= threshold).select(one(key).alias("a"), two(key).alias("b"), score(title).alias("score")).where(F.col("score") >= threshold)


#: Connected groups of up to so many pairs are settled in one step by a task each.
GROUP_PAIRS = 50_000


def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows of one connected group that leave, in the order of keys."""
    earlier: dict = {}
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        earlier.setdefault(b, []).append(a)
    gone: set = set()
    place = dict(zip(pairs["b"].tolist(), pairs["place"].tolist()))
    for b in sorted(earlier, key=place.__getitem__):
        if any(a not in gone for a in earlier[b]):
            gone.add(b)
    return pd.DataFrame({"b": list(gone)}, dtype=pairs["b"].dtype)


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` of ``pairs(a, b)``: every node takes the least name among its neighbours and then that one's own, until none changes, so the number of rounds grows with the logarithm of the longest path in most graphs."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).checkpoint()
    for _ in range(rounds):
        named = label.select(F.col("a").alias("b"), F.col("m").alias("n"))
        near = both.join(named, "b").groupBy("a").agg(F.min("n").alias("n"))
        new = label.join(near, "a").select("a", F.least("m", "n").alias("m"))
        for _ in range(2):  # jumps along names
            new = new.join(new.select(F.col("a").alias("m"), F.col("m").alias("further")), "m").select("a", F.least("m", "further").alias("m"))
        new = new.checkpoint()
        moved = new.join(label.withColumnRenamed("m", "old"), "a").where("m <> old").limit(1).count()
        label = new
        if not moved:
            break
    return label.select(F.col("a").alias("node"), F.col("m").alias("root"))  # not settled: groups are smaller than components, and callers go by rounds for pairs across


def greedy_survivors(df: DataFrame, pairs: DataFrame, key: str, order: str | None = None, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """The keys of ``df`` that stay when rows are visited in order and each leaves if an earlier one that stays is its pair. ``pairs`` are ``(a, b)`` with a before b; ``order`` names a column of ``pairs`` with the place of b, which is b itself if none is given.

    Pairs are cut into connected groups, and every group of up to ``group_pairs`` pairs is settled by one task, however long its chains are. Larger ones go by rounds of joins: rows without an earlier pair stay for certain, so their pairs leave, and with those go the pairs that
    they make; each round ends in a checkpoint, the least row settles in each, so it ends.
    """
    shared_folder(df.sparkSession)
    edges, gone = pairs.select("a", "b", F.col(order or "b").alias("place")).distinct().checkpoint(), None
    total, kind = edges.count(), edges.schema["b"].dataType.simpleString()
    if 0 < total <= group_pairs:  # few enough for one task, connected or not
        gone = edges.groupBy(F.lit(0).alias("root")).applyInPandas(lambda p: _settled(p), f"b {kind}").checkpoint()
        return df.select(key).join(gone.select(F.col("b").alias(key)), key, "left_anti")
    if total:
        root = components(edges)
        grouped = edges.join(root.select(F.col("node").alias("b"), "root"), "b").join(root.select(F.col("node").alias("a"), F.col("root").alias("other")), "a")
        if grouped.where("root <> other").limit(1).count() == 0:
            sizes = grouped.groupBy("root").agg(F.count("*").alias("n"))
            small = grouped.join(sizes.where(F.col("n") <= group_pairs).select("root"), "root")
            gone = small.select("root", "a", "b", "place").groupBy("root").applyInPandas(lambda p: _settled(p), f"b {kind}").checkpoint()
            edges = grouped.join(sizes.where(F.col("n") > group_pairs).select("root"), "root").select("a", "b", "place").checkpoint()
    while edges.limit(1).count():
        sure = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        left = edges.join(sure, "a").select("b").distinct().checkpoint()
        gone = left if gone is None else gone.union(left)
        edges = edges.join(left, "b", "left_anti").join(left.select(F.col("b").alias("a")), "a", "left_anti").checkpoint()
    return df.select(key) if gone is None else df.select(key).join(gone.select(F.col("b").alias(key)), key, "left_anti")


#: Rows of a block that one task settles; larger blocks go by pairs.
SETTLED_ROWS = 20_000


def _block_survivors(rows: pd.DataFrame, key: str, least: float) -> pd.DataFrame:
    """The keys of a block's rows that stay: each row, in the order of keys, is only compared with those that stay so far."""
    rows = rows.sort_values(key, kind="stable")
    keys, price, surface = rows[key].tolist(), rows["price"].to_numpy(float), rows["surface"].to_numpy(float)
    city = pd.factorize(rows["city"])[0]  # -1 where it is null
    used, at = np.unique(np.concatenate([np.asarray(g, np.int64) for g in rows["grams"]]), return_inverse=True)
    size = np.array([len(g) for g in rows["grams"]])
    grams = np.full((len(rows), max(int(size.max()), 1)), len(used), np.int32)
    grams[np.arange(grams.shape[1]) < size[:, None]] = at
    stay, n, wanted = np.empty(len(rows), np.int64), 0, np.zeros(len(used) + 1, bool)

    def near(x: np.ndarray, i: int, s: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = 1 - np.abs(x[s] - x[i]) / np.maximum(np.abs(x[s]), np.abs(x[i]))
        return np.where(np.isnan(out), 0.5, out)

    for i in range(len(rows)):
        s = stay[:n]
        rest = 0.30 * near(price, i, s) + 0.25 * near(surface, i, s)
        place = 0.20 * np.where((city[s] < 0) | (city[i] < 0), 0.5, (city[s] == city[i]).astype(float))
        hit = np.flatnonzero(rest + 0.25 + place >= least - 1e-9)
        if len(hit):
            own = grams[i, : size[i]]
            wanted[own] = True
            both = wanted[grams[s[hit]]].sum(1)
            wanted[own] = False
            sizes = size[s[hit]] + size[i]
            title = np.where(sizes == 0, 1.0, both / np.maximum(sizes - both, 1))
            if (rest[hit] + 0.25 * title + place[hit] >= least).any():
                continue
        stay[n] = i
        n += 1
    return pd.DataFrame({key: [keys[i] for i in stay[:n]]}, dtype=rows[key].dtype)


def fuzzy_survivors(df: DataFrame, key: str, threshold: float = 0.85, width: int = 15000, most: int = SETTLED_ROWS) -> DataFrame:
    """``greedy_survivors`` of ``fuzzy_pairs`` in the order of ``key`` (not null), without making the pairs: a block of up to ``most`` rows is settled by one task, which compares each row with those that stay before it. Larger blocks, and those with numbers that are not finite, go by pairs."""
    shared_folder(df.sparkSession)
    ready = _prepared(df, key, width)
    odd = F.lit(False)
    for c in ("price", "surface"):
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    large = ready.groupBy("block", "place").agg(F.count("*").alias("rows"), F.max(odd).alias("odd")).where((F.col("rows") > most) | F.col("odd")).select("block", "place").checkpoint()
    edge = float(Decimal(repr(threshold)).quantize(Decimal("0.0001"), ROUND_CEILING) - Decimal("0.00005"))  # the least score that is rounded to the threshold
    kind = df.schema[key].dataType.simpleString()
    small = ready.join(large, ["block", "place"], "left_anti") if large.limit(1).count() else ready
    stay = small.groupBy("block", "place").applyInPandas(lambda rows: _block_survivors(rows, key, edge), f"`{key}` {kind}")
    if small is ready:
        return stay
    rest = df.withColumns({"block": price_block(F.col("price"), width), "place": F.substring(normalised(F.col("city")), 1, 20)}).join(large, ["block", "place"], "left_semi").drop("block", "place")
    return stay.union(greedy_survivors(rest, fuzzy_pairs(rest, key, threshold, width), key))


#: The same in DuckDB over ``p(a, b)``: ``gone.ids`` are the keys that leave.
GREEDY_SQL = (
    "n AS (SELECT b, list(a) AS near FROM p GROUP BY b), gone AS (SELECT coalesce(list_reduce(list({'b': b, 'near': near} ORDER BY b), "
    "lambda acc, x: CASE WHEN len(list_filter(x.near, lambda a: NOT list_contains(acc, a))) > 0 THEN list_append(acc, x.b) ELSE acc END, []::BIGINT[]), []) AS ids FROM n)"
)


#: Members are counted by bucket, and the driver and each worker hold all counts: 2 MB.
BUCKETS = 1 << 18


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)).astype(np.int64)


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many members of all sets ``w`` fall into each bucket."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = sets.select("w").mapInArrow(part, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


#: Bits of a set's parities.
PARITIES = 4096


def _near_parities(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that parities of their sets ``w`` don't rule out: members that only one of two sets has leave as many odd bits at most, and sets that are alike have few."""

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                x, size = part.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(part.column(1).offsets.to_numpy())
                bit = (x.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(52)).astype(np.int64)
                odd = np.bincount(np.repeat(np.arange(len(size)), size) * PARITIES + bit, minlength=len(size) * PARITIES).reshape(-1, PARITIES) & 1
                bits = np.packbits(odd.astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "n", "bits"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)
        for batch in batches:
            odd = np.bitwise_count(read(batch["bits_a"]) ^ read(batch["bits_b"])).sum(1, dtype=np.int64)
            size = batch["n_a"].to_numpy().astype(np.int64) + batch["n_b"].to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(odd * (100 + threshold) <= size * (100 - threshold)))

    kind = sets.schema["id"].dataType.simpleString()
    each = stored(sets.select("id", "w").mapInArrow(parities, f"id {kind}, n int, bits binary"), "parities")
    side = lambda c: each.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(near, f"a {kind}, b {kind}"), "near")


#: Sets of one side that a task compares whole.
COMPARED_SETS = 256


def _whole_alike(sets: DataFrame, pairs: DataFrame, threshold: int, most: int = COMPARED_SETS) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets ``w`` (sorted, of ``sets(id, w)``) have a Jaccard similarity of at least ``threshold`` percent.

    Pairs of one connected group are compared together, so that a set is sent once a task and not once a pair; a large group is dealt into parts of about ``most`` sets, of which each two meet in a task.
    """
    root = stored(components(pairs), "roots")
    parts = F.ceil(F.count("*") / most).cast("int").alias("parts")
    placed = pairs.join(root.select(F.col("node").alias("a"), "root"), "a").join(root.groupBy("root").agg(parts), "root")
    own = lambda c: F.pmod(F.xxhash64(c), "parts").cast("int")
    placed = stored(placed.select("root", F.least(own("a"), own("b")).alias("i"), F.greatest(own("a"), own("b")).alias("j"), "a", "b"), "placed")
    keys = ["root", "i", "j"]
    wanted = placed.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct()
    members = wanted.join(sets, "id").select(*(F.col(k).alias(f"of_{k}") for k in keys), "id", "w")

    def compare(two: pa.Table, one: pa.Table) -> pa.Table:
        w = dict(zip(one["id"].to_pylist(), (x.values.to_numpy() for x in one["w"])))
        a, b = two["a"].to_pylist(), two["b"].to_pylist()
        both = np.array([len(np.intersect1d(w[x], w[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
        size = np.array([len(w[x]) + len(w[y]) for x, y in zip(a, b)], np.int64)
        return two.select(["a", "b"]).filter(pa.array(both * 100 >= (size - both) * threshold))

    kind = pairs.schema["a"].dataType.simpleString()
    return placed.groupBy(*keys).cogroup(members.groupBy(*(f"of_{k}" for k in keys))).applyInArrow(compare, f"a {kind}, b {kind}")


def unlike_sets(df: DataFrame, threshold: int = 88, most: int = BLOCK_ROWS) -> DataFrame:
    """``(id,)``: of ``df(id, w)``, the rows that stay when, in the order of ids, each leaves whose non-empty set ``w`` of numbers has a Jaccard similarity of at least ``threshold`` percent with one that stays.

    Of equal sets only the first can stay, so only those are compared. Exact, without comparing all: sets are ordered by how rare their members' buckets are in the whole table, and two sets that are so alike share one of the first
    n - ceil(threshold n) + 1 members of each. Pairs come from an equi-join on those with parities of the whole sets, and are then compared whole. Only these first members are shuffled, and sets once.
    """
    sets = stored(df.where(F.size("w") > 0).select("id", F.array_sort(F.array_distinct("w")).alias("w")), "sets")
    first = stored(sets.groupBy(F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g")).agg(F.min("id").alias("id")).select("id"), "first")
    shared = df.sparkSession.sparkContext.broadcast(_bucket_counts(sets))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x, size = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(1).offsets.to_numpy())
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            bit = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            low, high = (np.bitwise_xor.reduceat(np.where(bit < 64 if k else bit >= 64, one, np.uint64(0)), start).view(np.int64) for k in (True, False))
            order = np.lexsort((x, count[_bucket(x)], row))
            kept = order[np.arange(len(x)) - start[row] < (size - (threshold * size + 99) // 100 + 1)[row]]
            of = row[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(size[of].astype(np.int32)), pa.array(x[kept]), pa.array(low[of]), pa.array(high[of])], names=["id", "n", "x", "low", "high"])

    kind = df.schema["id"].dataType.simpleString()
    head = sets.mapInArrow(heads, f"id {kind}, n int, x long, low long, high long").join(first, "id", "left_semi")
    met = met_in_blocks(head, ["x"], "id", most).where(F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * threshold)
    # members that only one set has are at most (100 - threshold) of (100 + threshold) parts, and their parities tell some of them
    odd = sum(F.bit_count(F.col(f"one.{c}").bitwiseXOR(F.col(f"two.{c}"))) for c in ("low", "high"))
    met = stored(met.where(odd * (100 + threshold) <= (F.col("one.n") + F.col("two.n")) * (100 - threshold)).select(F.col("one.id").alias("a"), F.col("two.id").alias("b")).distinct(), "met")
    pairs = _whole_alike(sets, _near_parities(sets, met, threshold), threshold)
    return greedy_survivors(first, pairs, "id").union(df.where(F.size("w") == 0).select("id"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, values: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """``(key, action, old values, new values)``: insert, update (the content's hash differs), skip, or keep (not in the new rows). One full outer join.

    Columns ``also`` are carried along but don't count as content.
    """
    digest = lambda p: F.substring(F.sha2(F.concat_ws("|", *(F.col(f"{p}.{v}").cast("string") for v in values)), 256), 1, 16)
    c, i = current.alias("c"), incoming.alias("i")
    action = F.when(F.col(f"c.{key}").isNull(), "insert").when(F.col(f"i.{key}").isNull(), "keep").when(digest("c") != digest("i"), "update").otherwise("skip")
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    return both.select(F.coalesce(f"c.{key}", f"i.{key}").alias(key), action.alias("action"), *(F.col(f"c.{v}").alias(f"old_{v}") for v in (*values, *also)), *(F.col(f"i.{v}").alias(f"new_{v}") for v in (*values, *also)))


def changes(current: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, change, delta)``: added, removed, or changed with the value's difference."""
    c, b = current.alias("c"), before.alias("b")
    both = c.join(b, F.col(f"c.{key}") == F.col(f"b.{key}"), "full_outer")
    kind = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"c.{key}").isNull(), "removed").when(F.col(f"c.{value}") != F.col(f"b.{value}"), "changed")
    return both.select(F.coalesce(f"c.{key}", f"b.{key}").alias(key), kind.alias("change"), (F.col(f"c.{value}") - F.col(f"b.{value}")).alias("delta")).where("change is not null")
