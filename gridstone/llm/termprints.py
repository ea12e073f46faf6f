"""Document fingerprints by weighted SimHash, in DataFrame operations only.

Each word of the whole text votes, with a weight by its length, on 128 signed bits given by its hashes. Votes are counted two
bits to a 64-bit sum (a lane of 32 bits each), so a text needs 64 sums in one hash aggregation.
``within_radius`` finds the fingerprints within a Hamming radius of each other by permuted block tables, and ``near_classes`` the classes that these links make.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_index, written
from .components import connected_components

HALVES = 2
#: The longest word length that still adds weight.
LONGEST = 16
#: About so many bytes of text make a bucket of neighbouring documents, or more where that would be over MOST_BUCKETS buckets: a larger bucket is sorted on disk, and none is held in memory.
BUCKET_BYTES, MOST_BUCKETS = 512 << 10, 1 << 16
#: Keys drawn for each bucket, on average, by size.
DRAWN = 32
#: Fingerprints in a block table's bucket up to which pairs are compared (a second's work); beyond it, hubs.
PAIR_BUCKET = 20_000


def _weight(term: Column) -> Column:
    """Short words (mostly function words) count little: length - 2, at least 1, at most LONGEST - 2. No word: 0."""
    return F.when(term.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.length(term), F.lit(LONGEST)) - 2)).cast("long")


def _votes(term: Column, weight: Column) -> list[Column]:
    lanes = F.lit((1 << 32) | 1)
    hashes = [F.xxhash64(term), F.xxhash64(F.lit(7), term)]
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(lanes) * weight).alias(f"s{k}_{i}") for k, h in enumerate(hashes) for i in range(32)]
    return [F.sum(weight).alias("weight"), *sums]


def _half(k: int) -> Column:
    """64 bits from the sums: a bit is 1 where its votes are over half the weight. No terms: 0."""
    low, out = F.lit((1 << 32) - 1), F.lit(0).cast("long")
    for i in range(32):
        s = F.col(f"s{k}_{i}")
        for lane, votes in ((0, s.bitwiseAND(low)), (32, F.shiftrightunsigned(s, 32))):
            out = out.bitwiseOR(F.when(2 * votes > F.col("weight"), F.lit(_signed(1 << (i + lane)))).otherwise(F.lit(0).cast("long")))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))
    return 1 - differ / F.lit(64.0 * HALVES)


def terms(text: Column) -> Column:
    """The words between white space of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(*keys, fp0, fp1)``: the two halves of each text's fingerprint. ``keys`` name a row; rows of equal keys would be merged.

    Null or empty texts have fingerprint 0. If ``rows`` are already dealt out by some of the keys, nothing is shuffled.
    """
    words = rows.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    votes = words.groupBy(*keys).agg(*_votes(F.col("term"), _weight(F.col("term"))))
    return votes.select(*keys, _half(0).alias("fp0"), _half(1).alias("fp1"))


def hex_of(*halves: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves))


def _cuts(source: DataFrame, bucket_bytes: int) -> list[tuple[int, int, int]]:
    """Keys that cut ``source`` into ranges of about ``bucket_bytes``, from a sample by size of at most DRAWN x MOST_BUCKETS keys (so one task may sort it)."""
    size = F.octet_length("t") + 1
    total, count = source.agg(F.sum(size), F.count("*")).first()
    buckets = min(MOST_BUCKETS, int((total or 0) // bucket_bytes) + 1, count)
    if buckets < 2:
        return []
    u = F.pmod(F.xxhash64("last", "id", "tie", F.lit(5)), F.lit(1 << 52)) / float(1 << 52)
    drawn = source.where(u * float(total) < size * float(buckets * DRAWN)).select("last", "id", "tie")
    rank = F.row_number().over(Window.orderBy("last", "id", "tie"))
    return sorted({tuple(r) for r in drawn.withColumn("rank", rank).where(F.col("rank") % DRAWN == 0).select("last", "id", "tie").collect()})


def edited_likeness(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fp0, fp1, fingerprint, edited_fingerprint, near_edited, near_next)``: fingerprints of each whole text, of its edited text, and their likeness (1 - differing bits / 128).

    Edited: the last floor(n / 2) code points are replaced by the first as many (or all) of the next document's, in ascending id (after
    the last, the first). Rows with equal ids follow the hash of their texts; null ids come last. A null text is empty. A lone document is its own next.
    Documents are dealt once, into ranges of neighbouring (id, hash); each range gets a copy of the next range's first document, so no other exchange
    and no global order is needed. Rows that repeat both id and text share a range.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    source = source.withColumns({"last": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "tie": F.xxhash64("t")})
    at = range_index(F.struct("last", "id", "tie"), _cuts(source, bucket_bytes), "last int, id bigint, tie bigint")
    dealt = source.withColumn("bucket", at)
    least = dealt.groupBy("bucket").agg(F.min(F.struct("last", "id", "tie")).alias("k")).select(F.col("bucket").alias("of"), "k")  # at most MOST_BUCKETS rows, of four numbers
    starts = dealt.join(F.broadcast(least), (F.col("bucket") == F.col("of")) & (F.struct("last", "id", "tie") == F.col("k")))
    head = starts.groupBy("bucket").agg(F.first(F.struct("doc_id", "last", "id", "tie", "t")).alias("head"))  # rows of one key are alike
    # each bucket's first document also ends the bucket before it, and the first of all the last; at most MOST_BUCKETS rows
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.last("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = head.select(before.alias("bucket"), "head.*", F.lit(True).alias("end"))
    rows = dealt.withColumn("end", F.lit(False)).unionByName(ends)
    order = Window.partitionBy("bucket").orderBy("end", "last", "id", "tie")
    near = rows.withColumns({"n": F.row_number().over(order), "next": F.lead("t").over(order), "n_chars": F.length("t").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half))
    both = near.withColumn("edited", edited).select(
        "bucket", "n", "end", "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("t").alias("text")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text")))).alias("x"),
    )
    keys = ["bucket", "n", "end", "doc_id", "n_chars", "sha"]
    marks = fingerprints(both.select(*keys, "x.form", "x.text"), [*keys, "form"])
    form = lambda k, h: F.max(F.when(F.col("form") == k, F.col(h)))
    each = marks.groupBy(*keys).agg(form(0, "fp0").alias("a0"), form(0, "fp1").alias("a1"), form(1, "fp0").alias("e0"), form(1, "fp1").alias("e1"))
    follow = Window.partitionBy("bucket").orderBy("n")
    out = each.withColumns({"b0": F.lead("a0").over(follow), "b1": F.lead("a1").over(follow)}).where(~F.col("end"))
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("a0").alias("fp0"), F.col("a1").alias("fp1"), hex_of("a0", "a1").alias("fingerprint"), hex_of("e0", "e1").alias("edited_fingerprint"),
        _likeness(("a0", "a1"), ("e0", "e1")).alias("near_edited"), _likeness(("a0", "a1"), ("b0", "b1")).alias("near_next"),
    )


def block_tables(radius: int, blocks: int) -> list[int]:
    """The masks of the permuted block tables over all bits: each keeps ``blocks - radius`` of ``blocks`` equal blocks."""
    bits = 64 * HALVES
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(parts[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _kept(mask: int, a: str = "fp0", b: str = "fp1") -> list[Column]:
    return [F.col(x).bitwiseAND(F.lit(_signed(mask >> s & (1 << 64) - 1))) for x, s in ((a, 0), (b, 64))]


def _moved(rows: DataFrame, free: list[list[int]], least: int, most: int) -> DataFrame:
    """``rows`` once for each setting of ``least`` to ``most`` of the bits that the table ``t`` leaves free, with the fingerprint so changed (``h0``, ``h1``)."""
    flip = lambda s: F.when(F.col("bit").between(s, s + 63), F.expr(f"shiftleft(1L, bit - {s})")).otherwise(F.lit(0).cast("long"))
    bits = F.element_at(F.expr(f"array({','.join('array(' + ','.join(map(str, f)) + ')' for f in free)})"), F.col("t") + 1)
    step, out = rows.withColumns({"h0": F.col("fp0"), "h1": F.col("fp1"), "bit": F.lit(-1)}), None
    for k in range(most + 1):
        if k:
            more = step.withColumn("bit", F.explode(F.filter(bits, lambda x: x > F.col("bit"))))
            step = more.withColumns({"h0": F.col("h0").bitwiseXOR(flip(0)), "h1": F.col("h1").bitwiseXOR(flip(64))})
        if k >= least:
            out = step if out is None else out.unionByName(step)
    return out.drop("bit") if out is not None else rows.limit(0).withColumns({"h0": F.col("fp0"), "h1": F.col("fp1")})


def within_radius(marks: DataFrame, radius: int = 3, blocks: int | None = None, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``(a, b)``: nodes of ``marks(node, fp0, fp1)``, one for each distinct 128-bit fingerprint, that differ in at most ``radius`` bits.

    Permuted block tables: the bits are cut into ``blocks`` blocks (radius + 2 by default). Of any pair within the radius, at least blocks - radius blocks are equal, so each
    choice of so many blocks is a table, keyed by those blocks' bits (as if permuted to the front). Buckets of up to ``pair_bucket`` fingerprints give each of their pairs once,
    in the first table in which it meets. Larger ones give stars instead of all pairs, so that rows grow with their members: each value within radius // 2 bits of a member is a hub, and
    who is within the rest of the radius of it is linked to its first near member. Any two of a bucket within the radius share such a hub,
    and all links are true, so what is connected is the same, and no link between classes is lost.
    """
    blocks = blocks or radius + 2
    tables = block_tables(radius, blocks)
    keys = F.array(*(F.xxhash64(F.lit(t), *_kept(m)) for t, m in enumerate(tables)))
    rows = marks.select("node", "fp0", "fp1", F.posexplode(keys).alias("t", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, "key"), "term-buckets")
    light, heavy = shared.where(F.col("n") <= pair_bucket), shared.where(F.col("n") > pair_bucket)
    side = lambda n, x, y: light.select("t", "key", F.col("node").alias(n), F.col("fp0").alias(x), F.col("fp1").alias(y))
    differ = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    equal = lambda m: (_kept(m, "a0", "a1")[0] == _kept(m, "b0", "b1")[0]) & (_kept(m, "a0", "a1")[1] == _kept(m, "b0", "b1")[1])
    first = F.array_position(F.array(*map(equal, tables)), True) - 1
    pairs = side("a", "a0", "a1").join(side("b", "b0", "b1"), ["t", "key"]).where((F.col("a") < F.col("b")) & (differ <= radius)).where(first == F.col("t")).select("a", "b")
    if not heavy.limit(1).count():
        return pairs
    near, free = radius // 2, [[i for i in range(64 * HALVES) if not m >> i & 1] for m in tables]
    close, far = _moved(heavy, free, 0, near), _moved(heavy, free, near + 1, radius - near)
    leads = close.groupBy("t", "key", "h0", "h1").agg(F.min("node").alias("lead"))
    return pairs.union(close.unionByName(far).join(leads, ["t", "key", "h0", "h1"]).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))


def near_classes(marks: DataFrame, radius: int = 3, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``(fp0, fp1, near_class)`` of each distinct fingerprint of ``marks(doc_id, fp0, fp1)``: the least ``doc_id`` that links of at most ``radius`` differing bits reach, its own included.

    Equal fingerprints are one, so copies cost nothing here. Null ids name a class only if it has no other.
    """
    distinct = written(marks.groupBy("fp0", "fp1").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "term-nodes")
    roots = connected_components(within_radius(distinct, radius, pair_bucket=pair_bucket))
    classes = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("near_class"))
    return classes.join(named, "root").select("fp0", "fp1", "near_class")


def compared(docs: DataFrame, radius: int = 3, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_likeness`` of every document, and its ``near_class`` among all documents' fingerprints."""
    marks = written(edited_likeness(docs, bucket_bytes, id_col, text_col), "term-marks")
    return marks.join(near_classes(marks, radius), ["fp0", "fp1"]).drop("fp0", "fp1")
