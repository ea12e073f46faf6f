"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has bit i set where more than half of its shingles' hashes have it set. Two
fingerprints are linked if at most ``radius`` bits differ. Candidates come from a *covering* family of masks:
every bit position gets a non-zero vector of radius + 1 bits, and each non-zero vector v of that length is a table that
keeps the positions whose vector has an odd product with v. Any set of ``radius`` positions spans too few
dimensions to leave no v orthogonal to all of them, so every linked pair agrees on all kept bits of some
table: no linked pair is missed. Distinct fingerprints only enter the tables, and each candidate is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

BITS = 64
#: Fingerprints in a bucket up to which pairs are compared; beyond it, hubs are cheaper (about 500 rows a fingerprint at radius 3).
PAIR_BUCKET = 512


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of the covering family over 64 bits."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included: ASCII lower case, words between ASCII white space, one space between.

    Fewer words than a shingle takes: the whole sequence is the one shingle; no words: no hashes.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    k = min(words, n)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit majority of the hashes as an unsigned number; 0 for none. Counts run in blocks, so long texts need little memory."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0: the hashes; further lanes: other 64-bit hashes made from them by the SplitMix64 finaliser (its constants are fixed values)."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, fp1, ...)``: the signed 64-bit fingerprint (and further lanes) of every whole text.

    Only the two named columns are read, so further columns never clash. A null or empty text has fingerprint 0.
    """
    names = ["fp", *(f"fp{i}" for i in range(1, lanes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in names]
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), words, seed)
                for lane, out in enumerate(found):
                    out.append(_signed(fingerprint(mixed(hashes, lane))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", *names])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def links(distinct: DataFrame, radius: int = 3, fp: str = "fp", pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all pairs with at most ``radius`` differing bits.

    Buckets of up to ``pair_bucket`` fingerprints give their linked pairs. Larger ones (copies with many small edits) give a
    star for each hub: a value of the bucket within radius // 2 bits of one member and within the rest of the
    radius of others. All who share such a hub with a near member are truly linked to it, and every linked
    pair has one, so components are exact while rows grow with the members, not with their pairs.
    """
    masks = covering_masks(radius)
    rows = distinct.select(F.col(fp).alias("x"), F.posexplode(_keys(fp, masks)).alias("t", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, "key"), "simhash-buckets")
    light, heavy = shared.where(F.col("n") <= pair_bucket), shared.where(F.col("n") > pair_bucket)
    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    pairs = light.select("key", F.col("x").alias("a")).join(light.select("key", F.col("x").alias("b")), "key").where((F.col("a") < F.col("b")) & (differ("a", "b") <= radius)).select("a", "b")

    if not heavy.limit(1).count():
        return pairs
    near = radius // 2
    by_table = lambda least, most: F.element_at(F.expr(f"array({','.join(_array(_flips(m, least, most)) for m in masks)})"), F.col("t") + 1)
    hub = F.col("x").bitwiseXOR(F.col("flip")).alias("hub")
    close = heavy.select("x", "key", F.explode(by_table(0, near)).alias("flip")).select("x", "key", hub)
    far = heavy.select("x", "key", F.explode(by_table(near + 1, radius - near)).alias("flip")).select("x", "key", hub)
    leads = close.groupBy("key", "hub").agg(F.min("x").alias("lead"))
    stars = close.union(far).join(leads, ["key", "hub"]).where("x <> lead").select(F.col("x").alias("a"), F.col("lead").alias("b"))
    return pairs.union(stars)


def _keys(fp: str, masks: list[int], first: int = 0) -> Column:
    """A table's key for each mask, as one short expression: plans stay small however many tables there are."""
    return F.transform(F.expr(_array(masks)), lambda m, t: F.xxhash64(t + first, F.col(fp).bitwiseAND(m)))


def _array(numbers: list[int]) -> str:
    return f"array({','.join(f"bigint('{_signed(x)}')" for x in numbers)})"


def _flips(mask: int, least: int, most: int) -> list[int]:
    """All settings of ``least`` to ``most`` bits that the mask leaves out."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [sum(c) for k in range(least, most + 1) for c in combinations(free, k)]


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, pair_bucket: int = PAIR_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: every document with its near-duplicate class.

    Classes are the connected components of links between fingerprints; a class's id is its least ``doc_id``. Documents
    without words have fingerprint zero and are linked to each other like any others. Null texts count as empty. Repeated
    rows come back as often as they came. Null ids are kept; they never name a class unless all its ids are null.
    An empty table gives an empty result.
    """
    marks = written(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash-marks")
    return marks.join(fingerprint_classes(marks, radius, pair_bucket), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_classes(marks: DataFrame, radius: int = 3, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """``(fp, component_id)``: each distinct fingerprint of ``marks(doc_id, fp)`` with the least ``doc_id`` of its class, a connected component of ``links``."""
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct, radius, pair_bucket=pair_bucket))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(named, "root").select("fp", "component_id")


#: Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is at least 4 / 5.
ALIKE = (4, 5)
#: Min-hashes a text, and how many of them make a table's key: at a similarity of 4 / 5 all 42 tables miss a pair with a chance of 3e-6.
MINS, BAND = 256, 6
#: Differing last bits of the min-hashes up to which two texts are candidates: expected at 4 / 5 are 25.6 with deviation 4.8, so a chance below 1e-5 to miss.
CANDIDATE_BITS = 48
#: Differing bits up to which the fingerprints of two sets make them candidates too, by the covering tables: no such pair is missed.
RADIUS = 3
_TIMES = np.random.default_rng(1).integers(0, 1 << 63, MINS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = np.random.default_rng(2).integers(0, 1 << 63, MINS, dtype=np.uint64) << np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table keys and the min-hashes' last bits (as four numbers) of a set of hashes; an empty set has no keys."""
    if not len(shingles):
        return np.empty(0, np.int64), np.zeros(MINS // 64, np.int64)
    least = np.full(MINS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 11):
        least = np.minimum(least, (shingles[at : at + (1 << 11), None] * _TIMES + _PLUS).min(0))
    bits = np.packbits((mixed(least, 1) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64)
    bands = MINS // BAND
    rows = mixed(least[: bands * BAND], 2).reshape(bands, BAND) * _TIMES[:BAND]
    return mixed(rows.sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64), 3).view(np.int64), bits


def shingle_sets(docs: DataFrame, schema: str, words: int, id_col: str, text_col: str) -> DataFrame:
    """Of ``doc_id, node, size, fp, bits, keys, held`` those named in ``schema``: a text's id, the hash of its set of shingles, that set's size, fingerprint, signature and sorted hashes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            signs = [signature(x) for x in sets] if "bits" in names else []
            made = {
                "doc_id": lambda: batch.column(0),
                "node": lambda: pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), 3)) for x in sets], pa.int64()),
                "size": lambda: pa.array([len(x) for x in sets], pa.int64()),
                "fp": lambda: pa.array([_signed(fingerprint(x)) for x in sets], pa.int64()),
                "bits": lambda: pa.array([x for _, x in signs], pa.list_(pa.int64())),
                "keys": lambda: pa.array([x for x, _ in signs], pa.list_(pa.int64())),
                "held": lambda: pa.array([x.tobytes() for x in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([made[n]() for n in names], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _forest(a: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect all rows of fingerprints (rows x lanes) that links of at most ``most`` bits connect: a star for each class, so at most one edge a row.

    Breadth first: the rows near a taken row are taken and leave the rest, so few comparisons remain in dense groups.
    """
    rest, out = np.arange(len(a)), []
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(a[rest] ^ a[at]).sum(1) <= most
            queue += rest[near].tolist()
            out += [(first, int(i)) for i in rest[near]]
            rest = rest[~near]
    return out


def _near_bits(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which rows are candidates of ``one``: by the bits of their min-hashes or, where a fingerprint follows these, by its."""
    apart = np.bitwise_count(rows ^ one)
    return (apart[:, : MINS // 64].sum(1) <= CANDIDATE_BITS) | (apart[:, MINS // 64 :] <= RADIUS).any(1)


def _alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets ``others`` have a Jaccard similarity of at least ALIKE with ``one``, in whole numbers. All are sorted."""
    if not len(one):
        return np.fromiter((not len(x) for x in others), bool, len(others))
    shared = np.empty(len(others), np.int64)
    for i, x in enumerate(others):
        at = np.searchsorted(one, x)
        at[at == len(one)] = 0
        shared[i] = (one[at] == x).sum()
    either = len(one) + np.fromiter(map(len, others), np.int64, len(others)) - shared
    return shared * ALIKE[1] >= either * ALIKE[0]


def _exact_forest(bits: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect all that pairs of similar sets connect, at most one a row: breadth first as ``_forest``, with the sets compared where size and bits allow it."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rest, out = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            fits = np.minimum(sizes[rest], sizes[at]) * ALIKE[1] >= np.maximum(sizes[rest], sizes[at]) * ALIKE[0]
            maybe = np.flatnonzero(fits & _near_bits(bits[rest], bits[at]))
            near = maybe[_alike(sets[at], [sets[i] for i in rest[maybe]])]
            queue += rest[near].tolist()
            out += [(at, int(i)) for i in rest[near]]
            rest = np.delete(rest, near)
    return out


def _table_edges(table: pa.Table, of: Callable[[np.ndarray, pa.Table], list[tuple[int, int]]]) -> pa.Table:
    """``of``'s edges between rows of ``table(node, bits, ...)`` as pairs of nodes. Rows go by node, so that the least leads and a dense group's many buckets mostly give the same edges; of a node's rows one counts."""
    table = table.sort_by("node")
    node = table["node"].to_numpy()
    once = np.concatenate((np.ones(min(len(node), 1), bool), node[1:] != node[:-1]))
    table, node = table.filter(pa.array(once)), node[once]
    found = np.array(of(_rows(table["bits"].combine_chunks()), table), np.int64).reshape(-1, 2)
    return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})


def _rows(bits: pa.ListArray) -> np.ndarray:
    return bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(bits), -1)


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _candidates(table: pa.Table) -> pa.Table:
    return _table_edges(table, lambda bits, _: _forest(bits, CANDIDATE_BITS))


def _similar_sets(table: pa.Table) -> pa.Table:
    return _table_edges(table, lambda bits, t: _exact_forest(bits, _sets(t["held"])))


def _near_lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with ``near`` in the place of the lead's columns: whether a row is a candidate of its lead and, where sets are held, similar to it."""
    for batch in batches:
        names = [c for c in batch.schema.names if not c.startswith("lead_")]
        near = _near_bits(_rows(batch["bits"]), _rows(batch["lead_bits"]))
        if "held" in names:
            for i in np.flatnonzero(near):
                near[i] = _alike(np.frombuffer(batch["lead_held"][i].as_buffer(), np.uint64), [np.frombuffer(batch["held"][i].as_buffer(), np.uint64)])[0]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(near)], names=[*names, "near"])


def group_edges(members: DataFrame, sizes: DataFrame, key: str, size: str, most: int, forest: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``(a, b)``: edges that connect all that alike rows of a group connect, from ``members(key, size, node, bits[, held])``; ``forest`` gives them for a table of rows.

    A group of up to ``most`` by its ``size`` is one task's. In a larger one all rows are first compared with the one of the least node. Those alike with it are connected through it, so only
    the others are left to be compared: they are dealt into blocks, and each row of the group meets each of those blocks, in tasks of about ``most`` rows. So no pair is left out, and the work grows
    with the rows times those that are unlike the lead (few, in groups of copies with edits), not with all pairs. ``sizes`` are the groups' sizes from a cheaper table: where none is large, ``members`` is
    read once only.
    """
    payload = [c for c in ("bits", "held") if c in members.columns]
    light = members.where(F.col(size) <= most).select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), "node", *payload)
    star, parts = None, F.ceil(F.col(size) * 2 / most).cast("int")
    if sizes.where(F.col(size) > most).limit(1).count():
        heavy = written(members.where(F.col(size) > most).select(key, "node", *payload, parts.alias("parts"), F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int").alias("i")), "similar-heavy")
        first = heavy.groupBy(key).agg(F.min("node").alias("lead"), F.min_by(F.struct(*payload), "node").alias("x"), F.max("parts").alias("parts"))
        # once for each block of the group, so that no task joins a whole group
        leads = first.select(key, "lead", *(F.col(f"x.{c}").alias(f"lead_{c}") for c in payload), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
        met = heavy.join(leads, [key, "i"])
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields if not f.name.startswith("lead_"))
        told = written(met.mapInArrow(_near_lead, f"{fields}, near boolean"), "similar-led")
        star = told.where("near AND node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        others = told.groupBy(key).agg(F.count_if(~F.col("near")).alias("k"), F.count("*").alias("m"), F.max("parts").alias("p")).where("k > 0")
        rest = told.join(others.select(key, F.ceil(F.col("p") * F.col("k") / F.col("m")).cast("int").alias("across")), key)
        every = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        apart = rest.where(~F.col("near")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(8)), F.col("across")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        light = light.unionByName(every.select(light.columns)).unionByName(apart.select(light.columns))
    edges = light.groupBy(key, "i", "j").applyInArrow(forest, "a long, b long")
    return edges if star is None else edges.union(star)


def similar(docs: DataFrame, words: int = 5, pair_bucket: int = 8, group_bucket: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: near-duplicate classes, the connected components of pairs whose sets of ``words``-word shingles have a Jaccard similarity of at least ALIKE.

    Candidates are first the classes of ``near_duplicates``, by the fingerprints of the sets under covering masks: every pair of at most RADIUS differing bits is among them. A pair of a similarity near ALIKE
    differs in about ten bits, so no radius that masks can cover takes in all links; candidates are therefore also texts that share a table's key (six min-hashes) and differ in at most CANDIDATE_BITS bits of their signatures. Buckets of up to ``pair_bucket`` texts are compared in
    pairs; larger ones as in ``group_edges``: those of up to ``group_bucket`` by one task each, which gives a spanning forest of their candidates, others through a lead and blocks. Within each
    connected group of candidates the whole sets of shingles are then compared (by ``group_edges`` too), so no pair of a lower similarity is linked and none is left out. Equal sets are one node. Classes are named by their least id. Nulls, repeated rows and empty tables are as in ``near_duplicates``.
    Tables that several later joins read are written (a few numbers a text), so that no plan, and with it what the driver holds while it plans, gets long.
    """
    marks = written(shingle_sets(docs, "doc_id long, node long, size long, fp long, bits array<long>, keys array<long>", words, id_col, text_col), "similar-marks")
    distinct = written(marks.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "fp", "bits", "keys"))), "similar-nodes")
    prints = fingerprint_classes(distinct.select(F.col("node").alias("doc_id"), "fp"), RADIUS)
    near = written(distinct.join(prints, "fp").where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b")), "similar-prints")

    rows = distinct.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, "key").join(distinct.select("node", "bits"), "node"), "similar-buckets")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    light = shared.where(F.col("n") <= pair_bucket)
    side = lambda n, v: light.select("key", F.col("node").alias(n), F.col("bits").alias(v))
    pairs = side("a", "x").join(side("b", "y"), "key").where((F.col("a") < F.col("b")) & (apart <= CANDIDATE_BITS)).select("a", "b")

    forest = group_edges(shared.where(F.col("n") > pair_bucket), shared, "key", "n", group_bucket, _candidates)
    met = written(connected_components(near.union(pairs).union(forest)).join(distinct.select("node", "least", "size", F.concat("bits", F.array("fp")).alias("bits")), "node"), "similar-met")
    weights = met.groupBy("root").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / 200)).alias("n"))  # a row of 200 shingles, or less, weighs one
    wanted = met.select(F.col("least").alias("__least")).distinct().hint("shuffle_hash")  # grows with the table, so it isn't sent through the driver
    texts = docs.join(wanted, F.col(id_col).cast("long").eqNullSafe(F.col("__least")), "left_semi")
    sets = shingle_sets(texts, "node long, held binary", words, id_col, text_col).groupBy("node").agg(F.first("held").alias("held"))
    linked = group_edges(met.select("node", "root", "bits").join(weights, "root").join(sets, "node"), weights, "root", "n", group_bucket, _similar_sets)
    classes = written(distinct.join(connected_components(linked), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "similar-classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.select("doc_id", "node").join(classes.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class by ``similar``, in the columns of ``docs``: that of the least id, and of several texts of this id in the class, that of the least hash.

    Rows are told apart by id and text, so texts of one id are judged each by its own class; of rows that repeat both, one stays. Rows with a null id can't be told apart by it, so all of them stay.
    """
    key, text = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    known = docs.where(F.col(key).isNotNull()).withColumn("__row", F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    classes = similar(known, id_col="__row", text_col=text, **options).distinct()
    ids = known.select(F.col("__row").alias("doc_id"), F.col(key).alias("__id")).distinct()
    kept = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct("__id", "doc_id")).alias("__first")).select(F.col("__first.doc_id").alias("__row"))
    return known.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
