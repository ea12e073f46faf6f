"""What larger tables and odd rows asked of single queries, on small ones."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.functions.stats import narrow_quantiles, with_quantiles
from gridstone.operators import dedup
from gridstone.plans import extraction, models, relational
from gridstone.plans.base import listings
from gridstone.plans.composites import trusted
from gridstone.session import shared_folder


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["un leséo", "éthe", "lesa", "les_", "nôt pasé", "canever", "x not-y"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.status for r in extraction.x23_fallback_parse(spark, str(tmp_path)).collect()}
    assert [got[i][:2] for i in range(len(texts))] == ["ob", "ob", "pe", "pe", "pr", "pe", "pr"]


@pytest.mark.parametrize("accuracy", [10_000, 20])  # the second has windows that many ranks lie in
def test_narrow_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(3)
    columns = {"a": rng.normal(size=3000).round(2), "b": rng.integers(0, 4, 3000).astype(float), "c": rng.random(10), "d": np.array([5.0]), "e": np.array([1.0, 2.0])}
    rows = [(k, float(v), -float(v)) for k, vs in columns.items() for v in vs] + [("a", None, None), ("none", None, None), (None, 3.0, 7.0)]
    x = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    wanted = {"q1": ("v", 0.25), "med": ("v", 0.5), "high": ("w", 0.9)}
    got = {r.k: r for r in narrow_quantiles(x, ["k"], wanted, accuracy).collect()}
    for k, vs in columns.items():
        assert [got[k].q1, got[k].med, got[k].high] == pytest.approx([np.quantile(vs, 0.25), np.quantile(vs, 0.5), np.quantile(-vs, 0.9)])
    assert (got[None].med, got[None].high, "none" in got) == (3.0, 7.0, False)
    whole = with_quantiles(x, [], {"med": ("v", 0.5)}, F.count("*").alias("n")).collect()
    assert len(whole) == 1 and whole[0].n == len(rows) and whole[0].med == pytest.approx(np.median([v for _, v, _ in rows if v is not None]))
    assert with_quantiles(x.where("k = 'none'"), [], {"med": ("v", 0.5)}, F.count("*").alias("n")).collect() == [(1, None)]


def test_narrow_quantiles_shuffle_few_rows(spark):
    """A percentile's buffer holds every value of the group; here a task hands over only those near the wanted rank."""
    x = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    with_quantiles(x, [], {"med": ("v", 0.5)}, F.count("*").alias("n")).collect()
    newest = max(glob.glob(shared_folder(spark).removeprefix("file:") + "/counts-*"), key=os.path.getmtime)
    assert spark.read.parquet(newest).count() < 200


def test_short_texts_meet_at_their_letters(spark):
    texts = [f"supplier#{i:09d}" for i in range(60)] + [f"a{i}b" for i in range(20)] + ["abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz012345678", "abcdefghijklmnopqrstuvwxyz012345689", "supplier#00000001", "", "x", "red pin", "red  pin", "pin red"]
    for threshold in (0.88, 0.9, 0.97):
        got = {(r.a, r.b): r.score for r in models.like_texts(spark.createDataFrame([(t,) for t in texts], "t string"), threshold, 7).collect()}
        some = sorted({t for t in texts if t})
        assert got == {(a, b): s for i, a in enumerate(some) for b in some[i + 1 :] if (s := models.sequence_likeness(a, b)) >= threshold}


def test_names_of_one_kind_make_few_candidates(spark):
    """18 million pairs of numbered names share their rarest letters, but none is alike."""
    names = spark.range(6000).select(F.format_string("supplier#%09d", "id").alias("t"))
    began = time.time()
    assert models.like_texts(names, 0.97).count() == 0
    assert time.time() - began < 60


def _homes(spark, n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        price, surface = (None if rng.random() < 0.1 else float(rng.integers(-2, 40) * 1000)), (None if rng.random() < 0.1 else float(rng.integers(0, 5) * 10))
        rows.append((i * 7 % n, price, surface, ["Villa à louer", "villa a louer", "Studio", "S", "", None][rng.integers(6)], ["Tunis", "tunis ", "Sfax", None, "a" * 25, "a" * 24][rng.integers(6)]))
    return spark.createDataFrame(rows, "id long, price double, surface double, title string, city string")


def test_fuzzy_pairs_and_survivors_are_those_of_all_pairs(spark):
    x = _homes(spark, 240)
    for threshold in (0.7, 0.85, 0.95):
        met = dedup.block_pairs(x)
        want = {(r.a, r.b, r.score) for r in met.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.round(dedup.alike("one", "two"), 4).alias("score")).where(F.col("score") >= threshold).collect()}
        assert {tuple(r) for r in dedup.fuzzy_pairs(x, "id", threshold).collect()} == want and want
        gone = set()
        for b in range(240):
            if any(t == b and a not in gone for a, t, _ in want):
                gone.add(b)
        for most in (20_000, 12):
            assert sorted(r.id for r in dedup.fuzzy_survivors(x, "id", threshold, most=most).collect()) == sorted(set(range(240)) - gone)


def test_crowded_places_make_no_pairs(spark):
    points = spark.range(40_000).select("id", (30 + F.col("id") % 2 * 0.5).alias("lat"), F.when(F.col("id") % 7 != 0, 8.0).alias("lon"))
    got = {(r.market, r.n) for r in models.micro_markets(points, 2.0, 5).groupBy("market").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 5715), (1, 17143), (2, 17142)}


def test_alerts_are_counted_without_pairs(spark, tmp_path):
    """A billion pairs of 20,000 subscriptions and 50,000 listings of one city; some subscriptions are checked one by one."""
    save = lambda df, name: df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    save(spark.sql("select 0 r_regionkey, 'R' r_name"), "region")
    save(spark.sql("select 0 n_nationkey, 'NATION_0' n_name, 0 n_regionkey"), "nation")
    save(spark.sql("select 0L s_suppkey, 0 s_nationkey"), "supplier")
    save(spark.sql("select id p_partkey, array('LARGE', 'SMALL', 'PROMO')[id % 3] p_type, 'x' p_name, 1 p_size from range(3)"), "part")
    h = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1_000_000)) / 1e6
    lines = spark.range(50_000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 3).alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.floor(1 + h(1) * 50).cast("double").alias("l_quantity"),
        F.round(20_000 + h(2) * 12_000, 2).alias("l_extendedprice"), F.when(h(3) < 0.5, "A").otherwise("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"),
    )
    save(lines, "lineitem")
    save(spark.range(20_000).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.round(9000.01 + h(4) * 900, 2).alias("c_acctbal"), F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("OTHER")), (F.col("id") % 3 + 1).cast("int")).alias("c_mktsegment")), "customer")
    began = time.time()
    got = {r.subscriber: r for r in relational.j9_alert_matches(spark, str(tmp_path)).collect()}
    assert time.time() - began < 120
    x = trusted(listings(spark, str(tmp_path))).select("property_type", "price", "surface", "trust").toPandas()
    customers = spark.read.parquet(str(tmp_path / "customer.parquet")).where("c_custkey % 997 = 0").collect()
    for c in customers:
        kinds = {"BUILDING": ["LARGE", "STANDARD"], "MACHINERY": ["SMALL"]}.get(c.c_mktsegment, ["LARGE", "SMALL", "PROMO"])
        m = x[(x.price <= c.c_acctbal * 3) & (x.surface >= c.c_custkey % 40) & (x.trust >= 0.5 + (c.c_custkey % 5) * 0.1) & x.property_type.isin(kinds)]
        r = got.get(c.c_custkey)
        assert (r.matches, r.cheapest) == (len(m), m.price.min()) and r.mean_trust == pytest.approx(m.trust.mean(), abs=6e-5) if len(m) else r is None


def test_like_sets_with_large_members_and_copies(spark):
    rng = np.random.default_rng(8)
    base = [rng.integers(-(2**63), 2**63 - 1, n) for n in (1, 3, 40, 300, 900)]
    rows = []
    for i in range(150):
        w = base[i % 5].copy()
        w[rng.random(len(w)) < rng.choice([0, 0.05, 0.07, 0.2])] = rng.integers(2**62)
        rows.append((i * 13 % 150, [int(v) for v in w] + [int(w[0])]))
    stay = []
    for i, w in sorted(rows + [(999, [])]):
        if not w or all(len(set(w) & v) * 100 < 88 * len(set(w) | v) for _, v in stay):
            stay.append((i, set(w)))
    x = spark.createDataFrame(rows + [(999, [])], "id long, w array<long>").repartition(3)
    for most in (2000, 20):
        assert sorted(r.id for r in dedup.unlike_sets(x, 88, most).collect()) == [i for i, _ in stay]
