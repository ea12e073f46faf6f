"""Hand-computed values, and properties, of the building blocks."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridstone.functions import stats, text
from gridstone.operators import dedup
from gridstone.plans.aggregates import emerging
from gridstone.plans.feeds import harmonise
from gridstone.plans.models import alike_vectors, micro_markets


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("values", "s", "z", "p", "tau", "trend"), [
    ([1, 2, 3, 4], 6, 1.6984, 0.0894, 1.0, "stable"), ([1, 2, 3, 4, 5], 10, 2.2045, 0.0275, 1.0, "up"), ([5, 4, 4, 2, 1, 1], -13, -2.2544, 0.0242, -0.8667, "down"), ([3, 3, 3, 3], 0, 0.0, 1.0, 0.0, "stable"), ([1, 2, 3], 3, 0.0, 1.0, 1.0, "stable"),
])
def test_mann_kendall(spark, values, s, z, p, tau, trend):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "key string, at int, v double")
    got = stats.mann_kendall(df, "key", "at", "v").first()
    assert (got.s, got.z, got.p, got.tau, got.trend) == (s, z, p, tau, trend)


def test_normal_cdf(spark):
    for z in (-3.0, -1.0, 0.0, 0.5, 2.3):
        assert abs(one(spark, p=stats.normal_cdf(F.lit(z))).p - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6


def test_iqr_keeps_nulls_and_drops_the_far(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 110, 120, 130, 140, 150, 10000)] + [(None,)], "v double")
    assert sorted((r.v or 0) for r in stats.iqr_keep(df, "v").collect()) == [0, 100, 110, 120, 130, 140, 150]
    assert stats.iqr_keep(df.limit(0), "v").count() == 0


def test_average_rank_and_ks(spark):
    df = spark.createDataFrame([(10,), (20,), (20,), (40,)], "v int")
    assert sorted(r["p"] for r in stats.average_ranks(df, "v", "p").collect()) == [0.25, 0.625, 0.625, 1.0]
    a, b = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double"), spark.createDataFrame([(float(v),) for v in (3, 4, 5, 6)], "v double")
    assert stats.ks_distance(a, b, "v").first().d == 0.5 and stats.ks_distance(a, a, "v").first().d == 0.0


@pytest.mark.parametrize(("a", "b", "score"), [("villa piscine", "villa avec piscine", 10 / 17), ("", "", 1.0), ("a", "", 0.0)])
def test_trigram_jaccard(spark, a, b, score):
    assert abs(one(spark, s=text.jaccard(text.trigrams(F.lit(a)), text.trigrams(F.lit(b)))).s - score) < 1e-9


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.text("abc é", max_size=12), b=st.text("abc é", max_size=12))
def test_jaccard_is_symmetric(spark, a, b):
    x, y = text.trigrams(F.lit(a)), text.trigrams(F.lit(b))
    got = one(spark, p=text.jaccard(x, y), q=text.jaccard(y, x))
    assert got.p == got.q and 0 <= got.p <= 1


@pytest.mark.parametrize(("said", "price"), [("450 000 DT", 450000), ("1.2 million TND", 1.2e6), ("350k", 350000), ("sur demande", None)])
def test_price_text(spark, said, price):
    assert one(spark, v=text.price_number(F.lit(said))).v == price


def test_other_parsers(spark):
    got = one(spark, a=text.decimal_comma_price(F.lit("450,000 TND")), b=text.rooms_number(F.lit("S+2")), c=text.rooms_number(F.lit("3 pièces")), d=text.surface_number(F.lit("120 m2")), e=text.slug(F.lit("Été à Sfax!")), f=text.without_tags(F.lit("<p>a <b>b</b></p>")))
    assert tuple(got) == (450.0, 3, 3, 120.0, "ete-a-sfax", "a b")


def test_price_blocks(spark):
    got = one(spark, **{f"c{i}": dedup.price_block(F.lit(v).cast("double")) for i, v in enumerate((44999, 45000, None, -1))})
    assert tuple(got) == (30000, 45000, -1, -1)


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", 0)], "k string, o int")
    assert sorted((r.k or "", r.o) for r in dedup.keep_first(df, ["k"], ["o"]).collect()) == [("", 1), ("a", 0)]
    assert dedup.keep_first_where_known(df, ["k"], ["o"]).count() == 3


def test_upsert_and_changes(spark):
    now, before = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 4.0)], "k string, v double"), spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert {r.k: r.action for r in dedup.upsert(before, now, "k", ["v"]).collect()} == {"a": "skip", "b": "update", "c": "insert"}
    c, p = spark.createDataFrame([("h1", 60), ("h2", 50), ("h3", 10)], "k string, v int"), spark.createDataFrame([("h1", 45), ("h2", 60), ("h4", 5)], "k string, v int")
    assert {r.k: (r.change, r.delta) for r in dedup.changes(c, p, "k", "v").collect()} == {"h1": ("changed", 15), "h2": ("changed", -10), "h3": ("added", None), "h4": ("removed", None)}


def test_emerging_classes(spark):
    rows = [("z", f"2024-03-{d:02d}", 112.0) for d in range(16, 31)] + [("z", f"2024-01-{d:02d}", 100.0) for d in range(20, 30)]
    df = spark.createDataFrame(rows, "zone string, d string, price double").withColumn("at", F.to_timestamp("d"))
    got = emerging(df).first()
    assert (got.score, got["class"], got.severity) == (0.64, "emerging", "high")


def test_harmonise_skips_empty_aliases(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, None, 2)], "a string, b string, n int")
    assert [tuple(r) for r in harmonise(df, {"t": ["a", "b"], "m": ["zz"]}).collect()] == [("x", None), (None, None)]


def kilometres(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def brute_markets(points, eps, least):
    near = {i: [j for j, *q in points if kilometres(p, q) <= eps] for i, *p in points}
    core = {i for i, js in near.items() if len(js) >= least}
    label = {i: i for i in core}
    while True:
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            return {i: min((label[j] for j in js if j in core), default=None) for i, js in near.items()}
        label = new


@pytest.mark.parametrize(("lat", "lon"), [(36.8, 10.1), (-0.005, 0.0), (66.0, 179.99), (-82.0, -180.0)])
def test_micro_markets_match_brute_force(spark, lat, lon):
    """Near the equator, in high latitudes and across the 180th meridian; chains of many links settle however long they are."""
    rng = random.Random(lat)
    wide = 1 / math.cos(math.radians(lat))
    turn = lambda x: (x + 180) % 360 - 180
    points = [(i, lat + rng.uniform(-0.06, 0.06), turn(lon + wide * rng.uniform(-0.06, 0.06))) for i in range(120)] + [(200 + i, lat + 0.1, turn(lon + wide * 0.015 * i)) for i in range(60)]
    for least in (3, 5):
        got = {r.id: r.market for r in micro_markets(spark.createDataFrame(points, "id long, lat double, lon double"), 2.0, least).collect()}
        assert got == brute_markets(points, 2.0, least)


def test_micro_markets_of_few_points(spark):
    points = [(10, 37.5, 10.1), (11, 37.5 + 0.018, 10.1), *((i, 36.8, 10.1) for i in range(3))]
    got = {r.id: r.market for r in micro_markets(spark.createDataFrame(points, "id long, lat double, lon double"), 2.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: None, 11: None}
    assert micro_markets(spark.createDataFrame([], "id long, lat double, lon double")).count() == 0


def greedy(ids, alike):
    stay = []
    for i in sorted(ids):
        if not any(alike(j, i) for j in stay):
            stay.append(i)
    return stay


def test_pairs_of_a_block_meet_once_however_it_is_dealt(spark):
    rows = [(i, "hot" if i < 60 else f"b{i % 7}", None if i == 99 else 1) for i in range(100)] + [(200, None, 1)]
    df = spark.createDataFrame(rows, "id long, block string, x int")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[1] is not None)
    for most in (1, 7, 10, 1000):
        got = dedup.met_in_blocks(df, ["block"], "id", most).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))
        assert sorted(map(tuple, got.collect())) == want


def test_greedy_survivors_match_a_visit_in_order(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}) + [(i, i + 1) for i in range(100, 120)]
    df = spark.createDataFrame([(i,) for i in [*range(40), *range(100, 121), 500]], "id long")
    for most in (4, 30, 50_000):  # by rounds, by groups, and at once
        got = sorted(r.id for r in dedup.greedy_survivors(df, spark.createDataFrame(pairs + pairs[:5], "a long, b long"), "id", group_pairs=most).collect())
        assert got == greedy([r.id for r in df.collect()], lambda a, b: (a, b) in set(pairs))
    chain = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    assert sorted(r.id for r in dedup.greedy_survivors(spark.range(3001), chain, "id").collect()) == list(range(0, 3001, 2))  # a round a pair would never end
    assert dedup.greedy_survivors(df, spark.createDataFrame([], "a long, b long"), "id").count() == df.count()


def test_unlike_sets_match_brute_force(spark):
    """Sets near the threshold on both sides, copies of a set whose first leaves, empty sets, and blocks dealt into parts."""
    rng = random.Random(5)
    base = [rng.sample(range(300), 40) for _ in range(6)]
    rows = [(i, sorted({*rng.sample(base[i % 6], rng.randint(36, 40)), *rng.sample(range(1000, 1100), rng.randint(0, 3))})) for i in range(90)]
    rows += [(100 + i, rows[i * 3][1]) for i in range(12)] + [(200, []), (201, []), (202, [1]), (203, [1])]
    sets = {i: set(w) for i, w in rows}
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 88 * len(sets[a] | sets[b])
    for most in (3, 2000):
        got = sorted(r.id for r in dedup.unlike_sets(spark.createDataFrame(rows, "id long, w array<long>"), 88, most).collect())
        assert got == greedy(sets, alike)
    assert dedup.unlike_sets(spark.createDataFrame([], "id long, w array<long>")).count() == 0


def test_alike_vectors_match_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.35) for x in base[i % 5]], i % 3) for i in range(80)]
    rows += [(100 + i, rows[i * 7][1], (i + 1) % 3) for i in range(8)] + [(200, None, 0), (201, [0.0] * 8, 0), (202, [0.0] * 8, 1)]
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    known = lambda v: v is not None and any(v)
    alike = lambda a, b: known(order[a][1]) and known(order[b][1]) and dot(order[a][1], order[b][1]) >= 0.88 * math.sqrt(dot(order[a][1], order[a][1]) * dot(order[b][1], order[b][1]))
    want = sorted(order[k][0] for k in greedy(range(len(order)), alike))
    assert 10 < len(want) < 70
    df = spark.createDataFrame(rows, "id long, embedding array<double>, priority int")
    for options in ({"block": 6, "pivots": 3}, {}):
        assert sorted(r.id for r in alike_vectors(df, **options).collect()) == want


def test_cosine_pairs_equal_all_pairs(spark):
    import numpy as np

    from gridstone.operators.vectors import cosine_pairs

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 10)) * 3
    x = np.vstack([centres[i % 6] + rng.normal(size=10) * rng.choice([0.3, 1.5]) for i in range(240)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(240)] + [(500, [float("nan")] * 10), (501, None), (502, [1.0]), (None, [1.0] * 10), (503, [0.0] * 10)]
    for threshold in (0.5, 0.9):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= threshold, 1)))}
        got = cosine_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), threshold, pivots=6, block=25).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    copies = cosine_pairs(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, embedding array<double>"), 0.9).collect()
    assert {(r.a, r.b) for r in copies} == {(0, i) for i in range(1, 50)}
    assert cosine_pairs(spark.createDataFrame([], "id long, embedding array<double>"), 0.9).count() == 0


def test_grouped_quantiles_and_ranks(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1.0, 2.5, rng.gauss(0, 9), None]), rng.randint(0, 5)) for _ in range(3000)] + [("alone", 7.0, None), ("none", None, 1)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    wanted = {"med": ("x", 0.5), "low": ("x", 0.1), "top": ("y", 0.93), "double": (F.col("x") * 2, 0.5)}
    got = {r.k: r for r in stats.summarised(df, ["k"], wanted, F.count("*").alias("n")).collect()}
    for key in ("a", "b", None, "hot", "alone", "none"):
        mine = [r for r in rows if r[0] == key]
        x, y = [r[1] for r in mine if r[1] is not None], [r[2] for r in mine if r[2] is not None]
        assert got[key].n == len(mine)
        for name, values, q, scale in (("med", x, 0.5, 1), ("low", x, 0.1, 1), ("top", y, 0.93, 1), ("double", x, 0.5, 2)):
            assert got[key][name] == (pytest.approx(scale * float(np.quantile(values, q)), abs=1e-9) if values else None)
    plan = stats.grouped_quantiles(df, ["k"], wanted)._jdf.queryExecution().toString()
    assert "percentile(" not in plan
    ranked = stats.average_ranks(df, "x", "rank").collect()
    known = sorted(r[1] for r in rows if r[1] is not None)
    place = {v: (known.index(v) + 1 + (known.count(v) - 1) / 2) / len(known) for v in set(known)}
    assert len(ranked) == len(rows) and all(r["rank"] == (None if r.x is None else pytest.approx(place[r.x])) for r in ranked)


@pytest.mark.parametrize("pieces", [1, 2, 40])
def test_running_sums_in_ranges(spark, pieces):
    rng = random.Random(pieces)
    rows = [(x, rng.randint(1, 9), rng.randint(0, 3)) for x in sorted({round(rng.gauss(0, 5), 2) for _ in range(400)})]
    got = {r.x: (r.a_upto, r.b_upto) for r in stats.running(spark.createDataFrame(rows, "x double, a long, b long"), "x", "a", "b", pieces=pieces).collect()}
    assert got == {x: (sum(r[1] for r in rows[: i + 1]), sum(r[2] for r in rows[: i + 1])) for i, (x, *_) in enumerate(rows)}
    assert stats.running(spark.createDataFrame([], "x double, a long"), "x", "a", pieces=pieces).count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(9)
    for values in ([rng.gauss(0, 1) for _ in range(3001)], [1.0] * 500 + [2.0] * 499, [5.0], [1.0, 2.0], [float(rng.randint(0, 3)) for _ in range(800)] + [None] * 50):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for accuracy in (10_000, 20):
            got = stats.exact_quantiles(df, "v", 0.0, 0.25, 0.5, 0.99, 1.0, accuracy=accuracy)
            assert np.allclose(got, np.quantile([v for v in values if v is not None], [0.0, 0.25, 0.5, 0.99, 1.0]), atol=1e-12)
    assert stats.exact_quantiles(df.limit(0), "v", 0.5, 0.9) == [None, None]


def test_notifications_and_run_log(spark, tmp_path):
    from gridstone.streaming import micro_batch as M

    folder, log = str(tmp_path / "in"), M.RunLog()
    spark.streams.addListener(log)
    try:
        for day in (1, 2):
            spark.createDataFrame([(day * 10 + i, f"2024-05-0{day} 0{i}:00:00") for i in range(3)], "id long, at string").selectExpr("id", "cast(at AS timestamp) AS at").write.mode("append").parquet(folder)
            stream = spark.readStream.schema("id long, at timestamp").parquet(folder)
            M.notify(stream, str(tmp_path / "log"), "new_data", F.concat(F.lit("é row "), F.col("id").cast("string")), "at", "id")
        for _ in range(100):
            if sum(x["event"] == "ended" for x in log.lines) == 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    said = lambda after: sorted(tuple(r) for r in M.notifications(spark, str(tmp_path / "log"), "id: bigint", after).select("type", "message", "data.id").collect())
    assert said(None) == [("new_data", f"é row {i}", i) for i in (10, 11, 12, 20, 21, 22)]  # each row once, over two runs
    assert said("2024-05-02T00:00:00") == [("new_data", f"é row {i}", i) for i in (21, 22)]
    assert sum(x["event"] == "ended" for x in log.lines) == 2 and sum(x.get("rows", 0) for x in log.lines) == 6


def test_shared_folder_needs_a_name_on_a_cluster(spark):
    from types import SimpleNamespace

    from gridstone.session import shared_folder

    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x"), conf=conf))


def test_paged_source_retries_with_growing_pauses():
    from gridstone.sources.paged import PagedReader, attempted

    calls = []

    def fetch(page):
        calls.append(page)
        if len(calls) < 3:
            raise OSError("try again")
        return [(page,)]

    assert attempted(fetch, 7, pause=0) == [(7,)] and calls == [7, 7, 7]
    calls.clear()
    with pytest.raises(OSError):
        attempted(fetch, 7, attempts=2, pause=0)
    parts = PagedReader(fetch, 10, 4).partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 5), (5, 9), (9, 11)]


def test_upload_in_latin_1_loses_unnamed_columns(spark, tmp_path):
    from gridstone.sources.delimited import read_upload

    got = read_upload(spark, "Unnamed: 0;ville\n0;Béja\n1;\n".encode("iso-8859-1"), str(tmp_path / "up"))
    assert got.columns == ["ville"] and [r.ville for r in got.collect()] == ["Béja", None]


def test_newest_file_by_time_then_path(spark, tmp_path):
    import os

    from gridstone.sources.delimited import newest

    for name, at in (("a.csv", 2000), ("b.csv", 1000), ("c.txt", 3000)):
        (tmp_path / name).write_text("x\n1\n")
        os.utime(tmp_path / name, (at, at))
    assert newest(spark, str(tmp_path)).endswith("a.csv")
    os.utime(tmp_path / "b.csv", (2000, 2000))
    assert newest(spark, str(tmp_path)).endswith("b.csv")


def test_rules_that_users_add(spark):
    from pyspark.sql import functions as F

    from gridstone.plans.surfaces import Rules

    df = spark.createDataFrame([(1, None), (2, 5.0)], "id int, v double")
    got = Rules().expect("rows", F.count("*"), 2, critical=True).expect("known", F.count("v"), 2).check(df).collect()
    assert [(x.rule, x.critical, x.value, x.passed) for x in got] == [("rows", True, 2.0, True), ("known", False, 1.0, False)]


def test_like_texts_match_brute_force(spark):
    from gridstone.plans.models import actor_likeness, like_texts, sequence_likeness

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(12, 30))).strip() for _ in range(25)]
    edit = lambda t: (lambda i: t[:i] + rng.choice(["", "x", t[i : i + 1] * 2]) + t[i + 1 :])(rng.randrange(len(t)))
    texts = base + [edit(rng.choice(base)) for _ in range(60)] + ["", "   ", "one", "one two", "ONE two ", "two one"]
    known = sorted({t.lower().strip(" ") for t in texts} - {""})
    for threshold in (0.88, 0.95):
        want = {(a, b): s for i, b in enumerate(known) for a in known[:i] if (s := sequence_likeness(a, b)) >= threshold}
        for most in (5, 2000):
            got = {(r.a, r.b): r.score for r in like_texts(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), threshold, most).collect()}
            assert got == want and len(want) > 10
    assert actor_likeness("tenant", "tenants") == 0.87 and actor_likeness("Lodger", "tenant") == sequence_likeness("lodger", "tenant") and actor_likeness("owner", "owner") == 1.0
    assert actor_likeness("first actor", "first acton", {"first actor": "x", "first acton": "y"}) == 0.20 < actor_likeness("first actor", "first acton", {"first actor": "x"})
