"""Every catalogue query against its SQL in DuckDB on the smallest tables; queries without SQL by their own properties."""

import pytest
from pyspark.sql import functions as F

from gridstone import catalog
from tests.compare import connect, difference

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_forecast_follows_a_parabola(spark):
    from gridstone.plans.models import quadratic

    rows = [("z", x, float(x * x - 3 * x + 7)) for x in range(8)] + [("line", 0, 1.0), ("line", 5, 3.0), ("one", 2, 4.0)]
    got = {}
    for r in quadratic(spark.createDataFrame(rows, "zone string, month int, med double"), 2).orderBy("step").collect():
        got.setdefault(r.zone, []).append((r.forecast, r.low, r.high))
    assert got == {"z": [(47.0, 47.0, 47.0), (61.0, 61.0, 61.0)], "line": [(5.0, 5.0, 5.0), (7.0, 7.0, 7.0)], "one": [(4.0, 4.0, 4.0)] * 2}


def test_streams_equal_batches(spark, sf):
    log = QUERIES["z5_change_log"](spark, sf).collect()
    assert len({(r.key, r.place) for r in log}) == len(log) and all(r.old != r.new for r in log)
    days = QUERIES["z3_daily_windows"](spark, sf).collect()
    whole = {(r.day, r.event_type): r.n for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr("to_date(ts) AS day", "event_type").groupBy("day", "event_type").count().withColumnRenamed("count", "n").collect()}
    assert {(r.start.date(), r.event_type): r.n for r in days} == whole  # open windows too


def test_sequence_ratio_matches_brute_force(spark, sf):
    from difflib import SequenceMatcher

    names = sorted({r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()})
    want = {(a, b): 0.87 if a in b or b in a else round(SequenceMatcher(None, a, b).ratio(), 4) for i, b in enumerate(names) for a in names[:i] if a.split(" ")[0] == b.split(" ")[0]}
    assert {(r.a, r.b): r.score for r in QUERIES["d17_sequence_ratio"](spark, sf).collect()} == want


def plain_sentences(text, least=15):
    import re

    return [s.strip() for s in re.split(r'(?<=[.!?])\s+(?=[A-ZÀ-Þ"«])', re.sub(r"\s+", " ", text)) if len(s.strip()) >= least]


def plain_distinct(sentences, binding):
    import re

    words = lambda s: {w for w in re.split(r"\W+", s.lower()) if len(w) >= 4}
    kept = []
    for s in sentences:
        if binding(s) or not any(words(s) and words(k) and len(words(s) & words(k)) / len(words(s) | words(k)) >= 0.6 for k in kept):
            kept.append(s)
    return kept


TALK = [
    "Sure! Here are the facts: The article must be kept. The article must be kept. Prices rose quickly in that northern city last year. Prices rose quickly in that northern city last year again. We recommend waiting until summer arrives.",
    "Short text.", "", None, "no capital letters at all and nothing that ends " * 30, "The law shall apply here. " * 40 + "Finally buyers should wait for spring.", "Of course, " + "Another sentence number one stands here. A wholly different remark follows now. " * 9,
]


def test_distinct_sentences_match_brute_force(spark, sf):
    import re

    from gridstone.plans import extraction

    binding = lambda s: re.search(extraction.BINDING, s)
    got = sorted((r.conv_id, r.turn, r.n_sentences, r.n_kept) for r in QUERIES["d15_distinct_sentences"](spark, sf).collect())
    messages = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null").collect()
    assert got == sorted((m.conv_id, m.turn, len(s := plain_sentences(m.text, 1)), len(plain_distinct(s, binding))) for m in messages)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TALK) if t is not None], "i long, text string")
    kept = {r.i: [x.s for x in r.kept] for r in df.select("i", extraction.distinct_sentences(extraction.sentences_of(F.col("text"))).alias("kept")).collect()}
    assert kept == {i: plain_distinct(plain_sentences(t), binding) for i, t in enumerate(TALK) if t is not None}


def test_summaries_match_a_plain_version(spark):
    import re

    from gridstone.plans import extraction

    binding, closing = (lambda s: re.search(extraction.BINDING, s)), (lambda s: re.search(extraction.CLOSING, s))

    def plain(text, limit):
        if text is None or len(text.strip(" ")) <= limit:
            return text and text.strip(" ")
        bare = [re.sub(extraction.FILLER, "", s).strip() for s in plain_sentences(text)]
        kept = plain_distinct([s[0].upper() + s[1:] for s in bare if len(s) >= 10], binding)
        free = [s for s in kept if not binding(s)]
        out = []
        for s in [s for s in kept if binding(s)][:3] + [s for s in free if not closing(s)][:2] + [s for s in free if closing(s)][:1]:
            if len(" ".join([*out, s])) + 1 > limit:
                break
            out.append(s)
        told = " ".join(out)
        return (told + ("" if told[-1] in ".!?" else ".")) if out else re.sub(r"\s\S*$", "", text.strip(" ")[:limit]) + "."

    df = spark.createDataFrame(list(enumerate(TALK)), "i long, text string")
    for limit in (60, 150, 700):
        got = {r.i: r.s for r in df.select("i", extraction.summary(F.col("text"), limit=limit).alias("s")).collect()}
        assert got == {i: plain(t, limit) for i, t in enumerate(TALK)}


def test_phrases_are_replaced_longest_first(spark):
    from gridstone.plans import extraction

    def plain(words, phrases):
        out, n, i = [], 0, 0
        while i < len(words):
            for k in (3, 2, 1):
                gram = " ".join(words[i : i + k])
                if i + k <= len(words) and gram in phrases:
                    out += [phrases[gram]] if phrases[gram] else []
                    n, i = n + 1, i + k
                    break
            else:
                out.append(words[i])
                i += 1
        return out, n

    texts = ["in the end the law", "a lot of a lot as well as the the and the end", "with the", "", "und der que los", "in the in the end such as", "nothing here"]
    got = [(list(r.x.out), r.x.n) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(extraction.substituted(F.filter(F.split("t", " "), lambda w: w != "")).alias("x")).collect()]
    assert got == [plain([w for w in t.split(" ") if w], extraction.PHRASES) for t in texts]


def test_types_by_model_and_keywords(spark, sf):
    import zlib

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    told = {r.doc_id: r for r in QUERIES["m6_type_classifier"](spark, sf).collect()}
    assert all(told[i]["by"] == "given" and told[i]["type"] == lang for i, lang in truth.items() if lang and zlib.crc32(str(i).encode()) % 5)
    held = [i for i, lang in truth.items() if lang and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(told[i]["type"] == truth[i] for i in held) >= 0.9 * len(held) > 10


def test_concepts_choose_and_cover(spark, sf):
    from gridstone.plans import language

    concepts = {"law": ["license", "rights"], "words": ["with", "from", "zzzz"]}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    rows = language.concept_chunks(docs, concepts, topics=4, dims=512).collect()
    for name, words in concepts.items():
        mine = sorted((r for r in rows if r.concept == name), key=lambda r: r.place)
        hits = {i: sum(t.count(w) for w in words) for i, t in texts.items()}
        some = sorted((i for i in hits if hits[i]), key=lambda i: (-hits[i], i))[:20]
        assert 0 < len(mine) <= 4 and {r.doc_id for r in mine} <= set(some) and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        assert all(abs(r.lexical - hits[r.doc_id] / max(hits.values())) < 1e-5 and abs(r.score - 0.4 * r.lexical - 0.6 * r.semantic) < 1e-5 for r in mine)
        assert {r.coverage for r in mine} == {round(100 * sum(any(w in texts[r.doc_id] for r in mine) for w in words) / len(words), 1)}


def test_seasonal_model_continues_a_season():
    import pandas as pd

    from gridstone.plans.models import seasonal

    season = [5.0, -2.0, 0.5, 9.0]
    y = [100 + 3 * i + season[i % 4] for i in range(20)]
    got = seasonal(pd.DataFrame({"zone": "z", "quarter": range(20), "v": y}))
    assert got["step"].tolist() == list(range(-19, 7)) and got["value"].tolist()[:20] == pytest.approx(y)
    assert got["forecast"].tolist()[20:] == pytest.approx([100 + 3 * i + season[i % 4] for i in range(20, 26)], abs=0.01)
    assert seasonal(pd.DataFrame({"zone": "z", "quarter": range(5), "v": range(5)})).empty


def test_segments_are_a_fixed_point_of_k_means(spark, sf):
    """Every city is in the segment whose mean, in standard units, is nearest to it."""
    import numpy as np

    from gridstone.functions.stats import median
    from gridstone.plans.base import listings

    rows = {r.city: (r.price, r.ppm2) for r in listings(spark, sf).groupBy("city").agg(median("price").alias("price"), median("ppm2").alias("ppm2")).collect()}
    cell = {r.city: r.segment for r in QUERIES["m7_segments"](spark, sf).collect()}
    x = np.array([rows[c] for c in sorted(rows)])
    x, k = (x - x.mean(0)) / x.std(0, ddof=1), np.array([cell[c] for c in sorted(rows)])
    centres = {s: x[k == s].mean(0) for s in set(k.tolist())}
    assert 2 <= len(centres) <= 4
    assert all(min(centres, key=lambda s: ((p - centres[s]) ** 2).sum()) == s for p, s in zip(x, k.tolist()))


def test_chunks_of_a_cell_are_its_best(spark, sf):
    got = QUERIES["m16_hybrid_chunks"](spark, sf).collect()
    cells = {}
    for r in sorted(got, key=lambda r: r.place):
        cells.setdefault(r.cell, []).append(r)
    assert len({r.doc_id for r in got}) == len(got)
    assert all(abs(r.score - (0.4 * r.lexical + 0.6 * r.semantic)) < 1e-5 and -1 <= r.semantic <= 1.000001 and 0 <= r.lexical <= 1.000001 for r in got)
    for rows in cells.values():
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 6
        assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_price_models_are_no_worse_than_the_mean(spark, sf):
    scores = {r.metric: r.value for r in QUERIES["m11_price_forest"](spark, sf).collect()}
    assert set(scores) == {"rmse", "r2"} and -0.05 < scores["r2"] <= 1 and scores["rmse"] > 0
    told = QUERIES["r17_price_estimate"](spark, sf).collect()
    assert all(r.low <= r.predicted <= r.high and 0 <= r.confidence <= 100 and r.surface_possible == round(50_000 / (r.predicted / r.surface)) for r in told)


def test_class_chances_are_chances(spark, sf):
    for r in QUERIES["m9_trust_net"](spark, sf).limit(500).collect():
        p = (r.p0, r.p1, r.p2)
        assert abs(sum(p) - 1) < 0.001 and p[r["class"]] >= max(p) - 1e-4
    labels = {r.url: r.l_linestatus for r in spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS url", "l_linestatus").collect()}
    told = QUERIES["m1_trust_classifier"](spark, sf).collect()
    assert all(0 <= r.trust <= 1 and r.reliable == (r.trust >= 0.6) for r in told if abs(r.trust - 0.6) > 1e-4) and {r.url for r in told} <= set(labels)


def test_explanations_add_up(spark, sf):
    told = QUERIES["m10_tree_shap"](spark, sf).limit(400).collect()
    assert told and all(abs(r.base + r.total - r.trust) < 1e-5 for r in told)
    for r in told:
        for side, sign in ((r.raised, 1), (r.lowered, -1)):
            values = [sign * x["value"] for x in side]
            assert len(side) <= 3 and values == sorted(values, reverse=True) and all(v >= 0.005 for v in values)


def test_isolation_scores_and_bands(spark, sf):
    from gridstone.plans.base import listings
    from gridstone.plans.models import isolated

    x = listings(spark, sf).select("url", "price", "surface").union(spark.createDataFrame([(-1, None, None), (-2, 1e9, 900.0)], "url long, price double, surface double"))
    got = isolated(x, ["price", "surface"], n=40, size=64).collect()
    score = {r.url: r.score for r in got}
    assert score[-2] == max(score.values()) and score[-1] < score[-2]
    assert all(r.severity == ("critical" if r.score > 0.6 else "high" if r.score > 0.4 else "low") for r in got)
    assert 0 < sum(r.anomaly for r in got) <= 0.05 * len(got) + 1


def test_hybrid_scores_are_means_behind_gates(spark):
    from gridstone.plans.composites import hybrid_compliance

    cases = spark.createDataFrame([(1, "tenant", "paint the wall", "", "paint"), (2, "owner", "sell house", "house", ""), (3, "stranger", "fly", "", "")], "id int, actor string, action string, target string, terms string")
    rules = [(1, "tenant", "paint the wall", "flat", "permitted"), (2, "owner", "sell the house", "house", "prohibited"), (3, "tenant", "sell flat", "flat", "prohibited"), (4, "owner", "paint a wall", "house", "obligation"), (5, "guard", "close gate", "gate", "permitted")]
    got = {(r.id, r.rule): r for r in hybrid_compliance(cases, spark.createDataFrame(rules, "rule int, actor string, action string, target string, status string"), least=0.3, topics=3, dims=256).collect()}
    assert (1, 1) in got and (2, 2) in got and not any(i == 3 for i, _ in got)
    for (i, k), r in got.items():
        assert abs(r.score - ((r.lexical + r.meaning) / 2 if r.meaning > 0 else r.lexical)) < 1e-5 and r.score >= 0.3
        assert rules[k - 1][1] == {1: "tenant", 2: "owner"}[i]
    assert got[1, 1].met and got[1, 1].lexical == pytest.approx(0.4 + 0.45 + 0.15 * 0.5)
