"""Reports and records in full: what the shorter queries of the same ids leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, grouped_quantiles, share
from ..functions.text import how_many
from .aggregates import _MONTHS, monthly
from .base import listings, query, r, table
from .composites import _TRUST_SQL, trusted
from .scoring import _ZONES, clamp

_KEYS = ["url", "part", "seller"]


def joined_top(df: DataFrame, name: str, count: str, top: int, out: str) -> DataFrame:
    """One row: the names of the ``top`` rows by count, as one text."""
    few = df.orderBy(F.desc(count), name).limit(top)
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("c"), F.col(name).alias("x")))), lambda s: s["x"]), ", ").alias(out))


@query(_TRUST_SQL + ", top AS (SELECT city, count(*) AS n FROM listing GROUP BY city ORDER BY n DESC, city LIMIT 5) SELECT count(*) AS n, round(avg(ppm2), 2) AS mean, round(median(ppm2), 2) AS med, round(quantile_cont(ppm2, 0.1), 2) AS p10, round(quantile_cont(ppm2, 0.9), 2) AS p90, count(DISTINCT city) AS cities, (SELECT array_to_string(list(city ORDER BY n DESC, city), ', ') FROM top) AS top_cities, round(avg(trust), 4) AS mean_trust, round(avg((trust < 0.6)::INT), 4) AS suspect_share, round(avg((abs(t.ppm2 / t.med - 1) > 0.5)::INT), 4) AS anomaly_share FROM t", True)
def a23_report_figures(spark: SparkSession, d: str) -> DataFrame:
    """Prices a square metre, coverage, the five largest cities, and the shares of suspects and anomalies."""
    x = trusted(listings(spark, d))
    mid, low, high = exact_quantiles(x, "ppm2", 0.5, 0.1, 0.9)
    one = x.agg(
        F.count("*").alias("n"), r(F.avg("ppm2"), 2).alias("mean"), *(r(F.lit(v).cast("double"), 2).alias(c) for c, v in (("med", mid), ("p10", low), ("p90", high))), F.count_distinct("city").alias("cities"), r(F.avg("trust")).alias("mean_trust"),
        share(F.col("trust") < 0.6).alias("suspect_share"), share(F.abs(F.try_divide("ppm2", "med") - 1) > 0.5).alias("anomaly_share"),
    )
    return one.crossJoin(F.broadcast(joined_top(x.groupBy("city").count(), "city", "count", 5, "top_cities")))


_RATES = "WITH l AS (SELECT avg((quality = 0)::INT) AS q, avg((toxic = 1)::INT) AS h FROM labels), d AS (SELECT 1 - count(DISTINCT text) / count(text) AS dup, avg((NOT contains(lower(text), 'license'))::INT) AS a FROM documents WHERE text IS NOT NULL), s AS (SELECT *, greatest(0, round(100 - 50 * h - 20 * dup - 15 * q - 15 * a)) AS score FROM l, d)"


@query(_RATES + " SELECT round(h, 4) AS wrong, round(dup, 4) AS duplicates, round(q, 4) AS low_quality, round(a, 4) AS no_article, score::DOUBLE AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade, CASE WHEN h > 0.30 THEN 'critical' WHEN h > 0.15 THEN 'high' WHEN h > 0.05 THEN 'acceptable' ELSE 'good' END AS verdict FROM s")
def a25_full_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Rates of wrong, duplicate, poor and unsupported texts (here: toxic, equal, low-quality, without the word 'license'), their score, grade and verdict."""
    rate = lambda c: F.avg(c.cast("int"))
    label = table(spark, d, "labels").agg(rate(F.col("quality") == 0).alias("q"), rate(F.col("toxic") == 1).alias("h"))
    text = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"), F.max((~F.lower("text").contains("license")).cast("int")).alias("bare"))
    docs = text.agg((1 - F.count("*") / F.sum("n")).alias("dup"), (F.sum(F.col("n") * F.col("bare")) / F.sum("n")).alias("a"))
    x = label.crossJoin(F.broadcast(docs)).withColumn("score", F.greatest(F.lit(0.0), F.round(100 - 50 * F.col("h") - 20 * F.col("dup") - 15 * F.col("q") - 15 * F.col("a"))))
    s, h = F.col("score"), F.col("h")
    return x.select(r("h").alias("wrong"), r("dup").alias("duplicates"), r("q").alias("low_quality"), r("a").alias("no_article"), "score", F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 55, "C").otherwise("D").alias("grade"), F.when(h > 0.30, "critical").when(h > 0.15, "high").when(h > 0.05, "acceptable").otherwise("good").alias("verdict"))


@query("SELECT coalesce(source, 'none') AS source, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def a25_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy(F.coalesce("source", F.lit("none")).alias("source"), "quality", "toxic").agg(F.count("*").alias("n"))


_FLAGS = "list_filter([CASE WHEN ppm2 < 0.3 * med THEN 'very low' END, CASE WHEN ppm2 > 4 * med THEN 'very high' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN surface IS NULL OR surface <= 1 THEN 'no surface' END], lambda x: x IS NOT NULL)"


@query(_TRUST_SQL + f", k AS (SELECT count(*) FILTER (trust >= 0.75) AS reliable, count(*) FILTER (trust >= 0.5 AND trust < 0.75) AS fair, count(*) FILTER (trust < 0.5) AS suspects, round(avg(trust), 4) AS mean_trust, round(100 * avg((trust < 0.5)::INT), 2) AS suspect_pct FROM t) SELECT url, part, seller, city, trust, array_to_string({_FLAGS}, ', ') AS flags, reliable, fair, suspects, mean_trust, suspect_pct, CASE WHEN suspect_pct > 30 THEN 'stop' WHEN suspect_pct > 10 THEN 'review' ELSE 'go on' END AS advice FROM t, k WHERE trust < 0.5 ORDER BY trust, url, part, seller LIMIT 20", True)
def a36_suspects(spark: SparkSession, d: str) -> DataFrame:
    """The twenty least trusted listings with their flags, beside the whole batch's tiers and what to do."""
    x = trusted(listings(spark, d))
    t = F.col("trust")
    k = x.agg(F.count_if(t >= 0.75).alias("reliable"), F.count_if((t >= 0.5) & (t < 0.75)).alias("fair"), F.count_if(t < 0.5).alias("suspects"), r(F.avg("trust")).alias("mean_trust"), r(100 * F.avg((t < 0.5).cast("int")), 2).alias("suspect_pct"))
    flags = F.filter(F.array(F.when(F.col("ppm2") < 0.3 * F.col("med"), "very low"), F.when(F.col("ppm2") > 4 * F.col("med"), "very high"), F.when(F.col("price").isNull(), "no price"), F.when(F.col("surface").isNull() | (F.col("surface") <= 1), "no surface")), lambda v: v.isNotNull())
    worst = x.where(t < 0.5).orderBy("trust", *_KEYS).limit(20).crossJoin(F.broadcast(k))
    pct = F.col("suspect_pct")
    return worst.select(*_KEYS, "city", "trust", F.array_join(flags, ", ").alias("flags"), "reliable", "fair", "suspects", "mean_trust", "suspect_pct", F.when(pct > 30, "stop").when(pct > 10, "review").otherwise("go on").alias("advice"))


_AXES = {"price": "median(price) / 1000", "surface": "avg(surface)", "rooms": "avg(rooms)", "variety": "count(DISTINCT property_type) * 10", "supply": "count(*) / 100"}


@query(", z AS (SELECT city, " + ", ".join(f"{e} AS {a}" for a, e in _AXES.items()) + " FROM listing WHERE city IN ('NATION_1', 'NATION_2') GROUP BY city), u AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, city, {a} AS v FROM z" for a in _AXES) + f" UNION ALL SELECT 'score', city, round(({' + '.join(_AXES)}) / 5) FROM z) SELECT axis, round(max(v) FILTER (city = 'NATION_1'), 2) AS first_zone, round(max(v) FILTER (city = 'NATION_2'), 2) AS second_zone FROM u GROUP BY axis", True)
def a34_compare_zones(spark: SparkSession, d: str) -> DataFrame:
    """Two zones axis by axis, and their scores, the rounded means of the five."""
    x = listings(spark, d).where("city in ('NATION_1', 'NATION_2')")
    z = x.groupBy("city").agg(F.avg("surface").alias("surface"), F.avg("rooms").alias("rooms"), (F.count_distinct("property_type") * 10).cast("double").alias("variety"), (F.count("*") / 100).alias("supply"))
    z = z.join(grouped_quantiles(x, ["city"], {"price": ("price", 0.5)}), "city").withColumn("price", F.col("price") / 1000)
    z = z.withColumn("score", F.round(sum((F.col(a) for a in _AXES), F.lit(0.0)) / 5))
    u = z.unpivot(["city"], [*_AXES, "score"], "axis", "v")
    return u.groupBy("axis").pivot("city", ["NATION_1", "NATION_2"]).agg(r(F.max("v"), 2)).select("axis", F.col("NATION_1").alias("first_zone"), F.col("NATION_2").alias("second_zone"))


@query(_MONTHS + "SELECT zone, round(first(med ORDER BY month), 2) AS first_price, round(last(med ORDER BY month), 2) AS last_price, round((last(med ORDER BY month) / first(med ORDER BY month) - 1) * 100, 1) AS change FROM m WHERE zone IN ('NATION_1', 'NATION_2') GROUP BY zone")
def a35_zone_change(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.min_by("med", "month"), F.max_by("med", "month")
    return monthly(spark, d).where("zone in ('NATION_1', 'NATION_2')").groupBy("zone").agg(r(a, 2).alias("first_price"), r(b, 2).alias("last_price"), r((b / a - 1) * 100, 1).alias("change"))


_EXPECTED = [("src0", 100, 0.02, 0.95), ("src1", 150, 0.05, 0.90), ("src2", 100, 0.05, 0.99), ("src3", 5000, 0.10, 0.50)]


@query(
    "WITH e(source, least, lost, placed) AS (VALUES " + ", ".join(map(str, _EXPECTED)) + "), s AS (SELECT source, count(*) AS n, avg((text IS NULL OR text = '')::INT) AS lost, avg((lang IS NOT NULL)::INT) AS placed FROM documents GROUP BY source), "
    "j AS (SELECT e.source, coalesce(n, 0) AS n, s.lost, s.placed, coalesce((s.n >= e.least)::INT, 0) + coalesce((s.lost <= e.lost)::INT, 0) + coalesce((s.placed >= e.placed)::INT, 0) AS met FROM e LEFT JOIN s USING (source)) "
    "SELECT source, n, round(lost, 4) AS empty_rate, round(placed, 4) AS known_rate, met::BIGINT AS met, CASE WHEN n = 0 THEN 'down' WHEN met = 3 THEN 'healthy' WHEN met = 2 THEN 'warning' ELSE 'unhealthy' END AS status, round(avg(100.0 * met / 3) OVER (), 1) AS global_score FROM j"
)
def a22_source_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Each expected source's volume, empty and known rates against what is expected of it, its status, and the mean score of all."""
    e = spark.createDataFrame(_EXPECTED, "source string, least long, lost double, placed double")
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("text").isNull() | (F.col("text") == "")).cast("int")).alias("empty"), F.avg(F.col("lang").isNotNull().cast("int")).alias("known"))
    j = e.join(s, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    j = j.withColumn("met", (one(F.col("n") >= F.col("least")) + one(F.col("empty") <= F.col("lost")) + one(F.col("known") >= F.col("placed"))).cast("long"))
    status = F.when(F.col("n") == 0, "down").when(F.col("met") == 3, "healthy").when(F.col("met") == 2, "warning").otherwise("unhealthy")
    return j.select("source", "n", r("empty").alias("empty_rate"), r("known").alias("known_rate"), "met", status.alias("status"), r(F.avg(100.0 * F.col("met") / 3).over(Window.partitionBy()), 1).alias("global_score"))  # a row an expected source


_SELLER = (
    "WITH p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\(([0-9]{3})\\)', 1))) AS code FROM documents), c AS (SELECT code, count(DISTINCT doc_id) AS n FROM p GROUP BY code), m AS (SELECT doc_id, max(n) AS most FROM p JOIN c USING (code) GROUP BY doc_id), "
    "x AS (SELECT doc_id, lower(text) AS t, source, n_chars, coalesce(most, 0) AS most FROM documents LEFT JOIN m USING (doc_id) WHERE text IS NOT NULL)"
)


@query(_SELLER + " SELECT doc_id, most, CASE WHEN most > 10 THEN 'agency' WHEN most > 3 THEN 'trader' ELSE 'private' END AS kind, CASE WHEN contains(t, 'offer') OR contains(t, 'any') THEN 0.75 ELSE CASE WHEN n_chars > 4000 THEN 0.65 WHEN n_chars > 1000 THEN 0.45 ELSE 0.3 END END::DOUBLE AS negotiation, round(greatest(0, least(1, 0.5 + CASE WHEN source = 'src0' THEN 0.25 ELSE 0 END + CASE WHEN most > 10 THEN 0.10 WHEN most > 3 THEN 0.05 ELSE 0 END + CASE WHEN length(t) > 300 THEN 0.15 WHEN length(t) > 100 THEN 0.08 ELSE 0 END + CASE WHEN contains(t, 'license') THEN 0.15 ELSE 0 END + CASE WHEN contains(t, '@') THEN 0.05 ELSE 0 END)), 3)::DOUBLE AS seriousness FROM x")
def r10_seller_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each text's seller by how often its numbers occur over all texts, with how negotiable and how serious it sounds."""
    docs = table(spark, d, "documents").where("text is not null")
    p = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(([0-9]{3})\)"), 1))).alias("code"))
    m = p.join(p.groupBy("code").agg(F.count_distinct("doc_id").alias("n")), "code").groupBy("doc_id").agg(F.max("n").alias("most"))
    x = docs.select("doc_id", F.lower("text").alias("t"), "source", "n_chars").join(m, "doc_id", "left").withColumn("most", F.coalesce("most", F.lit(0)))
    most, t, size = F.col("most"), F.col("t"), F.length("t")
    talk = F.when(t.contains("offer") | t.contains("any"), 0.75).otherwise(F.when(F.col("n_chars") > 4000, 0.65).when(F.col("n_chars") > 1000, 0.45).otherwise(0.3))
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    serious = 0.5 + plus(F.col("source") == "src0", 0.25) + F.when(most > 10, 0.10).when(most > 3, 0.05).otherwise(0.0) + F.when(size > 300, 0.15).when(size > 100, 0.08).otherwise(0.0) + plus(t.contains("license"), 0.15) + plus(t.contains("@"), 0.05)
    return x.select("doc_id", "most", F.when(most > 10, "agency").when(most > 3, "trader").otherwise("private").alias("kind"), talk.alias("negotiation"), r(clamp(serious), 3).alias("seriousness"))


_LEVELS = "CASE WHEN score >= 0.65 THEN 'excellent' WHEN score >= 0.50 THEN 'good' WHEN score >= 0.35 THEN 'fair' ELSE 'weak' END"


@query(", z(region, g, dem, inf, risk) AS (VALUES " + ", ".join(map(str, _ZONES)) + "), m AS (SELECT region, median(ppm2) AS med FROM listing GROUP BY region), s AS (SELECT z.*, med, round(greatest(0, least(1, 10 * g * 0.35 + dem * 0.30 + inf * 0.20 - risk * 1.5 * 0.15)), 3)::DOUBLE AS score FROM z LEFT JOIN m USING (region)) SELECT region, round(med, 2) AS median_ppm2, round(80 * med, 2) AS usual_price, score, " + _LEVELS + " AS level, CASE WHEN g >= 0.05 THEN 'short' WHEN g >= 0.03 THEN 'medium' ELSE 'long' END AS horizon, CASE WHEN dem >= 0.8 THEN 'rent' WHEN inf >= 0.8 THEN 'resale' ELSE 'land' END AS kind FROM s WHERE med IS NULL OR 80 * med <= 180000", True)
def r13_ranked_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones whose usual listing of 80 square metres the budget covers, for a careful buyer (risk counts one and a half times), with level, horizon and kind."""
    z = spark.createDataFrame(_ZONES, "region string, g double, dem double, inf double, risk double")
    x = z.join(grouped_quantiles(listings(spark, d), ["region"], {"med": ("ppm2", 0.5)}), "region", "left").where("med is null or 80 * med <= 180000")
    x = x.withColumn("score", r(clamp(10 * F.col("g") * 0.35 + F.col("dem") * 0.30 + F.col("inf") * 0.20 - F.col("risk") * 1.5 * 0.15), 3))
    s, g = F.col("score"), F.col("g")
    level = F.when(s >= 0.65, "excellent").when(s >= 0.50, "good").when(s >= 0.35, "fair").otherwise("weak")
    return x.select("region", r("med", 2).alias("median_ppm2"), r(80 * F.col("med"), 2).alias("usual_price"), "score", level.alias("level"), F.when(g >= 0.05, "short").when(g >= 0.03, "medium").otherwise("long").alias("horizon"), F.when(F.col("dem") >= 0.8, "rent").when(F.col("inf") >= 0.8, "resale").otherwise("land").alias("kind"))


@query(", c AS (SELECT city, median(price) AS med, count(*) AS n FROM listing GROUP BY city), g AS (SELECT median(price) AS nat FROM listing) SELECT city, n, round(med, 2) AS median_price, CASE WHEN med < 0.97 * nat THEN 'buy' WHEN med > 1.03 * nat THEN 'wait' ELSE 'hold' END AS verdict, round(med / 40000, 4) AS share_of_budget FROM c, g WHERE med <= 1.3 * 40000 ORDER BY med, city LIMIT 3", True)
def r20_affordable_zones(spark: SparkSession, d: str) -> DataFrame:
    """The three cheapest cities within 1.3 times the budget, with a verdict against the nation's median."""
    x = listings(spark, d)
    nat = F.lit(exact_quantiles(x, "price", 0.5)[0]).cast("double")
    c = grouped_quantiles(x, ["city"], {"med": ("price", 0.5)}).join(x.groupBy("city").agg(F.count("*").alias("n")), "city").where("med <= 1.3 * 40000").orderBy("med", "city").limit(3)
    m = F.col("med")
    return c.select("city", "n", r("med", 2).alias("median_price"), F.when(m < 0.97 * nat, "buy").when(m > 1.03 * nat, "wait").otherwise("hold").alias("verdict"), r(m / 40000).alias("share_of_budget"))


@query(", g AS (SELECT surface, city, property_type, seen, count(*) AS n, count(DISTINCT source) AS s FROM listing GROUP BY ALL) SELECT count(*) FILTER (n > 1 AND s > 1) AS groups, coalesce(sum(n) FILTER (n > 1 AND s > 1), 0)::BIGINT AS affected, round(100 * coalesce(sum(n) FILTER (n > 1 AND s > 1), 0) / sum(n), 2) AS pct FROM g", True)
def j15_affected_share(spark: SparkSession, d: str) -> DataFrame:
    g = listings(spark, d).groupBy("surface", "city", "property_type", "seen").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    twice = (F.col("n") > 1) & (F.col("s") > 1)
    hit = F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0))
    return g.agg(F.count_if(twice).alias("groups"), hit.alias("affected"), r(100 * hit / F.sum("n"), 2).alias("pct"))


_SORTS = {"cheapest": "price", "dearest": "price DESC", "most trusted": "trust DESC", "cheapest a square metre": "ppm2"}


@query(_TRUST_SQL + ", f AS (SELECT * FROM t WHERE (contains(lower(title), 'widget') OR contains(lower(city), '_4')) AND price BETWEEN 5000 AND 60000 AND surface BETWEEN 10 AND 45 AND property_type = 'LARGE' AND trust >= 0.6) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS sorted, row_number() OVER (ORDER BY {o}, url, part, seller) AS place, url, part, seller, price, trust, round(ppm2, 4) AS ppm2 FROM f ORDER BY {o}, url, part, seller LIMIT 20)" for n, o in _SORTS.items()), True)
def f5_sorted_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a search in each of the four orders."""
    low = lambda c: F.lower(c)
    f = trusted(listings(spark, d)).where((low("title").contains("widget") | low("city").contains("_4")) & F.col("price").between(5000, 60000) & F.col("surface").between(10, 45) & (F.col("property_type") == "LARGE") & (F.col("trust") >= 0.6))
    pages = None
    for name, order in _SORTS.items():
        keys = [F.desc(order.split()[0]) if order.endswith("DESC") else F.col(order), *_KEYS]
        page = f.orderBy(*keys).limit(20).withColumns({"sorted": F.lit(name), "place": F.row_number().over(Window.orderBy(*keys)).cast("long")})  # of one page
        pages = page if pages is None else pages.unionByName(page)
    return pages.select("sorted", "place", *_KEYS, "price", "trust", r("ppm2").alias("ppm2"))


@query("SELECT 'CREATE (:Source {name: ''' || source || '''})' AS statement, 1 AS part FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) UNION ALL SELECT 'CREATE (:Language {name: ''' || lang || '''})', 2 FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) UNION ALL SELECT 'MATCH (a:Source {name: ''' || source || '''}), (b:Language {name: ''' || lang || '''}) CREATE (a)-[:WRITES {texts: ' || n || '}]->(b)', 3 FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)")
def k12_graph_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a graph language for nodes and edges, in three parts that are run in order."""
    x = table(spark, d, "documents")
    node = lambda c, kind, part: x.where(F.col(c).isNotNull()).select(c).distinct().select(F.format_string(f"CREATE (:{kind} {{name: '%s'}})", c).alias("statement"), F.lit(part).alias("part"))
    edges = x.where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    edge = F.format_string("MATCH (a:Source {name: '%s'}), (b:Language {name: '%s'}) CREATE (a)-[:WRITES {texts: %d}]->(b)", "source", "lang", "n")
    return node("source", "Source", 1).union(node("lang", "Language", 2)).union(edges.select(edge.alias("statement"), F.lit(3).alias("part")))


@query("WITH a AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('view', 'purchase', 'click') GROUP BY ALL), g AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'click' AND value > 60) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = a.user_id AND g.event_type = a.event_type)")
def k6_portfolio_list(spark: SparkSession, d: str) -> DataFrame:
    """What each user holds after additions (the first of a key counts) and removals, the newest first."""
    e = table(spark, d, "events")
    added = e.where("event_type in ('view', 'purchase', 'click')").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    removed = e.where("event_type = 'click' and value > 60").select("user_id", "event_type").distinct()
    return added.join(removed, ["user_id", "event_type"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long"))


@query("WITH x AS (SELECT p_size::DOUBLE AS truth, p_size * (1 + (p_partkey % 9 - 4) / 50.0) AS said, p_type AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'OTHER' WHEN p_partkey % 11 <> 0 THEN p_type END AS kind_said, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE split_part(p_name, ' ', 1) END AS name_said FROM part), f AS (SELECT 'surface' AS field, said IS NOT NULL AS found, abs(said - truth) <= 0.05 * truth AS ok FROM x UNION ALL SELECT 'price', said IS NOT NULL, abs(said - truth) <= 0.10 * truth FROM x UNION ALL SELECT 'type', kind_said IS NOT NULL, coalesce(kind_said = kind, FALSE) FROM x UNION ALL SELECT 'city', name_said IS NOT NULL, coalesce(contains(name, name_said), FALSE) FROM x), m AS (SELECT field, count(*) AS n, count(*) FILTER (found) AS extracted, count(*) FILTER (ok) AS correct, avg(ok::INT) AS rate FROM f GROUP BY field) SELECT field, n, extracted, correct, round(rate, 4) AS rate, round(avg(rate) OVER (), 4) AS macro FROM m")
def a29_field_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Extracted against known values by field: within 5 or 10 percent, equal, or contained; and the mean over fields."""
    p, size = table(spark, d, "part"), F.col("p_size").cast("double")
    said = F.col("p_size") * (1 + (F.col("p_partkey") % 9 - 4) / 50.0)
    kind = F.when(F.col("p_partkey") % 4 == 0, "OTHER").when(F.col("p_partkey") % 11 != 0, F.col("p_type"))
    name = F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.substring_index("p_name", " ", 1))
    one = lambda field, value, good: F.struct(F.lit(field).alias("field"), value.isNotNull().alias("found"), F.coalesce(good, F.lit(False)).alias("ok"))
    gap = F.abs(said - size)
    x = p.select(F.explode(F.array(one("surface", said, gap <= 0.05 * size), one("price", said, gap <= 0.10 * size), one("type", kind, kind == F.col("p_type")), one("city", name, F.contains(F.col("p_name"), name)))).alias("x")).select("x.*")
    m = x.groupBy("field").agg(F.count("*").alias("n"), F.count_if("found").alias("extracted"), F.count_if("ok").alias("correct"), F.avg(F.col("ok").cast("int")).alias("rate"))
    return m.select("field", "n", "extracted", "correct", r("rate").alias("rate"), r(F.avg("rate").over(Window.partitionBy())).alias("macro"))  # a row a field


STEPS = ("cleaning", "fuzzy", "nlp", "scoring", "store")


@query(_TRUST_SQL + " SELECT url, part, seller, left(sha256(concat_ws('|', url::VARCHAR, part::VARCHAR, seller::VARCHAR, city, property_type)), 12) AS row_hash, 5::BIGINT AS n_steps, '[' || '{\"step\":\"cleaning\",\"kept\":' || (price BETWEEN 1000 AND 1e7) || '},{\"step\":\"fuzzy\",\"key\":\"' || city || '\"},{\"step\":\"nlp\",\"field\":\"' || property_type || '\"},{\"step\":\"scoring\",\"reliable\":' || (trust >= 0.6) || '},{\"step\":\"store\",\"source\":\"' || source || '\"}]' AS chain FROM t", True)
def b17_lineage_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each row's hash and the chain of its five steps, built by appending to a list of JSON objects."""
    x = trusted(listings(spark, d))
    made = {"cleaning": F.col("price").between(1000, 1e7).alias("kept"), "fuzzy": F.col("city").alias("key"), "nlp": F.col("property_type").alias("field"), "scoring": (F.col("trust") >= 0.6).alias("reliable"), "store": F.col("source")}
    x = x.withColumn("chain", F.array().cast("array<string>"))
    for step in STEPS:
        x = x.withColumn("chain", F.array_append("chain", F.to_json(F.struct(F.lit(step).alias("step"), made[step]))))
    row = F.left(F.sha2(F.concat_ws("|", *_KEYS, "city", "property_type"), 256), F.lit(12))
    return x.select(*_KEYS, row.alias("row_hash"), F.size("chain").cast("long").alias("n_steps"), F.concat(F.lit("["), F.array_join("chain", ","), F.lit("]")).alias("chain"))


@query("WITH s AS (SELECT event_id, to_json([{'step': event_type, 'k': json_extract_string(props, '$.k')::BIGINT}]) AS chain FROM events), a AS (SELECT event_id, left(chain, length(chain) - 1) || ',{\"step\":\"archived\",\"k\":' || event_id || '}]' AS chain FROM s) SELECT event_id, json_array_length(chain)::BIGINT AS steps, json_extract_string(chain, '$[0].step') AS first_step, json_extract_string(chain, '$[0].k')::BIGINT AS first_k, json_extract_string(chain, '$[1].step') AS last_step, json_extract_string(chain, '$[1].k')::BIGINT AS last_k FROM a")
def x28_chain_append(spark: SparkSession, d: str) -> DataFrame:
    """A row's JSON chain of steps: written, read again, given one more step, and read once more."""
    kind = "array<struct<step:string,k:bigint>>"
    k = F.from_json("props", "k long").getField("k")
    e = table(spark, d, "events").select("event_id", F.to_json(F.array(F.struct(F.col("event_type").alias("step"), k.alias("k")))).alias("chain"))
    longer = e.withColumn("chain", F.to_json(F.array_append(F.from_json("chain", kind), F.struct(F.lit("archived").alias("step"), F.col("event_id").alias("k")))))
    c = F.from_json("chain", kind)
    first, last = F.element_at(c, 1), F.element_at(c, -1)
    return longer.select("event_id", F.size(c).cast("long").alias("steps"), first["step"].alias("first_step"), first["k"].alias("first_k"), last["step"].alias("last_step"), last["k"].alias("last_k"))


_ACTOR = {"en": "english", "fr": "french", "de": "german"}


@query("SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' END, CASE WHEN contains(source, 'src1') THEN 'first' WHEN contains(source, 'src') THEN 'other' END, 'unknown') AS actor, trim(regexp_replace(lower(left(text, 60)), '^(the|der|les|los) +', '')) AS action, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS conditions FROM (SELECT *, list_transform(list_filter(regexp_extract_all(lower(left(text, 200)), '[a-z]+'), lambda w: length(w) >= 4), lambda w: CASE w WHEN 'with' THEN 'and' WHEN 'from' THEN 'since' ELSE w END) AS t FROM documents WHERE text IS NOT NULL)")
def x21_rule_fields(spark: SparkSession, d: str) -> DataFrame:
    """A rule's actor by exact and then contained names, its action without a leading article, and its conditions with synonyms replaced and repeats left out, in order. By survey, of a text's head."""
    actor = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in _ACTOR.items()), F.when(F.col("source").contains("src1"), "first").when(F.col("source").contains("src"), "other"), F.lit("unknown"))
    words = F.filter(F.regexp_extract_all(F.lower(F.left("text", F.lit(200))), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= 4)
    named = F.transform(words, lambda w: F.when(w == "with", "and").when(w == "from", "since").otherwise(w))
    return table(spark, d, "documents").where("text is not null").select("doc_id", actor.alias("actor"), F.trim(F.regexp_replace(F.lower(F.left("text", F.lit(60))), "^(the|der|les|los) +", "")).alias("action"), F.array_join(F.array_distinct(named), " ").alias("conditions"))


_PAIRS = [(("never", "not"), ("always", "must")), (("with",), ("without",)), (("the",), ("les",))]


@query("WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id, w FROM c WHERE turn = 0) SELECT c.conv_id, c.turn, (" + " + ".join(f"((list_has_any(c.w, {list(a)}) AND list_has_any(u.w, {list(b)})) OR (list_has_any(c.w, {list(b)}) AND list_has_any(u.w, {list(a)})))::INT" for a, b in _PAIRS) + ")::BIGINT AS contradictions, round(len(list_filter(list_filter(c.w, lambda x: length(x) >= 4), lambda x: list_contains(u.w, x))) / greatest(len(list_filter(c.w, lambda x: length(x) >= 4)), 1), 4) AS found, len(list_filter(list_filter(c.w, lambda x: length(x) >= 4), lambda x: list_contains(u.w, x))) < 0.4 * len(list_filter(c.w, lambda x: length(x) >= 4)) AS missing FROM c JOIN u USING (conv_id) WHERE c.turn > 0")
def x22_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Answers against their question: paired sets of words that contradict, and whether under 0.4 of the longer words are found there."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    c = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", words.alias("w"))
    u = c.where("turn = 0").select("conv_id", F.col("w").alias("asked"))
    x = c.where("turn > 0").join(u, "conv_id")
    has = lambda col, ws: F.arrays_overlap(col, F.array(*map(F.lit, ws)))
    against = sum((((has("w", a) & has("asked", b)) | (has("w", b) & has("asked", a))).cast("int") for a, b in _PAIRS), F.lit(0))
    long = F.filter("w", lambda v: F.length(v) >= 4)
    met = F.size(F.array_intersect(long, "asked"))
    return x.select("conv_id", "turn", against.cast("long").alias("contradictions"), r(met / F.greatest(F.size(long), F.lit(1))).alias("found"), (met < 0.4 * F.size(long)).alias("missing"))


def field_hits(weights: dict[str, tuple[Column, float]], words: list[str]) -> Column:
    return sum((w * how_many(F.lower(F.coalesce(c, F.lit(""))), words) for c, w in weights.values()), F.lit(0.0))


@query("SELECT page_id, round(3.0 * ((contains(t, 'the')::INT) + contains(t, 'que')::INT) + 2.0 * (contains(u, 'the')::INT + contains(u, 'que')::INT) + 1.0 * (contains(h, 'the')::INT + contains(h, 'que')::INT), 2)::DOUBLE AS score FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, lower(url) AS u, lower(html) AS h FROM pages) WHERE contains(t, 'the') OR contains(t, 'que') OR contains(u, 'the') OR contains(u, 'que') OR contains(h, 'the') OR contains(h, 'que') ORDER BY score DESC, page_id LIMIT 50")
def m19_weighted_search(spark: SparkSession, d: str) -> DataFrame:
    """Question words in a page's title, address and body, by weights of 3, 2 and 1: the best fifty."""
    p = table(spark, d, "pages")
    fields = {"title": (F.regexp_extract("html", "<title>([^<]*)</title>", 1), 3.0), "url": (F.col("url"), 2.0), "html": (F.col("html"), 1.0)}
    s = p.select("page_id", r(field_hits(fields, ["the", "que"]), 2).alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), "page_id").limit(50)


#: Fields of a page's record: what a pattern finds first in its address or text, and how often a tag occurs.
_URL_FIELDS = {"scheme": "^([a-z]+)://", "host": "//([^/]+)", "path": "//[^/]+(/[^?#]*)", "query": "[?]([^#]*)", "fragment": "#(.*)$", "number": "/([0-9]+)"}
_HTML_FIELDS = {"lang": '<html lang="([a-z]+)"', "charset": 'charset="([^"]+)"', "title": "<title>([^<]*)</title>", "heading": "<h1>([^<]*)</h1>", "notice": '<div class="ad">([^<]*)</div>', "style": "<style>([^<]*)</style>", "first_link": '<a href="([^"]*)"'}
_COUNTS = {"links": "<a href=", "paragraphs": "<p>", "items": "<li>", "lists": "<ul>", "images": "<img", "scripts": "<script", "comments": "<!--", "bolds": "<b>", "breaks": "<br", "entities": "&[a-z]+;", "boxes": "<div", "articles": "<article", "menus": "<nav", "headings": "<h[1-6]>", "tables": "<table"}


@query("SELECT page_id, " + ", ".join(f"trim(regexp_extract({c}, '{p}', 1)) AS {n}" for c, fs in (("url", _URL_FIELDS), ("html", _HTML_FIELDS)) for n, p in fs.items()) + ", " + ", ".join(f"len(regexp_extract_all(html, '{p}'))::BIGINT AS {n}" for n, p in _COUNTS.items()) + ", length(html)::BIGINT AS n_chars FROM pages")
def s16_page_record(spark: SparkSession, d: str) -> DataFrame:
    """A page as one record of 30 fields, read in one pass over its text; a field that isn't there is empty."""
    found = [F.trim(F.regexp_extract(c, p, 1)).alias(n) for c, fs in (("url", _URL_FIELDS), ("html", _HTML_FIELDS)) for n, p in fs.items()]
    counted = [F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long").alias(n) for n, p in _COUNTS.items()]
    return table(spark, d, "pages").select("page_id", *found, *counted, F.length("html").cast("long").alias("n_chars"))
