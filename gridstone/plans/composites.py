"""Composite runs, report bundles, agents' answers and rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantic
from ..functions.stats import median, narrow_quantiles, share, with_quantiles
from ..functions.text import cosine, how_many, jaccard, tokens
from ..session import stored
from .base import listings, query, r, table
from .scoring import clamp

AS_OF = "2001-12-01"
_TRUST_SQL = ", c AS (SELECT city, median(ppm2) AS med, stddev(ppm2) AS sd FROM listing GROUP BY city), t AS (SELECT listing.*, med, round(0.7 * greatest(0, 1 - abs(ppm2 - med) / sd / 4) + 0.3 * CASE source WHEN 'A' THEN 0.92 WHEN 'N' THEN 0.78 ELSE 0.65 END, 4) AS trust FROM listing JOIN c USING (city))"


def trusted(df: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Listings with ``med`` (their city's median price a square metre) and ``trust`` (price coherence and source). ``cities`` (city, med, sd), a row each, can be given."""
    c = df.groupBy("city").agg(median("ppm2").alias("med"), F.stddev_samp("ppm2").alias("sd")) if cities is None else F.broadcast(cities)
    coherent = F.greatest(F.lit(0.0), 1 - F.abs(F.col("ppm2") - F.col("med")) / F.col("sd") / 4)
    source = F.when(F.col("source") == "A", 0.92).when(F.col("source") == "N", 0.78).otherwise(0.65)
    return df.join(c, "city").withColumn("trust", r(0.7 * coherent + 0.3 * source)).drop("sd")


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# filters and joins -------------------------------------------------------------------------------------------


@query(_TRUST_SQL + " SELECT url, part, seller, trust FROM t WHERE trust < 0.6 ORDER BY trust, url, part, seller", True)
def f6_suspicious(spark: SparkSession, d: str) -> DataFrame:
    return trusted(listings(spark, d)).where("trust < 0.6").select("url", "part", "seller", "trust").orderBy("trust", "url", "part", "seller")


_DAYS = f"date_diff('day', seen::DATE, DATE '{AS_OF}')"


def days() -> Column:
    return F.date_diff(F.lit(AS_OF).cast("date"), F.to_date("seen"))


@query(_TRUST_SQL + f" SELECT url, part, seller, {_DAYS} AS days, CASE WHEN {_DAYS} > 1500 THEN 0.90 WHEN {_DAYS} > 800 THEN 0.65 ELSE 0.45 END::DOUBLE AS negotiation FROM t WHERE {_DAYS} > 60 AND trust >= 0.85 ORDER BY negotiation DESC, url, part, seller", True)
def f15_opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Trusted listings that have stood for long, the most negotiable first."""
    x = trusted(listings(spark, d)).withColumn("days", days()).where("days > 60 and trust >= 0.85")
    return x.select("url", "part", "seller", "days", F.when(F.col("days") > 1500, 0.90).when(F.col("days") > 800, 0.65).otherwise(0.45).alias("negotiation")).orderBy(F.desc("negotiation"), "url", "part", "seller")


@query(", m AS (SELECT max(seen) AS top FROM listing), w AS (SELECT city, price, seen > top - INTERVAL 365 DAY AS recent FROM listing, m WHERE seen > top - INTERVAL 730 DAY) SELECT city, count(*) FILTER (recent) AS n_recent, count(*) FILTER (NOT recent) AS n_before, round(median(price) FILTER (recent), 4) AS med_recent, round(median(price) FILTER (NOT recent), 4) AS med_before FROM w GROUP BY city", True)
def j6_period_over_period(spark: SparkSession, d: str) -> DataFrame:
    """Two periods side by side by one conditional aggregation, which equals the full outer join of their aggregates."""
    x = listings(spark, d)
    w = x.crossJoin(F.broadcast(x.agg(F.max("seen").alias("top")))).where("seen > top - interval 730 days").withColumn("recent", F.expr("seen > top - interval 365 days"))
    recent, before = F.col("recent"), ~F.col("recent")
    pick = lambda when: r(median(F.when(when, F.col("price"))))
    return w.groupBy("city").agg(F.count_if(recent).alias("n_recent"), F.count_if(before).alias("n_before"), pick(recent).alias("med_recent"), pick(before).alias("med_before"))


@query(", g AS (SELECT region, median(ppm2) AS base, regr_slope(ppm2, epoch(seen) / 86400) AS trend FROM listing GROUP BY region) SELECT n_name AS zone, round(base * (0.8 + n_nationkey % 5 * 0.1), 2) AS price, CASE WHEN trend > 0.01 THEN 'up' WHEN trend < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM nation JOIN region ON r_regionkey = n_regionkey JOIN g ON g.region = r_name", True)
def j17_zone_reference(spark: SparkSession, d: str) -> DataFrame:
    """Static zones scaled by their region's real price, with its trend."""
    g = listings(spark, d).groupBy("region").agg(median("ppm2").alias("base"), F.regr_slope("ppm2", F.unix_timestamp("seen") / 86400).alias("slope"))
    zones = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    trend = F.when(F.col("slope") > 0.01, "up").when(F.col("slope") < -0.01, "down").otherwise("flat")
    return zones.join(g, F.col("r_name") == F.col("region")).select(F.col("n_name").alias("zone"), r(F.col("base") * (0.8 + F.col("n_nationkey") % 5 * 0.1), 2).alias("price"), trend.alias("trend"))


_CASES = [(1, "Brand#1", "red widget", "SMALL", "metal sharp"), (2, "Brand#2", "small ring", "ECONOMY", "round"), (3, "Brand#7", "blue bolt", "", "steel"), (4, "Brand#9", "purple cow", "LARGE", ""), (5, "Brand#12", "hot plate", "PROMO", "hot")]
_SET = "list_distinct(string_split(lower({0}), ' '))"
_JAC = lambda a, b: f"(len(list_intersect({_SET.format(a)}, {_SET.format(b)}))::DOUBLE / len(list_distinct(list_concat({_SET.format(a)}, {_SET.format(b)}))))"
_SCORED_SQL = "WITH cases(id, actor, action, target, terms) AS (VALUES {}), s AS (SELECT id, p_partkey AS rule, CASE p_size % 3 WHEN 0 THEN 'prohibited' WHEN 1 THEN 'obligation' ELSE 'permitted' END AS status, {} AS sa, {} AS sb, CASE WHEN target = '' THEN 0.5 ELSE (target = p_type)::INT END::DOUBLE AS st, contains(terms, split_part(p_name, ' ', 1)) AS met FROM cases JOIN part ON {} >= 0.35), m AS (SELECT id, rule, status, met, round(0.40 * sa + 0.45 * sb + 0.15 * st, 4) AS score FROM s WHERE sb >= 0.35 AND 0.40 * sa + 0.45 * sb + 0.15 * st >= 0.55)".format(
    ", ".join(str(c) for c in _CASES), _JAC("actor", "p_brand"), _JAC("action", "p_name"), _JAC("actor", "p_brand")
)


def compliance_scores(spark: SparkSession, d: str, least: float = 0.55) -> DataFrame:
    """Cases against all rules: gates on actor and action, then on the weighted score. The cases are a literal list, so that side is broadcast."""
    cases = spark.createDataFrame(_CASES, "id int, actor string, action string, target string, terms string")
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule"), "p_brand", "p_name", "p_type", F.when(F.col("p_size") % 3 == 0, "prohibited").when(F.col("p_size") % 3 == 1, "obligation").otherwise("permitted").alias("status"))
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    sa, sb = jaccard(words("actor"), words("p_brand")), jaccard(words("action"), words("p_name"))
    target = F.when(F.col("target") == "", 0.5).otherwise((F.col("target") == F.col("p_type")).cast("double"))
    met = F.col("terms").contains(F.split_part("p_name", F.lit(" "), F.lit(1)))
    pairs = rules.join(F.broadcast(cases), (sa >= 0.35) & (sb >= 0.35)).withColumn("raw", 0.40 * sa + 0.45 * sb + 0.15 * target)
    return pairs.where(F.col("raw") >= least).select("id", "rule", "status", met.alias("met"), r("raw").alias("score"))


@query(_SCORED_SQL + " SELECT id, rule, status, score FROM m")
def j10_cases_and_rules(spark: SparkSession, d: str) -> DataFrame:
    return compliance_scores(spark, d).select("id", "rule", "status", "score")


@query(_SCORED_SQL + " SELECT c.id, count(m.rule) AS matches, count(*) FILTER (m.status = 'prohibited') AS violations, count(*) FILTER (m.status = 'obligation' AND NOT met) AS warnings, CASE WHEN count(*) FILTER (m.status = 'prohibited') > 0 THEN 'VIOLATION' WHEN count(*) FILTER (m.status = 'obligation' AND NOT met) > 0 THEN 'WARNING' WHEN count(m.rule) > 0 THEN 'COMPLIANT' ELSE 'UNKNOWN' END AS verdict FROM cases c LEFT JOIN m ON m.id = c.id GROUP BY c.id")
def r24_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Each case's verdict: any violation, else any obligation whose condition is missing, else any match."""
    cases = spark.createDataFrame([(c[0],) for c in _CASES], "id int")
    bad, warn = F.col("status") == "prohibited", (F.col("status") == "obligation") & ~F.col("met")
    counts = cases.join(compliance_scores(spark, d), "id", "left").groupBy("id").agg(F.count("rule").alias("matches"), F.count_if(bad).alias("violations"), F.count_if(warn).alias("warnings"))
    return counts.withColumn("verdict", F.when(F.col("violations") > 0, "VIOLATION").when(F.col("warnings") > 0, "WARNING").when(F.col("matches") > 0, "COMPLIANT").otherwise("UNKNOWN"))


def hybrid_compliance(cases: DataFrame, rules: DataFrame, least: float = 0.55, topics: int = 16, dims: int = 1024) -> DataFrame:
    """``(id, rule, status, met, lexical, meaning, score)`` of cases (id, actor, action, target, terms; few, so broadcast) and rules (rule, actor, action, target, status) that pass the gates.

    Lexical is 0.40 actor, 0.45 action and 0.15 target (0.5 where none is asked). Meaning is the cosine along the leading singular vectors of all rules' TF-IDF. The score is their mean where meaning is positive, else lexical. The gates are 0.35 for the actor, 0.35 for the action
    (half of that where meaning is at least 0.5), and ``least`` for the score.
    """
    whole = lambda x: x.withColumn("text", F.concat_ws(" ", "actor", "action", "target"))
    model, rows = semantic.weighted_terms(whole(rules), dims=dims)
    found = semantic.truncated_svd(rows, "terms", topics, dims)
    told = semantic.dense(rows, found).select("rule", "status", *(F.col(c).alias(f"r_{c}") for c in ("actor", "action", "target")), "dense")
    asked = semantic.dense(semantic.with_terms(model, whole(cases.withColumnRenamed("terms", "conditions"))), found, out="meant").drop("text")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    sa, sb = jaccard(words("actor"), words("r_actor")), jaccard(words("action"), words("r_action"))
    target = F.when(F.col("target") == "", 0.5).otherwise((F.col("target") == F.col("r_target")).cast("double"))
    pairs = told.join(F.broadcast(asked), (sa >= 0.35) & (sb >= 0.175)).withColumns({"action_part": sb, "lexical": 0.40 * sa + 0.45 * sb + 0.15 * target, "meaning": F.coalesce(cosine("meant", "dense"), F.lit(0.0))})
    score = F.when(F.col("meaning") > 0, (F.col("lexical") + F.col("meaning")) / 2).otherwise(F.col("lexical"))
    kept = pairs.withColumn("score", score).where((F.col("score") >= least) & (F.col("action_part") >= F.when(F.col("meaning") >= 0.5, 0.175).otherwise(0.35)))
    met = F.col("conditions").contains(F.split_part("r_action", F.lit(" "), F.lit(1)))
    return kept.select("id", "rule", "status", met.alias("met"), r("lexical", 6).alias("lexical"), r("meaning", 6).alias("meaning"), r("score", 6).alias("score"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("actor"), F.col("p_name").alias("action"), F.col("p_type").alias("target"), F.when(F.col("p_size") % 3 == 0, "prohibited").when(F.col("p_size") % 3 == 1, "obligation").otherwise("permitted").alias("status"))
    return hybrid_compliance(spark.createDataFrame(_CASES, "id int, actor string, action string, target string, terms string"), rules)


@query()
def j10_hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


@query()
def r24_hybrid_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Each case's verdict by hybrid scores, with the best score, the number of rules in each bucket and of unmet obligations."""
    cases = spark.createDataFrame([(c[0],) for c in _CASES], "id int")
    of = lambda s: F.col("status") == s
    n = cases.join(_hybrid(spark, d), "id", "left").groupBy("id").agg(
        F.count("rule").alias("matches"), F.count_if(of("prohibited")).alias("violations"), F.count_if(of("obligation") & ~F.col("met")).alias("warnings"), F.count_if(of("permitted")).alias("permissions"), F.max("score").alias("best"),
    )
    return n.withColumn("verdict", F.when(F.col("violations") > 0, "VIOLATION").when(F.col("warnings") > 0, "WARNING").when(F.col("matches") > 0, "COMPLIANT").otherwise("UNKNOWN"))


# samples, reports and bundles --------------------------------------------------------------------------------


@query("SELECT url, part, round(price, 0) AS price, round(surface, 0) AS surface FROM listing ORDER BY md5(concat_ws('|', url::VARCHAR, part::VARCHAR, seller::VARCHAR)), url, part LIMIT 2000", True)
def a5_heatmap_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of at most 2000 points, the same in each run: those of the least hashes."""
    x = listings(spark, d).withColumn("h", F.md5(F.concat_ws("|", "url", "part", "seller"))).orderBy("h", "url", "part").limit(2000)
    return x.select("url", "part", r("price", 0).alias("price"), r("surface", 0).alias("surface"))


_LONG = "SELECT '{0}' AS section, {1} AS item, round({2}, 4)::DOUBLE AS value FROM listing GROUP BY 2"


def section(df: DataFrame, name: str, item: Column, value: Column) -> DataFrame:
    return df.groupBy(item.alias("item")).agg(r(value).cast("double").alias("value")).select(F.lit(name).alias("section"), "item", "value")


@query(" UNION ALL ".join(_LONG.format(*s) for s in (("global", "'listings'", "count(*)"), ("global", "'median'", "median(price)"), ("region", "region", "median(ppm2)"), ("month", "strftime(seen, '%Y-%m')", "avg(price)"))), True)
def t5_territorial_report(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("region", "seen", "price", "ppm2")
    return stacked(section(x, "global", F.lit("listings"), F.count("*")), section(x, "global", F.lit("median"), median("price")), section(x, "region", F.col("region"), median("ppm2")), section(x, "month", F.date_format("seen", "yyyy-MM"), F.avg("price")))


@query(" UNION ALL ".join(_LONG.format(*s) for s in (("days", "city", f"avg({_DAYS})"), ("window", "month(seen)::VARCHAR", "median(price)"), ("sources", "source", "count(*)"), ("types", "property_type", "median(ppm2)"))), True)
def b6_market_report(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("city", "seen", "source", "property_type", "price", "ppm2")
    return stacked(section(x, "days", F.col("city"), F.avg(days())), section(x, "window", F.month("seen").cast("string"), median("price")), section(x, "sources", F.col("source"), F.count("*")), section(x, "types", F.col("property_type"), median("ppm2")))


@query(", m AS (SELECT source, date_trunc('month', seen) AS month, count(*) AS n, avg((surface < 3)::INT) AS unknown FROM listing GROUP BY ALL), w AS (SELECT *, avg(n) OVER (PARTITION BY source ORDER BY month ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM m) SELECT source, strftime(month, '%Y-%m') AS month, n, round(unknown, 4) AS unknown, round(1 - n / base, 4) AS drop, CASE WHEN unknown > 0.8 THEN 'unhealthy' WHEN round(1 - n / base, 4) > 0.5 THEN 'warning' ELSE 'healthy' END AS state, coalesce(round(1 - n / base, 4) > 0.5 OR unknown > 0.8, FALSE) AS fall_back FROM w", True)
def m15_source_probes(spark: SparkSession, d: str) -> DataFrame:
    """Each source's months against the mean of up to ten before: missing values, drop, state, and whether to fall back on stored rows."""
    m = listings(spark, d).groupBy("source", F.date_trunc("month", "seen").alias("at")).agg(F.count("*").alias("n"), share(F.col("surface") < 3).alias("unknown"))
    base = F.avg("n").over(Window.partitionBy("source").orderBy("at").rowsBetween(-10, -1))
    w = m.withColumn("drop", r(1 - F.col("n") / base))
    state = F.when(F.col("unknown") > 0.8, "unhealthy").when(F.col("drop") > 0.5, "warning").otherwise("healthy")
    return w.select("source", F.date_format("at", "yyyy-MM").alias("month"), "n", "unknown", "drop", state.alias("state"), F.coalesce((F.col("drop") > 0.5) | (F.col("unknown") > 0.8), F.lit(False)).alias("fall_back"))


@query("SELECT event_type AS series, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL ORDER BY 1, 2")
def w10_trend_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total")).orderBy("series", "day")


@query("SELECT user_id, count(*) AS used FROM events GROUP BY user_id ORDER BY used, user_id LIMIT 8")
def w11_least_used(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("used")).orderBy("used", "user_id").limit(8)


_BUNDLE = _TRUST_SQL + ", a AS (SELECT 'matching' AS section, url::VARCHAR || '/' || part || '/' || seller AS item, trust AS value FROM t WHERE price <= 50000 ORDER BY value DESC, item LIMIT 5), z AS (SELECT 'zones' AS section, city AS item, round(avg(trust), 4) AS value FROM t GROUP BY city ORDER BY value DESC, item LIMIT 5)"


@query(_BUNDLE + " SELECT * FROM a UNION ALL SELECT * FROM z", True)
def w12_daily_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """The day's bundle: the five best matches of a profile and the five best zones."""
    t = trusted(listings(spark, d))
    match = t.where("price <= 50000").select(F.lit("matching").alias("section"), F.concat_ws("/", "url", "part", "seller").alias("item"), F.col("trust").alias("value"))
    zone = t.groupBy(F.col("city").alias("item")).agg(r(F.avg("trust")).alias("value")).select(F.lit("zones").alias("section"), "item", "value")
    return stacked(*(x.orderBy(F.desc("value"), "item").limit(5) for x in (match, zone)))


# scores ------------------------------------------------------------------------------------------------------


@query(_TRUST_SQL + " SELECT CASE WHEN abs(ppm2 / med - 1) > 0.5 THEN 'anomaly' WHEN abs(ppm2 / med - 1) > 0.15 THEN 'deviating' ELSE 'normal' END AS band, count(*) AS n, round(avg(0.6 * trust + 0.4 * (1 - least(1, abs(ppm2 / med - 1)))), 4) AS blended FROM t GROUP BY band", True)
def r9_deviation_bands(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.try_divide("ppm2", "med") - 1)
    band = F.when(off > 0.5, "anomaly").when(off > 0.15, "deviating").otherwise("normal")
    return trusted(listings(spark, d)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), r(F.avg(0.6 * F.col("trust") + 0.4 * (1 - F.least(F.lit(1.0), off)))).alias("blended"))


@query(", c AS (SELECT city, median(price) AS price FROM listing GROUP BY city) SELECT city, round(price, 4) AS price, 60 + right(city, 1)::BIGINT * 3 + CASE WHEN price <= 37000 THEN 10 WHEN price > 40000 THEN -10 ELSE 0 END AS score FROM c ORDER BY score DESC, city", True)
def r19_compare_cities(spark: SparkSession, d: str) -> DataFrame:
    """A city's base score from a table, adjusted by whether the budget reaches its median price."""
    c = listings(spark, d).groupBy("city").agg(median("price").alias("price"))
    fit = F.when(F.col("price") <= 37000, 10).when(F.col("price") > 40000, -10).otherwise(0)
    return c.select("city", r("price").alias("price"), (60 + F.right("city", F.lit(1)).cast("long") * 3 + fit).alias("score")).orderBy(F.desc("score"), "city")


_WORDS_SQL = "len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9àâäéèêëîïôöùûüçñóíáúß]+'), lambda x: length(x) > 1))"
_QUALITY_SQL = f"(CASE role WHEN 'user' THEN 2 ELSE 1 END + CASE WHEN {_WORDS_SQL} >= 3 THEN 2 WHEN {_WORDS_SQL} >= 1 THEN 1 ELSE 0 END + CASE WHEN turn > 0 THEN 2 ELSE 0 END + contains(lower(text), 'the')::INT + contains(lower(text), 'on')::INT + contains(lower(text), 'th')::INT)"


@query(f"SELECT conv_id, turn, {_QUALITY_SQL} AS quality, CASE WHEN {_QUALITY_SQL} >= 8 THEN 'high' WHEN {_QUALITY_SQL} >= 5 THEN 'medium' ELSE 'low' END AS priority FROM conversations WHERE text IS NOT NULL")
def r22_rule_quality(spark: SparkSession, d: str) -> DataFrame:
    """Up to 9 points for actor, action, status, target, condition and article, and the priority that follows."""
    low, n = F.lower("text"), F.size(tokens(F.col("text")))
    points = F.when(F.col("role") == "user", 2).otherwise(1) + F.when(n >= 3, 2).when(n >= 1, 1).otherwise(0) + F.when(F.col("turn") > 0, 2).otherwise(0) + how_many(low, ["the", "on", "th"])
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", points.alias("quality"), F.when(points >= 8, "high").when(points >= 5, "medium").otherwise("low").alias("priority"))


@query("SELECT doc_id, round(greatest(0, least(100, (CASE WHEN lower(text) LIKE '%license%' THEN 80 WHEN lower(text) LIKE '%copyright%' THEN 60 WHEN lower(text) LIKE '%the%' THEN 30 ELSE 10 END + CASE WHEN lower(text) LIKE '%released%' THEN 15 ELSE 0 END - CASE WHEN lower(text) LIKE '%with%' THEN 10 ELSE 0 END) * CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.8 ELSE 0.6 END)), 2)::DOUBLE AS risk FROM documents WHERE text IS NOT NULL")
def r23_planning_risk(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword that occurs sets the risk, others raise or lower it, relevance scales it."""
    low = F.lower("text")
    base = F.when(low.contains("license"), 80).when(low.contains("copyright"), 60).when(low.contains("the"), 30).otherwise(10)
    risk = (base + F.when(low.contains("released"), 15).otherwise(0) - F.when(low.contains("with"), 10).otherwise(0)) * F.when(F.col("source") == "src0", 1.0).when(F.col("source") == "src1", 0.8).otherwise(0.6)
    return table(spark, d, "documents").where("text is not null").select("doc_id", r(clamp(risk, 0.0, 100.0), 2).alias("risk"))


_INTENT = lambda t: "[" + ", ".join(f"({' + '.join(f'contains({t}, {w!r})::INT' for w in ws)} + 1)::DOUBLE" for ws in (["the", "and"], ["les", "dans"], ["der", "und"])) + "]"


@query(f"WITH p AS (SELECT conv_id, turn, {_INTENT('text')} AS a, {_INTENT('lower(text)')} AS b FROM conversations WHERE text IS NOT NULL), m AS (SELECT conv_id, turn, list_transform([1, 2, 3], lambda i: round((a[i] / list_sum(a) + b[i] / list_sum(b)) / 2, 4)) AS p FROM p) SELECT conv_id, turn, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 'en' WHEN p[2] >= p[3] THEN 'fr' ELSE 'de' END AS intent, list_max(p) AS confidence FROM m")
def x16_mean_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """The intent of the largest mean posterior over a message and its normalised variant."""
    post = lambda t: F.array(*(how_many(t, ws) + F.lit(1.0) for ws in (["the", "and"], ["les", "dans"], ["der", "und"])))
    x = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", post(F.col("text")).alias("a"), post(F.lower("text")).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    m = x.select("conv_id", "turn", *(r((F.col("a")[i] / total("a") + F.col("b")[i] / total("b")) / 2).alias(f"p{i}") for i in range(3)))
    p = [F.col(f"p{i}") for i in range(3)]
    return m.select("conv_id", "turn", F.when((p[0] >= p[1]) & (p[0] >= p[2]), "en").when(p[1] >= p[2], "fr").otherwise("de").alias("intent"), F.greatest(*p).alias("confidence"))


# composed runs -----------------------------------------------------------------------------------------------


@query(_TRUST_SQL + " SELECT CASE WHEN property_type = 'STANDARD' THEN CASE WHEN price > 60000 THEN 'LARGE' ELSE 'SMALL' END ELSE property_type END AS kind, count(*) AS n, count(*) FILTER (trust < 0.6) AS suspects, round(avg(trust), 4) AS mean_trust FROM t GROUP BY kind ORDER BY n DESC, kind LIMIT 8", True)
def b1_score_and_summarise(spark: SparkSession, d: str) -> DataFrame:
    """Scored listings whose generic types give way to predicted ones: the eight most frequent types."""
    kind = F.when(F.col("property_type") == "STANDARD", F.when(F.col("price") > 60000, "LARGE").otherwise("SMALL")).otherwise(F.col("property_type"))
    return trusted(listings(spark, d)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("trust") < 0.6).alias("suspects"), r(F.avg("trust")).alias("mean_trust")).orderBy(F.desc("n"), "kind").limit(8)


@query(" SELECT city, count(*) AS n, round(median(ppm2), 2) AS med FROM listing WHERE ppm2 BETWEEN 100 AND 1500 GROUP BY city", True)
def b2_market_analysis(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where("ppm2 between 100 and 1500").groupBy("city").agg(F.count("*").alias("n"), r(median("ppm2"), 2).alias("med"))


@query(", f AS (SELECT * FROM listing WHERE city = 'NATION_3' AND property_type = 'LARGE' AND price > 90000), n AS (SELECT count(*) AS n FROM f) SELECT count(*) AS n, round(median(ppm2), 2) AS med, any_value(n.n) >= 3 AS narrow FROM listing, n WHERE n.n < 3 OR (city = 'NATION_3' AND property_type = 'LARGE' AND price > 90000)", True)
def b5_market_answer(spark: SparkSession, d: str) -> DataFrame:
    """The market that a question names, or the whole one where fewer than three listings match."""
    x, wanted = listings(spark, d), F.expr("city = 'NATION_3' and property_type = 'LARGE' and price > 90000")
    n = x.agg(F.count_if(wanted).alias("found"))
    return x.crossJoin(F.broadcast(n)).where((F.col("found") < 3) | wanted).agg(F.count("*").alias("n"), r(median("ppm2"), 2).alias("med"), (F.max("found") >= 3).alias("narrow"))


@query(_TRUST_SQL + " SELECT CASE WHEN trust >= 0.85 THEN 'BUY' WHEN trust < 0.6 THEN 'AVOID' ELSE 'HOLD' END AS decision, count(*) AS n, round(avg(trust), 4) AS score, round(avg(med / ppm2), 4) AS roi FROM t GROUP BY decision", True)
def b21_score_and_return(spark: SparkSession, d: str) -> DataFrame:
    t = trusted(listings(spark, d))
    return t.groupBy(F.when(F.col("trust") >= 0.85, "BUY").when(F.col("trust") < 0.6, "AVOID").otherwise("HOLD").alias("decision")).agg(F.count("*").alias("n"), r(F.avg("trust")).alias("score"), r(F.avg(F.try_divide("med", "ppm2"))).alias("roi"))


@query("SELECT source, count(*) AS n FROM (SELECT doc_id, source FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id, source FROM documents d WHERE source = 'src3' AND text IS NOT NULL) GROUP BY source")
def b22_append_source(spark: SparkSession, d: str) -> DataFrame:
    """A chunk index to which a new source is added: only chunks of sources that it lacks are appended."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source")
    index = docs.where("source <> 'src3'")
    new = docs.join(index.select("source").distinct(), "source", "left_anti").select("doc_id", "source")
    return index.unionByName(new).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80)")
def b24_skip_known(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("event_type <> 'view'").join(e.where("event_type = 'error' and value > 80").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("WITH p AS (SELECT event_id // 5 AS page, bool_and(event_type <> 'purchase') AS seen FROM events GROUP BY 1), s AS (SELECT page, seen AND lag(seen, 1) OVER (ORDER BY page) AND lag(seen, 2) OVER (ORDER BY page) AS stop FROM p) SELECT page FROM s WHERE page <= coalesce((SELECT min(page) FROM s WHERE stop), 9e18)")
def b25_stop_after_seen_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages up to the first run of three that hold nothing new. Page numbers are gapless, so the two before come by equi-joins, not by one ordered task."""
    p = table(spark, d, "events").groupBy(F.expr("event_id div 5").alias("page")).agg(F.every(F.col("event_type") != "purchase").alias("seen"))
    seen = p.where("seen").select("page")
    stop = seen
    for back in (1, 2):
        stop = stop.join(seen.select((F.col("page") + back).alias("page")), "page")
    last = stop.agg(F.min("page").alias("last"))
    return p.crossJoin(F.broadcast(last)).where("page <= last or last is null").select("page")


@query(_TRUST_SQL + " SELECT url, part, seller, trust FROM t WHERE trust >= 0.9 ORDER BY trust DESC, url, part, seller LIMIT 10", True)
def b27_trusted_sample(spark: SparkSession, d: str) -> DataFrame:
    return trusted(listings(spark, d)).where("trust >= 0.9").select("url", "part", "seller", "trust").orderBy(F.desc("trust"), "url", "part", "seller").limit(10)


@query(", n AS (SELECT median(ppm2) AS m FROM listing), c AS (SELECT city, median(ppm2) AS med FROM listing GROUP BY city) SELECT n_name AS city, CASE WHEN n_nationkey % 4 = 0 THEN 'standard' ELSE ['premium', 'middle', 'entry'][n_nationkey % 4] END AS segment, round(coalesce(med, m) / m, 4) AS ratio, round(coalesce(med, m) * 1.033 ^ 1, 2) AS year_1, round(coalesce(med, m) * 1.033 ^ 3, 2) AS year_3, round(coalesce(med, m) * 1.033 ^ 5, 2) AS year_5 FROM nation LEFT JOIN c ON c.city = n_name, n", True)
def b28_segments_and_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Each city's segment (with a default), its ratio to the national median, and prices extrapolated to milestones."""
    x = stored(listings(spark, d).select("city", "ppm2"), "listings")
    c, n = narrow_quantiles(x, ["city"], {"med": ("ppm2", 0.5)}), with_quantiles(x, [], {"m": ("ppm2", 0.5)}, F.count("*").alias("all"))
    segments = spark.createDataFrame([(1, "premium"), (2, "middle"), (3, "entry")], "k int, segment string")
    zones = table(spark, d, "nation").select(F.col("n_name").alias("city"), (F.col("n_nationkey") % 4).alias("k")).join(segments, "k", "left").join(F.broadcast(c), "city", "left").crossJoin(F.broadcast(n))
    med = F.coalesce("med", "m")
    return zones.select("city", F.coalesce("segment", F.lit("standard")).alias("segment"), r(F.try_divide(med, F.col("m"))).alias("ratio"), *(r(med * F.pow(F.lit(1.033), F.lit(y)), 2).alias(f"year_{y}") for y in (1, 3, 5)))


@query("WITH q(place) AS (VALUES ('nation_3'), ('NATIN_4'), ('nowhere'), ('nation_21')), s AS (SELECT place, n_name, levenshtein(lower(place), lower(n_name)) AS far FROM q, nation) SELECT place, CASE WHEN min(far) <= 2 THEN arg_min(n_name, (far, n_name)) END AS resolved FROM s GROUP BY place")
def b29_resolve_place(spark: SparkSession, d: str) -> DataFrame:
    """A typed place as its governorate: the name of the fewest edits, if two or fewer. Places are a literal list and the names a small dimension."""
    places = spark.createDataFrame([("nation_3",), ("NATIN_4",), ("nowhere",), ("nation_21",)], "place string")
    s = table(spark, d, "nation").select("n_name").join(F.broadcast(places)).withColumn("far", F.levenshtein(F.lower("place"), F.lower("n_name")))
    return s.groupBy("place").agg(F.min(F.struct("far", "n_name")).alias("best")).select("place", F.when(F.col("best.far") <= 2, F.col("best.n_name")).alias("resolved"))


@query("WITH b AS (SELECT 'bin' AS section, (least(floor(value / 20), 4)::BIGINT * 20)::VARCHAR AS item, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 2), a AS (SELECT 'actor' AS section, user_id::VARCHAR AS item, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, item LIMIT 6) SELECT * FROM b UNION ALL SELECT * FROM a")
def b33_risk_dashboard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bins = e.where("value is not null").groupBy((F.least(F.floor(F.col("value") / 20), F.lit(4)) * 20).cast("string").alias("item")).agg(F.count("*").alias("n")).select(F.lit("bin").alias("section"), "item", "n")
    actors = e.groupBy(F.col("user_id").cast("string").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(6).select(F.lit("actor").alias("section"), "item", "n")
    return stacked(bins, actors)


@query("SELECT url, part, seller, year(seen) AS year, quarter(seen) AS quarter, month(seen) AS month FROM listing ORDER BY seen DESC, url, part, seller LIMIT 20000", True)
def b36_load_territorial(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("url", "part", "seller", "seen").orderBy(F.desc("seen"), "url", "part", "seller").limit(20_000)
    return x.select("url", "part", "seller", F.year("seen").alias("year"), F.quarter("seen").alias("quarter"), F.month("seen").alias("month"))


@query(", m AS (SELECT max(seen) AS top FROM listing), w AS (SELECT price, surface, ppm2, seen > top - INTERVAL 365 DAY AS recent FROM listing, m), " + "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (NOT recent) AS n, round(avg({c}) FILTER (NOT recent), 2) AS mean, round(abs(avg({c}) FILTER (recent) / avg({c}) FILTER (NOT recent) - 1), 4) AS shift FROM w" for c in ("price", "surface", "ppm2")) + ") SELECT *, CASE WHEN shift > 0.40 THEN 'critical' WHEN shift > 0.20 THEN 'warning' ELSE 'none' END AS severity FROM u WHERE n >= 30", True)
def b14_baseline_and_severity(spark: SparkSession, d: str) -> DataFrame:
    """Each column's baseline and how far the recent mean has moved from it; at least 30 rows are needed. One pass over the rows."""
    x = listings(spark, d).select("price", "surface", "ppm2", "seen")
    w = x.crossJoin(F.broadcast(x.agg(F.max("seen").alias("top")))).withColumn("recent", F.expr("seen > top - interval 365 days"))
    long = w.unpivot(["recent"], ["price", "surface", "ppm2"], "field", "v")
    mean = lambda when: F.avg(F.when(when, F.col("v")))
    g = long.groupBy("field").agg(F.count_if(~F.col("recent")).alias("n"), r(mean(~F.col("recent")), 2).alias("mean"), r(F.abs(F.try_divide(mean(F.col("recent")), mean(~F.col("recent"))) - 1)).alias("shift"))
    return g.where("n >= 30").withColumn("severity", F.when(F.col("shift") > 0.40, "critical").when(F.col("shift") > 0.20, "warning").otherwise("none"))


@query("SELECT url, part, seller, left(sha256(concat_ws('|', url::VARCHAR, part::VARCHAR, seller::VARCHAR, city, property_type)), 12) AS row_hash, '{\"step\":\"scoring\",\"city\":\"' || city || '\"}' AS step FROM listing", True)
def b17_lineage_steps(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    return x.select("url", "part", "seller", F.left(F.sha2(F.concat_ws("|", "url", "part", "seller", "city", "property_type"), 256), F.lit(12)).alias("row_hash"), F.to_json(F.struct(F.lit("scoring").alias("step"), "city")).alias("step"))


_AD_SQL = "WITH a AS (SELECT p_size AS size, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || ' S+' || (p_size % 4) || ', ' || (p_size * 10) || ' m2' END AS ad FROM part), f AS (SELECT size, try_cast(regexp_extract(ad, '(\\d+) m2', 1) AS BIGINT) AS found FROM a)"


@query(_AD_SQL + " SELECT count(*) AS n, count(*) FILTER (size % 3 <> 0) AS missing, count(*) FILTER (size % 3 <> 0 AND found IS NOT NULL) AS filled FROM f")
def b11_fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Only rows that lack the field are filled from their text; the counts of lacking and filled ones."""
    from .extraction import advertisements, number

    x = advertisements(spark, d).select(F.when(F.col("size") % 3 == 0, F.col("size")).alias("surface"), number("ad", r"(\d+) m2").alias("found"))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("surface").isNull()).alias("missing"), F.count_if(F.col("surface").isNull() & F.col("found").isNotNull()).alias("filled"))


@query(_AD_SQL + " SELECT 'surface' AS field, count(*) AS n, round(avg((found = size * 10)::INT), 4) AS precision_, round(avg(coalesce(found = size * 10, FALSE)::INT), 4) AS accuracy FROM f")
def b13_extraction_run(spark: SparkSession, d: str) -> DataFrame:
    """Extracted values against the known ones: right among those found, and among all."""
    from .extraction import advertisements, number

    right = number("ad", r"(\d+) m2") == F.col("size") * 10
    return advertisements(spark, d).agg(F.count("*").alias("n"), r(F.avg(right.cast("int"))).alias("precision_"), r(F.avg(F.coalesce(right, F.lit(False)).cast("int"))).alias("accuracy")).select(F.lit("surface").alias("field"), "n", "precision_", "accuracy")


@query(_TRUST_SQL + ", i AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY price, seller, part) = 1) SELECT 'ingest' AS stage, count(*) AS n FROM listing UNION ALL SELECT 'dedup', count(*) FROM i UNION ALL SELECT 'clean', count(*) FROM i WHERE price BETWEEN 5000 AND 90000 UNION ALL SELECT 'trusted', count(*) FROM i WHERE price BETWEEN 5000 AND 90000 AND trust >= 0.6", True)
def z7_pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    """The chain from ingested to trusted rows, with the rows left after each stage, in one aggregation."""
    t = trusted(listings(spark, d)).groupBy("url").agg(F.min_by(F.struct("price", "trust"), F.struct("price", "seller", "part")).alias("first"), F.count("*").alias("rows"))
    clean = F.col("first.price").between(5000, 90000)
    c = t.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("ingest"), F.count("*").alias("dedup"), F.count_if(clean).alias("clean"), F.count_if(clean & (F.col("first.trust") >= 0.6)).alias("trusted"))
    return c.unpivot([], ["ingest", "dedup", "clean", "trusted"], "stage", "n")
