"""Trust, risk, recommendation and investment scores; data quality and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import average_ranks, exact_quantiles, ks_distance, median, quantile, share, with_quantiles
from ..functions.text import any_of, how_many
from ..session import stored
from .aggregates import zoned_orders
from .base import listings, query, r, table

#: Words that lower or raise a description's score (fixed values).
SUSPECT = ["urgent", "affaire exceptionnelle", "prix cassé", "ne pas rater", "contact direct", "sans intermédiaire", "paiement cash uniquement", "pas de visite", "à saisir", "offre limitée", "promotion flash"]
QUALITY = ["acte notarié", "titre foncier", "permis de construire", "vue mer", "résidence sécurisée", "ascenseur", "gardien", "parking", "climatisation", "chauffage central"]
SOURCE_TRUST = {"src0": 0.92, "src1": 0.90, "src2": 0.78, "src3": 0.65}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def description_score(text: Column) -> Column:
    """0.3 below 20 characters; else 0.7, more for length, less for each suspect phrase, more for each of quality."""
    low, words = F.lower(text), F.size(F.split(F.trim(text), r"\s+"))
    length = F.when(words.between(30, 300), 0.1).when(words > 300, 0.05).otherwise(0.0)
    return F.when(text.isNull() | (F.length(text) < 20), 0.3).otherwise(clamp(0.7 + length - 0.15 * how_many(low, SUSPECT) + 0.05 * how_many(low, QUALITY)))


def source_score(source: Column) -> Column:
    out = F.when(source.isNull(), 0.60)
    for name, value in SOURCE_TRUST.items():
        out = out.when(source == name, value)
    return out.otherwise(0.65)


_WORDS = "len(regexp_split_to_array(trim(text, ' \n\t\r'), '\\s+'))"
_COUNT = lambda ws: " + ".join(f"(lower(text) LIKE '%{w}%')::INT" for w in ws)
_DESC = f"(CASE WHEN text IS NULL OR length(text) < 20 THEN 0.3 ELSE greatest(0, least(1, 0.7 + CASE WHEN {_WORDS} BETWEEN 30 AND 300 THEN 0.1 WHEN {_WORDS} > 300 THEN 0.05 ELSE 0 END - 0.15 * ({_COUNT(SUSPECT)}) + 0.05 * ({_COUNT(QUALITY)}))) END)::DOUBLE"
_SOURCE = "(CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_TRUST.items()) + " ELSE 0.65 END)::DOUBLE"


@query(f"SELECT doc_id, round({_DESC}, 4) AS score FROM documents")
def r3_description_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", r(description_score(F.col("text"))).alias("score"))


@query(f"SELECT doc_id, {_SOURCE} AS source_score, round(0.25 * (text <> '')::INT + 0.35 * (lang IS NOT NULL)::INT + 0.40 * (n_chars > 100)::INT, 4)::DOUBLE AS completeness FROM documents")
def r4_source_and_completeness(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return table(spark, d, "documents").select("doc_id", source_score(F.col("source")).alias("source_score"), r(0.25 * one(F.col("text") != "") + 0.35 * one(F.col("lang").isNotNull()) + 0.40 * one(F.col("n_chars") > 100)).alias("completeness"))


@query(f", x AS (SELECT url, source, ppm2, city, count(*) OVER (PARTITION BY surface, city, property_type, seen) AS twins FROM listing), c AS (SELECT city, median(ppm2) AS med, stddev(ppm2) AS sd FROM listing GROUP BY city), s AS (SELECT x.*, 0.30 * greatest(0, 1 - abs(ppm2 - med) / sd / 4) + 0.45 * 1.0 + 0.15 * CASE source WHEN 'A' THEN 0.92 WHEN 'N' THEN 0.78 ELSE 0.65 END + 0.10 * CASE WHEN twins = 1 THEN 0.9 ELSE 0.7 END AS trust FROM x JOIN c USING (city)) SELECT CASE WHEN round(trust, 6) >= 0.95 THEN 'reliable' WHEN round(trust, 6) >= 0.88 THEN 'fair' ELSE 'suspect' END AS tier, count(*) AS n, round(avg(trust), 4) AS mean_trust FROM s GROUP BY tier", True)
def r1_trust_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d).groupBy(F.when(r("trust", 6) >= 0.95, "reliable").when(r("trust", 6) >= 0.88, "fair").otherwise("suspect").alias("tier")).agg(F.count("*").alias("n"), r(F.avg("trust")).alias("mean_trust"))


def _trust(spark: SparkSession, d: str, kept: bool = False) -> DataFrame:
    """Listings with ``trust``; ``kept`` writes them once, with their titles' lengths for titles, and takes the cities' medians in narrow passes."""
    x = listings(spark, d)
    if kept:
        x = stored(x.drop("status").withColumn("title", F.length("title")), "listings")
        c = F.broadcast(with_quantiles(x, ["city"], {"med": ("ppm2", 0.5)}, F.stddev_samp("ppm2").alias("sd")))
    else:
        c = x.groupBy("city").agg(median("ppm2").alias("med"), F.stddev_samp("ppm2").alias("sd"))
    twins = F.count("*").over(Window.partitionBy("surface", "city", "property_type", "seen"))
    price = F.greatest(F.lit(0.0), 1 - F.abs(F.col("ppm2") - F.col("med")) / F.col("sd") / 4)
    source = F.when(F.col("source") == "A", 0.92).when(F.col("source") == "N", 0.78).otherwise(0.65)
    return x.withColumn("twins", twins).join(c, "city").withColumn("trust", 0.30 * price + 0.45 + 0.15 * source + 0.10 * F.when(F.col("twins") == 1, 0.9).otherwise(0.7))


@query(", c AS (SELECT city, median(ppm2) AS med, stddev(ppm2) AS sd FROM listing GROUP BY city) SELECT city, count(*) AS n, round(avg(greatest(0, 1 - abs(ppm2 - med) / sd / 4)), 4) AS coherence FROM listing JOIN c USING (city) GROUP BY city", True)
def r2_price_coherence(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    c = x.groupBy("city").agg(median("ppm2").alias("med"), F.stddev_samp("ppm2").alias("sd"))
    return x.join(c, "city").groupBy("city").agg(F.count("*").alias("n"), r(F.avg(F.greatest(F.lit(0.0), 1 - F.abs(F.col("ppm2") - F.col("med")) / F.col("sd") / 4))).alias("coherence"))


@query(", g AS (SELECT median(price) AS med FROM listing), f AS (SELECT list_filter([CASE WHEN price < 0.3 * med THEN 'very low' END, CASE WHEN price > 1.9 * med THEN 'very high' END, CASE WHEN surface <= 1 THEN 'no surface' END], lambda x: x IS NOT NULL) AS flags FROM listing, g) SELECT array_to_string(flags, ',') AS flags, count(*) AS n FROM f GROUP BY 1", True)
def r5_fraud_flags(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    f = x.withColumn("med", F.lit(exact_quantiles(x, "price", 0.5)[0]).cast("double"))
    flags = F.filter(F.array(F.when(F.col("price") < 0.3 * F.col("med"), "very low"), F.when(F.col("price") > 1.9 * F.col("med"), "very high"), F.when(F.col("surface") <= 1, "no surface")), lambda v: v.isNotNull())
    return f.groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count("*").alias("n"))


@query(", g AS (SELECT median(ppm2) AS nat FROM listing), s AS (SELECT city, 0.25 * CASE source WHEN 'A' THEN 0.95 WHEN 'N' THEN 0.70 ELSE 0.45 END + 0.25 * greatest(0.1, 1 - least(abs(ppm2 / nat - 1), 1.5) / 1.5) + 0.20 * (1 - CASE WHEN surface < 5 THEN 0.3 ELSE 0 END) + 0.30 AS s FROM listing, g) SELECT city, round(avg(s), 4) AS trust FROM s GROUP BY city", True)
def r6_enriched_trust(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("city", "source", "surface", "ppm2"), "listings")
    source = F.when(F.col("source") == "A", 0.95).when(F.col("source") == "N", 0.70).otherwise(0.45)
    near = F.greatest(F.lit(0.1), 1 - F.least(F.abs(F.col("ppm2") / F.col("nat") - 1), F.lit(1.5)) / 1.5)
    s = 0.25 * source + 0.25 * near + 0.20 * (1 - F.when(F.col("surface") < 5, 0.3).otherwise(0.0)) + 0.30
    return x.crossJoin(F.broadcast(with_quantiles(x, [], {"nat": ("ppm2", 0.5)}, F.count("*").alias("all")))).groupBy("city").agg(r(F.avg(s)).alias("trust"))


_SENT = f"(CASE WHEN length(text) < 20 THEN 0.3 ELSE 0.6 - 0.15 * (lower(text) LIKE '%urgent%')::INT - 0.10 * ({_COUNT(['idiot', 'moron', 'clown', 'worthless'])} > 0)::INT - 0.30 * regexp_matches(text, '[0-9]{{8,}}')::INT + least(0.20, 0.05 * ({_COUNT(QUALITY)})) + CASE WHEN length(text) > 300 THEN 0.10 WHEN length(text) < 50 THEN -0.15 ELSE 0 END END)::DOUBLE"


def sentiment(text: str = "text") -> Column:
    """The score of one text by rule: flags lower it; words of quality and length raise it."""
    t, low = F.col(text), F.lower(text)
    one = lambda c: c.cast("int")
    return F.when(F.length(t) < 20, 0.3).otherwise(
        0.6 - 0.15 * one(low.contains("urgent")) - 0.10 * one(any_of(low, ["idiot", "moron", "clown", "worthless"])) - 0.30 * one(t.rlike("[0-9]{8,}"))
        + F.least(F.lit(0.20), 0.05 * how_many(low, QUALITY)) + F.when(F.length(t) > 300, 0.10).when(F.length(t) < 50, -0.15).otherwise(0.0)
    )


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.75, "positive").when(score >= 0.55, "neutral").when(score >= 0.35, "doubtful").otherwise("negative")


@query(f"WITH s AS (SELECT round({_SENT}, 4) AS s FROM documents) SELECT CASE WHEN s >= 0.75 THEN 'positive' WHEN s >= 0.55 THEN 'neutral' WHEN s >= 0.35 THEN 'doubtful' ELSE 'negative' END AS label, count(*) AS n, round(avg(s), 4) AS mean_score FROM s GROUP BY label")
def r7_sentiment(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(r(sentiment()).alias("s"))
    return x.groupBy(sentiment_label(F.col("s")).alias("label")).agg(F.count("*").alias("n"), r(F.avg("s")).alias("mean_score"))


@query("SELECT round(0.5 + 0.1 * (n_chars > 200)::INT + 0.1 * (lang = 'en')::INT + CASE WHEN source = 'src0' THEN 0.15 ELSE 0.05 END, 4)::DOUBLE AS trust, count(*) AS n FROM documents GROUP BY 1")
def r8_simple_trust(spark: SparkSession, d: str) -> DataFrame:
    s = 0.5 + 0.1 * (F.col("n_chars") > 200).cast("int") + 0.1 * (F.col("lang") == "en").cast("int") + F.when(F.col("source") == "src0", 0.15).otherwise(0.05)
    return table(spark, d, "documents").groupBy(r(s).alias("trust")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\(([0-9]{3})\\)', 1))) AS code FROM documents), c AS (SELECT code, count(DISTINCT doc_id) AS n FROM p GROUP BY code), m AS (SELECT doc_id, max(n) AS most FROM p JOIN c USING (code) GROUP BY doc_id) SELECT doc_id, most, CASE WHEN most > 10 THEN 'agency' WHEN most > 3 THEN 'trader' ELSE 'private' END AS kind FROM m")
def r10_seller_scores(spark: SparkSession, d: str) -> DataFrame:
    codes = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(([0-9]{3})\)"), 1)))
    p = table(spark, d, "documents").select("doc_id", codes.alias("code"))
    c = p.groupBy("code").agg(F.count_distinct("doc_id").alias("n"))
    m = p.join(c, "code").groupBy("doc_id").agg(F.max("n").alias("most"))
    return m.withColumn("kind", F.when(F.col("most") > 10, "agency").when(F.col("most") > 3, "trader").otherwise("private"))


_MATCH = ", f AS (SELECT * FROM listing WHERE price <= 60000 AND surface >= 20 AND property_type = 'LARGE'), g AS (SELECT median(ppm2) AS med FROM f), s AS (SELECT url, part, seller, price, 0.30 * (1 - greatest(0, least(1, abs(price / 60000.0 - 0.85)))) + 0.20 * least(1, surface / 20 * 0.8) + 0.20 * greatest(0, 1 - 0.7 * abs(ppm2 / med - 1)) + 0.20 * 0.65 + 0.10 * 0.8 AS s FROM f, g) SELECT url, part, seller, price, round(s, 4) AS score FROM s ORDER BY round(s, 6) DESC, url, part, seller LIMIT 20"


@query(_MATCH, True)
def r11_match_listings(spark: SparkSession, d: str) -> DataFrame:
    f = listings(spark, d).where("price <= 60000 and surface >= 20 and property_type = 'LARGE'")
    g = f.crossJoin(F.broadcast(f.agg(median("ppm2").alias("med"))))
    s = 0.30 * (1 - clamp(F.abs(F.col("price") / 60000.0 - 0.85))) + 0.20 * F.least(F.lit(1.0), F.col("surface") / 20 * 0.8) + 0.20 * F.greatest(F.lit(0.0), 1 - 0.7 * F.abs(F.col("ppm2") / F.col("med") - 1)) + 0.20 * 0.65 + 0.10 * 0.8
    return g.withColumn("s", s).orderBy(r("s", 6).desc(), "url", "part", "seller").limit(20).select("url", "part", "seller", "price", r("s").alias("score"))


@query(", g AS (SELECT stddev(ppm2) AS a, stddev(surface) AS b FROM listing), q AS (SELECT ppm2 AS p0, surface AS s0, city AS c0, property_type AS t0 FROM listing ORDER BY url, part, seller LIMIT 1), s AS (SELECT url, part, seller, sqrt(((ppm2 - p0) / a) ** 2 + ((surface - s0) / b) ** 2) + 0.4 * (city <> c0)::INT + 0.2 * (property_type <> t0)::INT AS dist FROM listing, g, q) SELECT url, part, seller, round(greatest(0, 1 - least(dist / 5, 1)), 4) AS similarity FROM s ORDER BY round(dist, 6), url, part, seller LIMIT 15", True)
def r12_similar_listings(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    q = x.orderBy("url", "part", "seller").limit(1).select(F.col("ppm2").alias("p0"), F.col("surface").alias("s0"), F.col("city").alias("c0"), F.col("property_type").alias("t0"))
    g = x.agg(F.stddev_samp("ppm2").alias("a"), F.stddev_samp("surface").alias("b"))
    dist = F.sqrt(((F.col("ppm2") - F.col("p0")) / F.col("a")) ** 2 + ((F.col("surface") - F.col("s0")) / F.col("b")) ** 2) + 0.4 * (F.col("city") != F.col("c0")).cast("int") + 0.2 * (F.col("property_type") != F.col("t0")).cast("int")
    s = x.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(q)).withColumn("dist", dist)
    return s.orderBy(r("dist", 6), "url", "part", "seller").limit(15).select("url", "part", "seller", r(F.greatest(F.lit(0.0), 1 - F.least(F.col("dist") / 5, F.lit(1.0)))).alias("similarity"))


_ZONES = [("AFRICA", 0.05, 0.7, 0.6, 0.4), ("AMERICA", 0.03, 0.8, 0.9, 0.2), ("ASIA", 0.06, 0.9, 0.7, 0.3), ("EUROPE", 0.02, 0.7, 0.95, 0.15), ("MIDDLE EAST", 0.04, 0.6, 0.7, 0.5)]


@query(", z(region, g, dem, inf, risk) AS (VALUES " + ", ".join(str(z) for z in _ZONES) + "), m AS (SELECT region, median(ppm2) AS med FROM listing GROUP BY region) SELECT z.region, round(med, 2) AS median_ppm2, round(greatest(0, least(1, 10 * g * 0.35 + dem * 0.30 + inf * 0.20 - risk * 1.0 * 0.15)), 4)::DOUBLE AS score FROM z LEFT JOIN m USING (region)", True)
def r13_investment_zones(spark: SparkSession, d: str) -> DataFrame:
    z = spark.createDataFrame(_ZONES, "region string, g double, dem double, inf double, risk double")
    m = listings(spark, d).groupBy("region").agg(median("ppm2").alias("m"))
    score = clamp(10 * F.col("g") * 0.35 + F.col("dem") * 0.30 + F.col("inf") * 0.20 - F.col("risk") * 0.15)
    return z.join(m, "region", "left").select("region", r("m", 2).alias("median_ppm2"), r(score).alias("score"))


def invest(df: DataFrame) -> DataFrame:
    """Yield by type, ROI rank, risk, and a weighted score scaled over all rows to BUY, HOLD or AVOID."""
    rate = F.when(F.col("property_type") == "SMALL", 0.068).when(F.col("property_type") == "LARGE", 0.057).otherwise(0.062) - F.when(F.col("ppm2") > 7000, 0.01).otherwise(0.0)
    x = df.withColumn("roi", clamp(12 * F.greatest(F.col("price") * rate / 12, F.lit(550.0)) / F.col("price"), 0.048, 0.092))
    x = average_ranks(x, "roi", "norm", [0.048 + i * (0.092 - 0.048) / 256 for i in range(1, 256)])  # within the rates' fixed bounds
    risk = F.when(F.col("price") < 80000, 0.25).otherwise(0.0) + F.when(F.col("surface") > 40, 0.20).otherwise(0.0)
    raw = x.withColumn("raw", 0.40 * F.col("norm") + 0.25 * (1 - risk) + 0.15 * 0.82 + 0.05 / (1 + F.col("ppm2")))
    edge = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    s = raw.crossJoin(F.broadcast(edge)).withColumn("score", F.try_divide(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")))
    return s.withColumn("decision", F.when(r("score", 6) > 0.75, "BUY").when(r("score", 6) < 0.40, "AVOID").otherwise("HOLD"))


_INVEST = ", x AS (SELECT *, greatest(0.048, least(0.092, 12 * greatest(price * (CASE property_type WHEN 'SMALL' THEN 0.068 WHEN 'LARGE' THEN 0.057 ELSE 0.062 END - CASE WHEN ppm2 > 7000 THEN 0.01 ELSE 0 END) / 12, 550) / price)) AS roi FROM listing), n AS (SELECT *, (rank() OVER (ORDER BY roi) + (count(*) OVER (PARTITION BY roi) - 1) / 2) / count(*) OVER () AS norm FROM x), w AS (SELECT *, 0.40 * norm + 0.25 * (1 - CASE WHEN price < 80000 THEN 0.25 ELSE 0 END - CASE WHEN surface > 40 THEN 0.20 ELSE 0 END) + 0.15 * 0.82 + 0.05 / (1 + ppm2) AS raw FROM n), s AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS score FROM w), v AS (SELECT *, CASE WHEN round(score, 6) > 0.75 THEN 'BUY' WHEN round(score, 6) < 0.40 THEN 'AVOID' ELSE 'HOLD' END AS decision FROM s) "


@query(_INVEST + "SELECT decision, count(*) AS n, round(avg(score), 3) AS mean_score, round(avg(roi), 4) AS mean_roi FROM v GROUP BY decision", True)
def r14_investment_decisions(spark: SparkSession, d: str) -> DataFrame:
    return invest(listings(spark, d)).groupBy("decision").agg(F.count("*").alias("n"), r(F.avg("score"), 3).alias("mean_score"), r(F.avg("roi")).alias("mean_roi"))


@query(", c AS (SELECT city, median(ppm2) AS m, count(*) AS n FROM listing GROUP BY city), q AS (SELECT quantile_cont(m, 0.75) AS p75 FROM c) SELECT city, n, round(m * 20, 2) AS predicted, round(m * 16, 2) AS low, round(m * 24, 2) AS high, greatest(45, least(95, round(70 + n / 50))) AS confidence FROM c, q WHERE m <= p75", True)
def r18_table_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = listings(spark, d).groupBy("city").agg(median("ppm2").alias("m"), F.count("*").alias("n"))
    q = c.agg(quantile("m", 0.75).alias("p75"))
    return c.crossJoin(F.broadcast(q)).where("m <= p75").select("city", "n", r(F.col("m") * 20, 2).alias("predicted"), r(F.col("m") * 16, 2).alias("low"), r(F.col("m") * 24, 2).alias("high"), clamp(F.round(70 + F.col("n") / 50), 45, 95).alias("confidence"))


@query("WITH m AS (SELECT n_name AS zone, median(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) SELECT zone, k AS month, round(m * (1 + 0.005 * k), 2) AS forecast, round(m * (1 + 0.005 * k) * 0.92, 2) AS low, round(m * (1 + 0.005 * k) * 1.08, 2) AS high FROM m, range(1, 7) t(k)")
def r20_forecast_points(spark: SparkSession, d: str) -> DataFrame:
    m = zoned_orders(spark, d).groupBy("zone").agg(median("price").alias("m")).select("zone", "m", F.explode(F.sequence(F.lit(1), F.lit(6)).cast("array<long>")).alias("month"))
    v = F.col("m") * (1 + 0.005 * F.col("month"))
    return m.select("zone", "month", r(v, 2).alias("forecast"), r(v * 0.92, 2).alias("low"), r(v * 1.08, 2).alias("high"))


@query("SELECT o_orderkey, greatest(0, least(100, CASE o_orderstatus WHEN 'F' THEN 60 WHEN 'O' THEN 40 ELSE 10 END * CASE o_orderpriority WHEN '1-URGENT' THEN 1.4 WHEN '2-HIGH' THEN 1.2 WHEN '5-LOW' THEN 0.7 ELSE 1 END + CASE WHEN o_totalprice > 400000 THEN 10 ELSE 0 END - least(15, 3 * (o_custkey % 7))))::DOUBLE AS risk FROM orders")
def r21_rule_risk(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("o_orderstatus") == "F", 60).when(F.col("o_orderstatus") == "O", 40).otherwise(10)
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 1.4).when(F.col("o_orderpriority") == "2-HIGH", 1.2).when(F.col("o_orderpriority") == "5-LOW", 0.7).otherwise(1.0)
    risk = base * weight + F.when(F.col("o_totalprice") > 400000, 10).otherwise(0) - F.least(F.lit(15), 3 * (F.col("o_custkey") % 7))
    return table(spark, d, "orders").select("o_orderkey", clamp(risk, 0.0, 100.0).alias("risk"))


@query("SELECT source, substr(md5(source), 1, 12) AS id, lang AS target, count(*) AS edges FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def r25_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang is not null").groupBy("source", F.col("lang").alias("target")).agg(F.count("*").alias("edges")).withColumn("id", F.substring(F.md5("source"), 1, 12))


@query(", c AS (SELECT city, median(ppm2) AS med FROM listing GROUP BY city), g AS (SELECT median(ppm2) AS nat FROM listing) SELECT CASE WHEN ppm2 > 1.1 * med THEN 'above' WHEN ppm2 < 0.9 * med THEN 'below' ELSE 'in line' END AS position, count(*) AS n, round(avg((ppm2 / med - 1) * 100), 2) AS vs_city, round(avg((ppm2 / nat - 1) * 100), 2) AS vs_nation FROM listing JOIN c USING (city), g GROUP BY position", True)
def r27_market_context(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("city", "ppm2"), "listings")
    c = with_quantiles(x, ["city"], {"med": ("ppm2", 0.5)}, F.count("*").alias("rows"))
    y = x.join(F.broadcast(c), "city").crossJoin(F.broadcast(with_quantiles(x, [], {"nat": ("ppm2", 0.5)}, F.count("*").alias("all"))))
    p = F.col("ppm2")
    return y.groupBy(F.when(p > 1.1 * F.col("med"), "above").when(p < 0.9 * F.col("med"), "below").otherwise("in line").alias("position")).agg(F.count("*").alias("n"), r(F.avg((p / F.col("med") - 1) * 100), 2).alias("vs_city"), r(F.avg((p / F.col("nat") - 1) * 100), 2).alias("vs_nation"))


@query("SELECT CASE WHEN value >= 250 THEN 'critical' WHEN value >= 200 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM events WHERE event_type = 'error' AND value >= 150 GROUP BY severity")
def r28_alert_routing(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").where("event_type = 'error' and value >= 150").groupBy(F.when(v >= 250, "critical").when(v >= 200, "high").otherwise("medium").alias("severity")).agg(F.count("*").alias("n"))


@query(", g AS (SELECT median(ppm2) AS med, greatest(stddev(ppm2), 1) AS sd FROM listing) SELECT city, count(*) AS n, round(max(abs(ppm2 - med) / sd), 4) AS worst FROM listing, g WHERE abs(ppm2 - med) / sd > 1.5 GROUP BY city", True)
def m3_anomalies(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("city", "ppm2"), "listings")
    g = with_quantiles(x, [], {"med": ("ppm2", 0.5)}, F.greatest(F.stddev_samp("ppm2"), F.lit(1.0)).alias("sd"))
    z = x.crossJoin(F.broadcast(g)).withColumn("z", F.abs(F.col("ppm2") - F.col("med")) / F.col("sd")).where("z > 1.5")
    return z.groupBy("city").agg(F.count("*").alias("n"), r(F.max("z")).alias("worst"))


@query("SELECT city, count(*) FILTER (ppm2 < 950 OR ppm2 > 2050) AS odd, count(*) AS n FROM listing GROUP BY city", True)
def m4_anomaly_rules(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("city").agg(F.count_if((F.col("ppm2") < 950) | (F.col("ppm2") > 2050)).alias("odd"), F.count("*").alias("n"))


@query("WITH x AS (SELECT value AS x, (ts < TIMESTAMP '2024-01-16')::INT AS one FROM events), s AS (SELECT x, sum(one) AS a, sum(1 - one) AS b FROM x GROUP BY x), t AS (SELECT sum(a) AS n1, sum(b) AS n2 FROM s), c AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb FROM s) SELECT round(max(abs(ca / n1 - cb / n2)), 6) AS d, n1::BIGINT AS n1, n2::BIGINT AS n2 FROM c, t GROUP BY n1, n2")
def m13_ks_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cut = F.lit("2024-01-16").cast("timestamp")
    return ks_distance(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "value")


@query("WITH s AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY event_type) SELECT event_type, round((b - a) / a, 4) AS shift, abs((b - a) / a) > 0.20 AS drifted FROM s")
def m13_mean_shift(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    s = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b")).withColumn("s", (F.col("b") - F.col("a")) / F.col("a"))
    return s.select("event_type", r("s").alias("shift"), (F.abs("s") > 0.20).alias("drifted"))


def validate(df: DataFrame, rules: list[tuple[str, bool, Column, float, float]]) -> DataFrame:
    """``(rule, critical, value, passed)`` of (name, critical, measure, least, most) rules, all measured in one aggregation."""
    one = df.agg(*(m.cast("double").alias(f"m{i}") for i, (_, _, m, _, _) in enumerate(rules)))
    made = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(c).alias("critical"), F.col(f"m{i}").alias("value"), F.coalesce(F.col(f"m{i}").between(lo, hi), F.lit(False)).alias("passed")) for i, (n, c, _, lo, hi) in enumerate(rules)))
    return one.select(F.explode(made).alias("x")).select("x.*")


_RULES = "SELECT 'rows' AS rule, true AS critical, count(*)::DOUBLE AS value, count(*) >= 10 AS passed FROM listing UNION ALL SELECT 'price in range', false, round(avg(CASE WHEN price BETWEEN 1000 AND 1e7 THEN 1.0 ELSE 0 END), 4), avg(CASE WHEN price BETWEEN 1000 AND 1e7 THEN 1.0 ELSE 0 END) >= 0.95 FROM listing UNION ALL SELECT 'surface in range', false, round(avg(CASE WHEN surface BETWEEN 5 AND 5000 THEN 1.0 ELSE 0 END), 4), round(avg(CASE WHEN surface BETWEEN 5 AND 5000 THEN 1.0 ELSE 0 END), 4) >= 0.95 FROM listing UNION ALL SELECT 'median ppm2', false, round(median(ppm2), 2), median(ppm2) BETWEEN 500 AND 8000 FROM listing UNION ALL SELECT 'cities', false, count(DISTINCT city), count(DISTINCT city) >= 5 FROM listing UNION ALL SELECT 'urls unique', true, round(count(DISTINCT url) / count(*), 4), count(DISTINCT url) = count(*) FROM listing UNION ALL SELECT 'price follows surface', false, round(corr(price, surface), 4), corr(price, surface) > 0.30 FROM listing"


@query(", v AS (" + _RULES + ") SELECT * FROM v", True)
def m14_validation(spark: SparkSession, d: str) -> DataFrame:
    top, x = float("inf"), listings(spark, d)
    med = F.lit(exact_quantiles(x, "ppm2", 0.5)[0]).cast("double")
    return validate(x, [
        ("rows", True, F.count("*"), 10, top), ("price in range", False, share(F.col("price").between(1000, 1e7)), 0.95, 1), ("surface in range", False, share(F.col("surface").between(5, 5000)), 0.95, 1),
        ("median ppm2", False, r(F.first(med), 2), 500, 8000), ("cities", False, F.count_distinct("city"), 5, top), ("urls unique", True, r(F.count_distinct("url") / F.count("*")), 1, 1), ("price follows surface", False, r(F.corr("price", "surface")), 0.300001, 1),
    ])


@query("SELECT event_type AS feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev(value), 4) AS sd, round(quantile_cont(value, 0.25), 4) AS p25, round(median(value), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM events GROUP BY event_type")
def b15_reference_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), r(quantile("value", 0.25)).alias("p25"), r(median("value")).alias("p50"), r(quantile("value", 0.75)).alias("p75"))


_PRED = "WITH p AS (SELECT doc_id, quality AS y, (length(regexp_replace(text, '[^*%$#&|!]', '', 'g')) < 0.02 * length(text))::INT AS g, least(0.99, 0.5 + length(text) / 10000.0) AS conf FROM labels JOIN documents USING (doc_id)) "


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    good = F.length(F.regexp_replace("text", "[^*%$#&|!]", "")) < 0.02 * F.length("text")
    return p.select("doc_id", F.col("quality").alias("y"), good.cast("int").alias("g"), F.least(F.lit(0.99), 0.5 + F.length("text") / 10000.0).alias("conf"))


@query(_PRED + "SELECT y::BIGINT AS truth, g::BIGINT AS predicted, count(*) AS n FROM p GROUP BY ALL")
def a30_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).groupBy(F.col("y").cast("long").alias("truth"), F.col("g").cast("long").alias("predicted")).agg(F.count("*").alias("n"))


@query(_PRED + ", c AS (SELECT count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn, count(*) FILTER (y = g) AS ok, count(*) AS n FROM p) SELECT round(ok / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS \"precision\", round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def a30_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    y, g = F.col("y"), F.col("g")
    c = _predicted(spark, d).agg(F.count_if((y == 1) & (g == 1)).alias("tp"), F.count_if((y == 0) & (g == 1)).alias("fp"), F.count_if((y == 1) & (g == 0)).alias("fn"), F.count_if(y == g).alias("ok"), F.count("*").alias("n"))
    tp, fp, fn = (F.col(k) for k in ("tp", "fp", "fn"))
    return c.select(r(F.col("ok") / F.col("n")).alias("accuracy"), r(F.try_divide(tp, tp + fp)).alias("precision"), r(F.try_divide(tp, tp + fn)).alias("recall"), r(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))


@query(_PRED + ", b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS conf, avg((y = g)::INT) AS acc FROM p GROUP BY bin) SELECT round(sum(n * abs(conf - acc)) / sum(n), 4) AS ece FROM b")
def a30_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    b = _predicted(spark, d).groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg((F.col("y") == F.col("g")).cast("int")).alias("a"))
    return b.agg(r(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean, CASE WHEN avg(o_totalprice) > 251000 THEN 'high' ELSE 'normal' END AS band FROM orders GROUP BY ALL")
def a24_risk_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 2).alias("mean"), F.when(F.avg("o_totalprice") > 251000, "high").otherwise("normal").alias("band"))


@query("WITH e AS (SELECT avg((quality = 0)::INT) AS q, avg((toxic = 1)::INT) AS t FROM labels), s AS (SELECT q, t, greatest(0, round(100 - 50 * t - 15 * q)) AS s FROM e) SELECT round(q, 4) AS low_quality, round(t, 4) AS toxic, s AS score, CASE WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' ELSE 'D' END AS grade FROM s")
def a25_reliability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labels").agg(F.avg((F.col("quality") == 0).cast("int")).alias("q"), F.avg((F.col("toxic") == 1).cast("int")).alias("t")).withColumn("s", F.greatest(F.lit(0.0), F.round(100 - 50 * F.col("t") - 15 * F.col("q"))))
    s = F.col("s")
    return e.select(r("q").alias("low_quality"), r("t").alias("toxic"), s.alias("score"), F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 55, "C").otherwise("D").alias("grade"))


@query("SELECT event_type AS step, json_extract_string(props, '$.k')::BIGINT // 10 AS tenth, count(*) AS n FROM events GROUP BY ALL")
def a27_lineage_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long").getField("k")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("step"), F.floor(k / 10).cast("long").alias("tenth")).agg(F.count("*").alias("n"))


@query(", t AS (SELECT city, count(*) FILTER (ppm2 < 1000) AS suspects, count(*) AS n FROM listing GROUP BY city) SELECT city, suspects, n, round(suspects * 100.0 / n, 2)::DOUBLE AS pct, CASE WHEN suspects * 100.0 / n > 12 THEN 'review' ELSE 'ok' END AS advice FROM t ORDER BY suspects DESC, city LIMIT 20", True)
def a36_suspect_report(spark: SparkSession, d: str) -> DataFrame:
    t = listings(spark, d).groupBy("city").agg(F.count_if(F.col("ppm2") < 1000).alias("suspects"), F.count("*").alias("n"))
    pct = F.col("suspects") * 100.0 / F.col("n")
    return t.select("city", "suspects", "n", r(pct, 2).alias("pct"), F.when(pct > 12, "review").otherwise("ok").alias("advice")).orderBy(F.desc("suspects"), "city").limit(20)
