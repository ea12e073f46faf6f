"""Projections, filters, joins, deduplication, snapshots and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import average_ranks, exact_quantiles, place_among, summarised, with_quantiles
from ..functions.text import cosine, jaccard, normalised, trigrams
from ..operators import dedup
from ..session import stored
from .aggregates import zoned_orders
from .base import listings, query, r, table

# scans and filters -------------------------------------------------------------------------------------------


@query("SELECT url, price, seen, seller, part FROM listing WHERE city LIKE '%NATION_1%' AND price >= 100000 ORDER BY seen DESC, url, price, seller, part LIMIT 50", True)
def s5_load_listings(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where("city like '%NATION_1%' and price >= 100000").orderBy(F.desc("seen"), "url", "price", "seller", "part").limit(50).select("url", "price", "seen", "seller", "part")


@query("SELECT url, price, ppm2, seller, part FROM listing WHERE lower(city) = 'nation_3' ORDER BY ppm2 DESC, url, seller, part LIMIT 50", True)
def s6_load_city(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where(F.lower("city") == "nation_3").orderBy(F.desc("ppm2"), "url", "seller", "part").limit(50).select("url", "price", "ppm2", "seller", "part")


@query(", u AS (SELECT *, CASE source WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS priority FROM listing) SELECT url, source, price, seller, part FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, price, seller, part) = 1", True)
def s13_union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("url", "source", "price", "seller", "part")
    parts = [x.where(F.col("source") == s).withColumn("priority", F.lit(i)) for i, s in enumerate("ANR", 1)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return dedup.keep_first(union, ["url"], ["priority", "price", "seller", "part"]).drop("priority")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events WHERE event_type <> 'error'")
def s14_nested_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type <> 'error'").select("event_id", F.from_json("props", "k long").getField("k").alias("k"), "event_type")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, try_cast(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) AS number FROM pages")
def s17_url_parts(spark: SparkSession, d: str) -> DataFrame:
    e = F.regexp_extract
    return table(spark, d, "pages").select("page_id", e("url", "^https?://([^/]+)", 1).alias("host"), e("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"), e("url", r"/(\d+)", 1).try_cast("long").alias("number"))


@query("SELECT page_id, coalesce(split(split(regexp_replace(url, '^https?://', ''), '?')[1], '/')[2], '') AS kind, split(split(regexp_replace(url, '^https?://', ''), '/')[1], '.')[-1] AS domain FROM pages")
def s21_url_segments(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    seg = F.split(F.element_at(F.split(bare, r"\?"), 1), "/")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.get(seg, F.lit(1)), F.lit("")).alias("kind"), F.element_at(F.split(F.element_at(F.split(bare, "/"), 1), r"\."), -1).alias("domain"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages")
def s16_page_fields(spark: SparkSession, d: str) -> DataFrame:
    e = F.regexp_extract
    return table(spark, d, "pages").select("page_id", F.trim(e("html", "<title>([^<]*)</title>", 1)).alias("title"), e("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).cast("long").alias("links"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.value > 150)")
def s18_unseen_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.join(e.where("event_type = 'purchase' and value > 150").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("SELECT source, count(*) AS n, count(*) FILTER (price IS NULL) AS unknown FROM (SELECT source, CASE WHEN surface < 3 THEN NULL ELSE price END AS price FROM listing) WHERE price BETWEEN 5000 AND 90000 OR price IS NULL GROUP BY source", True)
def f1_range_keep_null(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("source", F.when(F.col("surface") >= 3, F.col("price")).alias("price"))
    return x.where(F.col("price").between(5000, 90000) | F.col("price").isNull()).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("unknown"))


@query("SELECT count(*) AS n, round(sum(price), 2) AS total FROM listing WHERE title LIKE '%ring%' AND price BETWEEN 10000 AND 80000 AND surface >= 10 AND property_type = 'SMALL'", True)
def f4_dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"title": ("contains", "ring"), "price": ("between", (10000, 80000)), "surface": ("least", 10), "property_type": ("equal", "SMALL")}
    tests = {"contains": lambda c, v: c.contains(v), "between": lambda c, v: c.between(*v), "least": lambda c, v: c >= v, "equal": lambda c, v: c == v}
    df = listings(spark, d)
    for name, (test, value) in wanted.items():
        df = df.where(tests[test](F.col(name), value))
    return df.agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))


@query("SELECT url, title, price, seller, part FROM listing WHERE (lower(title) LIKE '%widget%' OR lower(city) LIKE '%_4') AND price <= 60000 ORDER BY ppm2, url, price, seller, part LIMIT 30 OFFSET 30", True)
def f5_search_page(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where((F.lower("title").contains("widget") | F.lower("city").rlike(".4$")) & (F.col("price") <= 60000)).orderBy("ppm2", "url", "price", "seller", "part").offset(30).limit(30).select("url", "title", "price", "seller", "part")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR length(text) BETWEEN 200 AND 300")
def f7_keyword_or_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").contains("license") | F.length("text").between(200, 300)).select("doc_id")


@query(", a AS (SELECT * FROM listing WHERE price <= (SELECT quantile_cont(price, 0.99) FROM listing)) SELECT count(*) AS n, round(sum(price), 2) AS total FROM a WHERE surface <= (SELECT quantile_cont(surface, 0.99) FROM a)", True)
def f8_p99_trim(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    for c in ("price", "surface"):
        x = x.where(F.col(c) <= F.lit(exact_quantiles(x, c, 0.99)[0]).cast("double"))
    return x.agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))


@query("SELECT doc_id FROM (SELECT doc_id, nullif(lang, 'en') AS a, nullif(source, 'src0') AS b, CASE WHEN n_chars > 1000 THEN n_chars END AS c FROM documents) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2")
def f9_enough_known(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("a"), F.nullif(F.col("source"), F.lit("src0")).alias("b"), F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("c"))
    return x.na.drop(thresh=2, subset=["a", "b", "c"]).select("doc_id")


# joins -------------------------------------------------------------------------------------------------------


@query(", f AS (SELECT part, min(price) AS low FROM listing GROUP BY part HAVING count(*) > 30) SELECT f.part, low, p_name AS title, p_brand AS brand FROM f LEFT JOIN part ON p_partkey = f.part", True)
def j2_drops_with_attributes(spark: SparkSession, d: str) -> DataFrame:
    f = listings(spark, d).groupBy("part").agg(F.min("price").alias("low"), F.count("*").alias("n")).where("n > 30")
    return f.join(table(spark, d, "part").dropDuplicates(["p_partkey"]), F.col("part") == F.col("p_partkey"), "left").select("part", "low", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


@query(", c AS (SELECT city, property_type, median(ppm2) AS med, stddev(ppm2) AS sd, count(*) AS n FROM listing GROUP BY ALL), g AS (SELECT median(ppm2) AS med, stddev(ppm2) AS sd FROM listing) SELECT l.source, count(*) AS n, round(avg(greatest(0, 1 - abs(ppm2 - CASE WHEN c.n >= 5 THEN c.med ELSE g.med END) / CASE WHEN c.n >= 5 THEN c.sd ELSE g.sd END / 4)), 6) AS mean_score FROM listing l JOIN c USING (city, property_type), g GROUP BY l.source", True)
def j4_row_with_city_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    c = summarised(x, ["city", "property_type"], {"med": ("ppm2", 0.5)}, F.stddev_samp("ppm2").alias("sd"), F.count("*").alias("n"))
    g = x.agg(F.lit(exact_quantiles(x, "ppm2", 0.5)[0]).cast("double").alias("gmed"), F.stddev_samp("ppm2").alias("gsd"))
    own = F.col("n") >= 5
    z = F.abs(F.col("ppm2") - F.when(own, F.col("med")).otherwise(F.col("gmed"))) / F.when(own, F.col("sd")).otherwise(F.col("gsd"))
    both = x.join(c, ["city", "property_type"]).crossJoin(F.broadcast(g)).withColumn("score", F.greatest(F.lit(0.0), 1 - z / 4))
    return both.groupBy("source").agg(F.count("*").alias("n"), r(F.avg("score"), 6).alias("mean_score"))


@query("SELECT r_name AS region, n_name AS city, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def j5_city_to_region(spark: SparkSession, d: str) -> DataFrame:
    s, n, g = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("city")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS subscriber, count(*) AS matches FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal <= c_acctbal WHERE c_acctbal > 8000 GROUP BY c_custkey")
def j9_subscription_matches(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").where("c_acctbal > 8000"), table(spark, d, "supplier")
    return counted_below(
        c.select(F.col("c_custkey").alias("subscriber"), F.col("c_nationkey").alias("city"), F.col("c_acctbal").alias("limit")), s.select(F.col("s_nationkey").alias("city"), F.col("s_acctbal").alias("price")), "city", "limit", "price", "matches"
    ).where("matches > 0").select("subscriber", "matches")


def counted_below(asked: DataFrame, held: DataFrame, key: str, limit: str, value: str, out: str) -> DataFrame:
    """``asked`` with ``out``: how many rows of ``held`` have its key and a value of at most its limit. A rank join: both sides are put in one order, and counts run along it, so no pair is made."""
    rows = asked.withColumns({"__at": F.col(limit).cast("double"), "__held": F.lit(0)}).unionByName(held.select(key, F.col(value).cast("double").alias("__at"), F.lit(1).alias("__held")), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.where(F.col(key).isNotNull() & F.col("__at").isNotNull()).withColumn(out, F.sum("__held").over(upto)).where("__held = 0").drop("__at", "__held")


_SUBS = "s AS (SELECT c_custkey AS subscriber, list_value('nation_' || c_nationkey, 'nation_' || (c_nationkey + 1) % 25) AS cities, c_acctbal * 3 AS budget, c_custkey % 40 AS least, CASE WHEN c_mktsegment = 'BUILDING' THEN ['LARGE', 'STANDARD'] WHEN c_mktsegment = 'MACHINERY' THEN ['SMALL'] ELSE [] END AS kinds, 0.5 + (c_custkey % 5) * 0.1 AS trust_min FROM customer WHERE c_acctbal > 9000)"


@query(", c AS (SELECT city, median(ppm2) AS med, stddev(ppm2) AS sd FROM listing GROUP BY city), t AS (SELECT listing.*, round(0.7 * greatest(0, 1 - abs(ppm2 - med) / sd / 4) + 0.3 * CASE source WHEN 'A' THEN 0.92 WHEN 'N' THEN 0.78 ELSE 0.65 END, 4) AS trust FROM listing JOIN c USING (city)), " + _SUBS + " SELECT subscriber, count(*) AS matches, min(price) AS cheapest, round(avg(trust), 4) AS mean_trust FROM s JOIN t ON list_contains(cities, lower(city)) AND price <= budget AND surface >= least AND (len(kinds) = 0 OR list_contains(kinds, property_type)) AND trust >= trust_min GROUP BY subscriber", True)
def j9_alert_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each subscription's listings by all five conditions: any of its cities, budget, surface, types (none: any) and trust.

    Least surface and trust are told by the key modulo 40, so they are at most 40 pairs, whatever the number of subscriptions. Listings are summed by city, type, range of prices (cut at budgets) and pair; a subscription takes the sums of the
    ranges below its budget's, and meets single listings of its own range only.
    """
    from .composites import trusted

    c = table(spark, d, "customer").where("c_acctbal > 9000")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("LARGE"), F.lit("STANDARD"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("SMALL"))).otherwise(F.array(F.lit("*")))
    subs = c.select(key.alias("subscriber"), F.explode(F.array_distinct(F.array(F.concat(F.lit("nation_"), nation), F.concat(F.lit("nation_"), (nation + 1) % 25)))).alias("place"), (F.col("c_acctbal") * 3).alias("budget"), (key % 40).alias("least"), kinds.alias("kinds"), (0.5 + (key % 5) * 0.1).alias("trust_min"))
    subs = subs.withColumn("kind", F.explode("kinds")).drop("kinds")
    cuts = sorted(set(subs.select(F.percentile_approx("budget", [i / 1024 for i in range(1, 1024)], 10_000)).first()[0] or []))
    band = lambda c: place_among(F.col(c).cast("double"), cuts)
    subs = stored(subs.withColumn("band", band("budget")), "subscriptions")
    asked = subs.select("least", "trust_min").distinct()  # at most 40
    most = subs.agg(F.max("budget").alias("most"))
    x = stored(listings(spark, d).select("city", "property_type", "source", "price", "surface", "ppm2"), "listings")
    dear = trusted(x, with_quantiles(x, ["city"], {"med": ("ppm2", 0.5)}, F.stddev_samp("ppm2").alias("sd"))).join(F.broadcast(most), F.col("price") <= F.col("most"))
    seen = stored(dear.select(F.lower("city").alias("place"), "property_type", "price", "surface", "trust", band("price").alias("band")), "seen")
    kinds = F.explode(F.array("property_type", F.lit("*")))  # a subscription asks for types or for any, so no listing counts twice
    good = (F.col("surface") >= F.col("least")) & (F.col("trust") >= F.col("trust_min"))
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("total").alias("total")]
    steps = asked.agg(F.collect_set("least").alias("leasts"), F.collect_set("trust_min").alias("trusts"))
    level = lambda c, over: F.size(F.filter(over, lambda v: v <= F.col(c)))
    # equal to the conditions: listings of one level of surface and of trust meet or miss each pair together
    cells = seen.crossJoin(F.broadcast(steps)).groupBy("place", "property_type", "band", level("surface", "leasts").alias("l"), level("trust", "trusts").alias("t")).agg(
        F.count("*").alias("n"), F.min("price").alias("low"), F.sum("trust").alias("total"), F.min("surface").alias("surface"), F.min("trust").alias("trust")
    )
    upto = Window.partitionBy("place", "kind", "least", "trust_min").orderBy("band").rangeBetween(Window.unboundedPreceding, -1)
    ranges = cells.join(F.broadcast(asked), good).withColumn("kind", kinds).groupBy("place", "kind", "least", "trust_min", "band").agg(*sums)
    # a row for each range that a subscription of the pair asks from, so that sums end there
    wanted = subs.select("place", "kind", "least", "trust_min", "band").distinct()
    empty = wanted.select("*", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("total"))
    whole = ranges.unionByName(empty).groupBy("place", "kind", "least", "trust_min", "band").agg(*sums)
    below = whole.select("place", "kind", "least", "trust_min", "band", *(f(c).over(upto).alias(c) for f, c in ((F.sum, "n"), (F.min, "low"), (F.sum, "total"))))
    first = subs.join(below, ["place", "kind", "least", "trust_min", "band"]).where("n > 0").select("subscriber", "n", "low", "total")
    near = subs.join(seen.withColumn("kind", kinds), ["place", "kind", "band"]).where(good & (F.col("price") <= F.col("budget")))
    met = first.unionByName(near.select("subscriber", F.lit(1).cast("long").alias("n"), F.col("price").alias("low"), F.col("trust").alias("total"))).groupBy("subscriber")
    return met.agg(F.sum("n").alias("matches"), F.min("low").alias("cheapest"), r(F.sum("total") / F.sum("n")).alias("mean_trust"))


@query("SELECT count(*) AS sent FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal <= c_acctbal WHERE c_acctbal > 8000")
def b10_alerts_sent(spark: SparkSession, d: str) -> DataFrame:
    return j9_subscription_matches(spark, d).agg(F.sum("matches").alias("sent"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20 OFFSET 5")
def j13_history_page(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered")).orderBy(F.desc("conv_id")).offset(5).limit(20)


@query("SELECT c_custkey, coalesce(s.segment, 'default') AS segment FROM customer LEFT JOIN (VALUES ('building', 'premium'), ('machinery', 'industrial'), ('household', 'standard')) s(k, segment) ON lower(c_mktsegment) = k")
def j14_segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("building", "premium"), ("machinery", "industrial"), ("household", "standard")], "k string, segment string")
    return table(spark, d, "customer").join(F.broadcast(dim), F.lower("c_mktsegment") == F.col("k"), "left").select("c_custkey", F.coalesce("segment", F.lit("default")).alias("segment"))


@query(", g AS (SELECT surface, city, property_type, seen, count(*) AS n, count(DISTINCT source) AS sources FROM listing GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT source) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS rows FROM g", True)
def j15_cross_source_groups(spark: SparkSession, d: str) -> DataFrame:
    g = listings(spark, d).groupBy("surface", "city", "property_type", "seen").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("n > 1 and sources > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


@query("WITH c AS (SELECT p_partkey AS id, p_retailprice AS v FROM part WHERE p_partkey % 2 = 1), i AS (SELECT p_partkey AS id, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS v FROM part WHERE p_partkey % 3 <> 2) SELECT coalesce(c.id, i.id) AS id, CASE WHEN c.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'removed' ELSE 'changed' END AS change, round(i.v - c.v, 2) AS delta FROM c FULL JOIN i ON c.id = i.id WHERE c.id IS NULL OR i.id IS NULL OR c.v <> i.v")
def j11_change_set(spark: SparkSession, d: str) -> DataFrame:
    now, before = snapshots(spark, d)
    return dedup.changes(now, before, "id", "v").withColumn("delta", r("delta", 2))


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    now = p.where("p_partkey % 3 <> 2").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + F.when(F.col("p_partkey") % 7 == 0, 10).otherwise(0)).alias("v"), F.col("p_name").alias("title"))
    return now, p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"), F.col("p_name").alias("title"))


# snapshots ---------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT p_partkey AS id, p_retailprice AS v FROM part WHERE p_partkey % 2 = 1), i AS (SELECT p_partkey AS id, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS v FROM part WHERE p_partkey % 3 <> 2) SELECT CASE WHEN c.id IS NULL THEN 'insert' WHEN i.id IS NULL THEN 'keep' WHEN c.v <> i.v THEN 'update' ELSE 'skip' END AS action, count(*) AS n FROM c FULL JOIN i ON c.id = i.id GROUP BY action")
def k1_upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    now, before = snapshots(spark, d)
    return dedup.upsert(before, now, "id", ["v", "title"]).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, substr(sha256(concat_ws('|', p_name, p_brand, p_type, p_size::VARCHAR)), 1, 16) AS digest FROM part")
def k2_row_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")), 256), 1, 16).alias("digest"))


@query(", h AS (SELECT part, seen, url, price, lag(price) OVER (PARTITION BY part ORDER BY seen, url, price) AS before FROM listing) SELECT part, url, before AS old_price, price AS new_price, round((price - before) / before * 100, 2) AS change FROM h WHERE before IS NOT NULL AND abs(price - before) > 60000", True)
def k3_price_history(spark: SparkSession, d: str) -> DataFrame:
    h = listings(spark, d).withColumn("old_price", F.lag("price").over(Window.partitionBy("part").orderBy("seen", "url", "price")))
    return h.where("old_price is not null and abs(price - old_price) > 60000").select("part", "url", "old_price", F.col("price").alias("new_price"), r((F.col("price") - F.col("old_price")) / F.col("old_price") * 100, 2).alias("change"))


@query("SELECT doc_id, left(text, 2000) AS description, coalesce(lang, 'unknown') AS lang, round(n_chars / nullif(n_chars - length(text), 0), 2) AS density FROM documents")
def k4_row_data(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 2000).alias("description"), F.coalesce("lang", F.lit("unknown")).alias("lang"), r(F.try_divide("n_chars", F.col("n_chars") - F.length("text")), 2).alias("density"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL")
def k6_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type in ('view', 'purchase')").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("SELECT p_partkey AS id, coalesce(n.v, p_retailprice) AS v FROM part LEFT JOIN (SELECT p_partkey AS id, p_retailprice * 2 AS v FROM part WHERE p_partkey % 5 = 0) n ON n.id = p_partkey WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_retailprice * 2 FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 2 <> 0")
def k8_update_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    held, new = p.where("id % 2 = 0"), p.where("id % 5 = 0").select("id", (F.col("v") * 2).alias("w"))
    return held.join(new, "id", "full_outer").select("id", F.coalesce("w", "v").alias("v"))


@query("SELECT event_type, arg_max(user_id, total) AS best_run, max(total) AS best FROM (SELECT event_type, user_id, round(sum(value), 2) AS total FROM events GROUP BY ALL) GROUP BY event_type")
def k11_best_run(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("event_type", "user_id").agg(r(F.sum("value"), 2).alias("total"))
    return t.groupBy("event_type").agg(F.max_by("user_id", "total").alias("best_run"), F.max("total").alias("best"))


# deduplication -----------------------------------------------------------------------------------------------


@query(", a AS (SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY url ORDER BY seen, price, part, seller) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY surface, city, property_type, rooms ORDER BY url) = 1) SELECT city, count(*) AS n, round(sum(price), 2) AS total FROM b GROUP BY city", True)
def d1_remove_duplicates(spark: SparkSession, d: str) -> DataFrame:
    a = dedup.keep_first(listings(spark, d), ["url"], ["seen", "price", "part", "seller"])
    return dedup.keep_first_where_known(a, ["surface", "city", "property_type", "rooms"], ["url"]).groupBy("city").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT text) AS texts, count(*) - count(DISTINCT text) AS copies FROM documents")
def d2_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), (F.count("*") - F.count_distinct("text")).alias("copies"))


_NORM = "trim(regexp_replace(translate(lower(coalesce({}, '')), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest, length({_NORM.format('text')}) AS size FROM documents")
def d3_normalised_text(spark: SparkSession, d: str) -> DataFrame:
    n = normalised(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("size"))


@query("SELECT (CASE WHEN price <= 0 THEN -1 ELSE floor(price / 15000) * 15000 END)::BIGINT AS block, city, count(*) AS n FROM listing GROUP BY ALL", True)
def d4_price_blocks(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy(dedup.price_block(F.col("price")).alias("block"), "city").agg(F.count("*").alias("n"))


_TRI = "list_distinct(CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)) END)"


@query(f"WITH p AS (SELECT DISTINCT p_name AS t FROM part), x AS (SELECT t, {_TRI.format('t')} AS g FROM p) SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 4) AS score FROM x a JOIN x b ON a.t < b.t AND split(a.t, ' ')[1] = split(b.t, ' ')[1]")
def d5_trigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_name").alias("t")).distinct().select("t", trigrams(F.col("t")).alias("g"), F.split("t", " ")[0].alias("block"))
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.t") < F.col("b.t"))).select(F.col("a.t").alias("a"), F.col("b.t").alias("b"), r(jaccard(F.col("a.g"), F.col("b.g"))).alias("score"))


def _sample_listings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") * 10).alias("price"), (F.col("s_suppkey") % 40 + 20).cast("double").alias("surface"), F.col("s_name").alias("title"), F.col("n_name").alias("city"))


_FUZZY = f"WITH s AS (SELECT s_suppkey AS id, s_acctbal * 10 AS price, (s_suppkey % 40 + 20)::DOUBLE AS surface, n_name AS city, {_NORM.format('s_name')} AS t FROM supplier JOIN nation ON n_nationkey = s_nationkey), x AS (SELECT *, CASE WHEN price <= 0 THEN -1 ELSE floor(price / 15000) * 15000 END AS block, {_TRI.format('t')} AS g FROM s), p AS (SELECT a.id AS a, b.id AS b, round(0.30 * coalesce(1 - abs(a.price - b.price) / greatest(abs(a.price), abs(b.price)), 0.5) + 0.25 * (1 - abs(a.surface - b.surface) / greatest(a.surface, b.surface)) + 0.25 * len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) + 0.2, 4) AS score FROM x a JOIN x b ON a.block = b.block AND a.city = b.city AND a.id < b.id)"


@query(_FUZZY + " SELECT * FROM p WHERE score >= 0.7")
def d6_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fuzzy_pairs(_sample_listings(spark, d), threshold=0.7)


@query(_FUZZY.replace("s_suppkey AS id", "(s_suppkey % 3) * 1000000000000 + s_suppkey AS id").replace("p AS", "q AS") + f", p AS (SELECT a, b FROM q WHERE score >= 0.7), {dedup.GREEDY_SQL} SELECT id % 1000000000000 AS id FROM x, gone WHERE NOT list_contains(ids, id)")
def d7_fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Survivors in the order of the source's priority, then id: both are one number, by which rows are visited. Three sources are told by the id here."""
    x = _sample_listings(spark, d).withColumn("turn", F.col("id") % 3 * 1_000_000_000_000 + F.col("id"))
    return dedup.fuzzy_survivors(x, "turn", 0.7).select((F.col("turn") % 1_000_000_000_000).alias("id"))


@query(", t AS (SELECT url, count(*) OVER (PARTITION BY surface, city, property_type, seen) - 1 AS twins FROM listing) SELECT round(CASE WHEN twins = 0 THEN 0.9 WHEN twins <= 2 THEN 0.7 ELSE greatest(0.3, 0.7 - 0.1 * twins) END, 2)::DOUBLE AS risk, count(*) AS n FROM t GROUP BY risk", True)
def d13_duplicate_risk(spark: SparkSession, d: str) -> DataFrame:
    twins = F.count("*").over(Window.partitionBy("surface", "city", "property_type", "seen")) - 1
    x = listings(spark, d).select(twins.alias("twins"))
    risk = F.when(F.col("twins") == 0, 0.9).when(F.col("twins") <= 2, 0.7).otherwise(F.greatest(F.lit(0.3), 0.7 - 0.1 * F.col("twins")))
    return x.groupBy(F.round(risk, 2).alias("risk")).agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 20 = 0) SELECT qid, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 4) AS score FROM q JOIN embeddings e ON e.label = q.label AND vec_id <> qid WHERE list_cosine_similarity(q, embedding::DOUBLE[]) > 0.2")
def d11_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    return q.join(e, "label").where("vec_id <> qid").withColumn("s", cosine("q", "embedding")).where("s > 0.2").select("qid", "vec_id", r("s").alias("score"))


@query("SELECT source, lang, md5(concat_ws('|', source, lang, text)) AS k, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def d19_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    k = F.md5(F.concat_ws("|", "source", "lang", "text"))
    return table(spark, d, "documents").groupBy("source", "lang", k.alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# windows -----------------------------------------------------------------------------------------------------


@query(", f AS (SELECT part, arg_min(price, seen::VARCHAR || lpad(url::VARCHAR, 12, '0') || lpad(price::VARCHAR, 12, '0')) AS a FROM listing GROUP BY part) SELECT count(*) AS n FROM f", True)
def w1_keys_with_first(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("part").agg(F.min_by("price", F.struct("seen", "url", "price")).alias("a")).agg(F.count("*").alias("n"))


@query(", c AS (SELECT city, count(*) AS n FROM listing GROUP BY city) SELECT city, n, row_number() OVER (ORDER BY n DESC, city) AS place FROM c QUALIFY place <= 15", True)
def w2_top_zones(spark: SparkSession, d: str) -> DataFrame:
    c = listings(spark, d).groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(15)
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "city")))


@query("SELECT s_suppkey, round((rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2) / count(*) OVER (), 6) AS pct FROM supplier")
def w3_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return average_ranks(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "pct").select("s_suppkey", r("pct", 6).alias("pct"))


@query(", t AS (SELECT url, ppm2, city, price, part, seller FROM listing WHERE property_type = 'PROMO' ORDER BY ppm2 DESC, url, part, seller LIMIT 25) SELECT *, row_number() OVER (ORDER BY ppm2 DESC, url, part, seller) AS place FROM t", True)
def w4_ranked_top(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("ppm2"), "url", "part", "seller"]
    t = listings(spark, d).where("property_type = 'PROMO'").orderBy(*order).limit(25).select("url", "ppm2", "city", "price", "part", "seller")
    return t.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT event_id, user_id, ts, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 50")
def w7_history_of_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "ts", "value")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number FROM conversations")
def w8_sequence_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("number", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).select("conv_id", "turn", "number")


@query("WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM c) SELECT event_type, day, n, round(base, 4) AS base, round((base - n) / base * 100, 2) AS fall, CASE WHEN (base - n) / base > 0.2 THEN 'warning' ELSE 'ok' END AS status FROM b")
def w9_rolling_baseline(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    b = c.withColumn("b", F.avg("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-10, -1)))
    fall = (F.col("b") - F.col("n")) / F.col("b")
    return b.select("event_type", "day", "n", r("b").alias("base"), r(fall * 100, 2).alias("fall"), F.when(fall > 0.2, "warning").otherwise("ok").alias("status"))


@query("WITH c AS (SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY day) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta, round(total - lag(total) OVER (ORDER BY day), 2) AS value_delta FROM c")
def b16_run_deltas(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))
    w = Window.orderBy("day")  # one row a day
    return c.select("day", "n", (F.col("n") - F.lag("n").over(w)).alias("delta"), r(F.col("total") - F.lag("total").over(w), 2).alias("value_delta"))


@query("SELECT user_id, event_type, max(ts) AS latest, max(ts) + INTERVAL 60 MINUTE > TIMESTAMP '2024-01-30 12:00:00' AS active, count(*) AS hits FROM events GROUP BY ALL")
def r26_ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("latest"), F.count("*").alias("hits"))
    return g.withColumn("active", F.col("latest").cast("timestamp_ntz") + F.expr("INTERVAL 60 MINUTES") > F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("SELECT zone, month, n FROM (SELECT n_name AS zone, month(o_orderdate)::BIGINT AS month, quarter(o_orderdate) AS q, count(*) AS n, avg(weekofyear(o_orderdate)) AS w FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) WHERE w > 10")
def p4_temporal_parts(spark: SparkSession, d: str) -> DataFrame:
    x = zoned_orders(spark, d).groupBy("zone", F.month("at").cast("long").alias("month"), F.quarter("at").alias("q")).agg(F.count("*").alias("n"), F.avg(F.weekofyear("at")).alias("w"))
    return x.where("w > 10").select("zone", "month", "n")
