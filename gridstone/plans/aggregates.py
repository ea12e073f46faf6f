"""Aggregations and territorial statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantiles, iqr_keep, mann_kendall, median, normal_cdf_sql, share, summarised, with_quantiles
from ..session import stored
from .base import listings, query, r, table

_SPATIAL = "count(*) AS n, round(median(price), 2) AS median_price, round(avg(price), 2) AS mean_price, min(price) AS min_price, max(price) AS max_price, round(median(surface), 2) AS median_surface, round(median(ppm2), 2) AS median_ppm2, round(avg(ppm2), 2) AS mean_ppm2"


def spatial(df: DataFrame, *by: str) -> DataFrame:
    """Count, price, surface and price-per-m2 statistics of each zone."""
    x = summarised(
        df, by, {"mp": ("price", 0.5), "ms": ("surface", 0.5), "mu": ("ppm2", 0.5)},
        F.count("*").alias("n"), F.avg("price").alias("ap"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("ppm2").alias("au"),
    )
    return x.select(*by, "n", r("mp", 2).alias("median_price"), r("ap", 2).alias("mean_price"), "min_price", "max_price", r("ms", 2).alias("median_surface"), r("mu", 2).alias("median_ppm2"), r("au", 2).alias("mean_ppm2"))


@query(f"SELECT city, {_SPATIAL} FROM listing GROUP BY city", True)
def a4_spatial_by_nation(spark: SparkSession, d: str) -> DataFrame:
    return spatial(listings(spark, d), "city")


@query(f"SELECT region, {_SPATIAL} FROM listing GROUP BY region", True)
def a4_spatial_by_region(spark: SparkSession, d: str) -> DataFrame:
    return spatial(listings(spark, d), "region")


@query(", c AS (SELECT region, city, property_type, count(*) AS n FROM listing GROUP BY ALL) SELECT region, city, property_type, n, row_number() OVER (PARTITION BY city ORDER BY n DESC, property_type) AS place FROM c QUALIFY place <= 3", True)
def a4_top_types_by_nation(spark: SparkSession, d: str) -> DataFrame:
    n = listings(spark, d).groupBy("region", "city", "property_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("n"), "property_type"))).where("place <= 3")


@query("SELECT property_type, count(*) AS n, round(median(price), 2) AS median_price, round(median(ppm2), 2) AS median_ppm2, count(*) FILTER (price > 80000) AS dear, count(*) FILTER (surface < 10) AS small FROM listing GROUP BY property_type", True)
def a1_market_stats(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("property_type").agg(F.count("*").alias("n"), r(median("price"), 2).alias("median_price"), r(median("ppm2"), 2).alias("median_ppm2"), F.count_if(F.col("price") > 80000).alias("dear"), F.count_if(F.col("surface") < 10).alias("small"))


@query("SELECT count(*) AS n, round(avg(price), 2) AS mean_price, count(*) FILTER (status = 'O') AS open_n, count(DISTINCT city) AS cities, max(seen) AS latest FROM listing", True)
def a2_dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).agg(F.count("*").alias("n"), r(F.avg("price"), 2).alias("mean_price"), F.count_if(F.col("status") == "O").alias("open_n"), F.count_distinct("city").alias("cities"), F.max("seen").alias("latest"))


@query("SELECT city, count(*) AS n, round(avg(CASE WHEN surface > 5 THEN ppm2 END), 2) AS mean_ppm2 FROM listing GROUP BY city ORDER BY n DESC, city LIMIT 20", True)
def a3_live_top_cities(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("city").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("surface") > 5, F.col("ppm2"))), 2).alias("mean_ppm2")).orderBy(F.desc("n"), "city").limit(20)


@query("SELECT source, count(*) AS n, round(avg(price), 2) AS mean_price FROM listing GROUP BY source", True)
def a3_live_by_source(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("source").agg(F.count("*").alias("n"), r(F.avg("price"), 2).alias("mean_price"))


@query("SELECT property_type, count(*) AS n FROM listing GROUP BY property_type ORDER BY n DESC, property_type LIMIT 8", True)
def a3_live_top_types(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("property_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "property_type").limit(8)


@query("SELECT city, count(*) AS n, round(median(price), 2) AS median_price, round(quantile_cont(price, 0.25), 2) AS q25, round(quantile_cont(price, 0.75), 2) AS q75, min(price) AS min_price, max(price) AS max_price FROM listing WHERE city = 'NATION_7' GROUP BY city", True)
def a6_zone_detail(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = listings(spark, d).where("city = 'NATION_7'").groupBy("city").agg(F.count("*").alias("n"), q.alias("q"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return out.select("city", "n", r(F.col("q")[1], 2).alias("median_price"), r(F.col("q")[0], 2).alias("q25"), r(F.col("q")[2], 2).alias("q75"), "min_price", "max_price")


AS_OF = "2001-11-05"


def days_on_market(df: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Days since first seen, a label by bands of 14, 60 and 120 days, and a negotiation score; a null date is unknown."""
    days = F.date_diff(F.to_date(F.lit(as_of)), F.to_date("seen")).cast("long")
    label = F.when(days.isNull(), "unknown").when(days < 14, "fresh").when(days < 60, "normal").when(days < 120, "long").otherwise("very long")
    score = F.when(days.isNull(), 0.5).when(days < 14, 0.10).when(days < 60, 0.35).when(days < 120, 0.65).otherwise(0.90)
    return df.withColumns({"days": days, "label": label, "negotiation": score})


_DOM = f", dom AS (SELECT *, date_diff('day', seen::DATE, DATE '{AS_OF}') AS days FROM listing) "


@query(_DOM + "SELECT label, count(*) AS n, round(avg(days), 2) AS mean_days, round(avg(negotiation), 4) AS mean_score FROM (SELECT days, CASE WHEN days < 14 THEN 'fresh' WHEN days < 60 THEN 'normal' WHEN days < 120 THEN 'long' ELSE 'very long' END AS label, CASE WHEN days < 14 THEN 0.10 WHEN days < 60 THEN 0.35 WHEN days < 120 THEN 0.65 ELSE 0.90 END::DOUBLE AS negotiation FROM dom) GROUP BY label", True)
def t14_days_on_market(spark: SparkSession, d: str) -> DataFrame:
    return days_on_market(listings(spark, d)).groupBy("label").agg(F.count("*").alias("n"), r(F.avg("days"), 2).alias("mean_days"), r(F.avg("negotiation")).alias("mean_score"))


@query(_DOM + "SELECT city, round(median(days), 2) AS median_days, round(avg(days), 2) AS mean_days, round(avg(CASE WHEN days > 60 THEN 1.0 ELSE 0 END), 4) AS over60, round(avg(CASE WHEN days > 120 THEN 1.0 ELSE 0 END), 4) AS over120, round(avg(CASE WHEN days < 14 THEN 1.0 ELSE 0 END), 4) AS fresh FROM dom GROUP BY city", True)
def a7_dom_stats(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("days")
    return days_on_market(listings(spark, d)).groupBy("city").agg(r(median("days"), 2).alias("median_days"), r(F.avg("days"), 2).alias("mean_days"), share(day > 60).alias("over60"), share(day > 120).alias("over120"), share(day < 14).alias("fresh"))


@query(", g AS (SELECT city, property_type, median(price) FILTER (status = 'O') / 100 AS rent, median(price) FILTER (status = 'F') AS sale, count(*) FILTER (status = 'O') AS rents, count(*) FILTER (status = 'F') AS sales FROM listing GROUP BY ALL) SELECT city, property_type, rents, sales, round(1200 * rent / sale, 2) AS gross, round(0.75 * round(1200 * rent / sale, 2), 4) AS net, CASE WHEN round(1200 * rent / sale, 2) >= 12.1 THEN 'excellent' WHEN round(1200 * rent / sale, 2) >= 12 THEN 'good' WHEN round(1200 * rent / sale, 2) >= 11.5 THEN 'fair' ELSE 'weak' END AS verdict FROM g WHERE rents >= 2 AND sales >= 2 AND rent <= 0.02 * sale", True)
def a8_rental_yield(spark: SparkSession, d: str) -> DataFrame:
    rent, sale = F.col("status") == "O", F.col("status") == "F"
    split = listings(spark, d).select("city", "property_type", "status", F.when(rent, F.col("price")).alias("let"), F.when(sale, F.col("price")).alias("sold"))
    g = summarised(split, ["city", "property_type"], {"rent": ("let", 0.5), "sale": ("sold", 0.5)}, F.count_if(rent).alias("rents"), F.count_if(sale).alias("sales")).withColumn("rent", F.col("rent") / 100)
    kept = g.where("rents >= 2 and sales >= 2 and rent <= 0.02 * sale").withColumn("gross", r(1200 * F.col("rent") / F.col("sale"), 2))
    verdict = F.when(F.col("gross") >= 12.1, "excellent").when(F.col("gross") >= 12, "good").when(F.col("gross") >= 11.5, "fair").otherwise("weak")
    return kept.select("city", "property_type", "rents", "sales", "gross", r(0.75 * F.col("gross"), 4).alias("net"), verdict.alias("verdict"))


@query("WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, median(o_totalprice) AS med FROM orders WHERE o_totalprice > 50000 GROUP BY ALL), b AS (SELECT median(med) AS base FROM m), x AS (SELECT mo, avg(med / base) AS index FROM m, b GROUP BY mo) SELECT mo::BIGINT AS month, round(index, 4) AS index, round((index - 1) * 100, 2) AS delta, CASE WHEN round((index - 1) * 100, 2) < -2 THEN 'favourable' WHEN round((index - 1) * 100, 2) > 3 THEN 'unfavourable' ELSE 'neutral' END AS verdict FROM x")
def a9_buying_window(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 50000")
    m = o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg(median("o_totalprice").alias("med"))
    x = m.crossJoin(F.broadcast(m.agg(median("med").alias("base")))).groupBy("mo").agg(F.avg(F.col("med") / F.col("base")).alias("i"))
    delta = r((F.col("i") - 1) * 100, 2)
    return x.select(F.col("mo").cast("long").alias("month"), r("i").alias("index"), delta.alias("delta"), F.when(delta < -2, "favourable").when(delta > 3, "unfavourable").otherwise("neutral").alias("verdict"))


_HISTORY = "price_history AS (SELECT part, first(ppm2 ORDER BY seen, url, price) AS first_price, last(ppm2 ORDER BY seen, url, price) AS last_price, count(*) AS n FROM listing GROUP BY part)"


def first_and_last(df: DataFrame, key: str = "part", value: str = "ppm2", order: tuple[str, ...] = ("seen", "url", "price")) -> DataFrame:
    """First and last value of each key by time, in one pass without a join."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(value, at).alias("first_price"), F.max_by(value, at).alias("last_price"), F.count("*").alias("n"))


@query(", " + _HISTORY + " SELECT part, n, round(first_price, 5) AS first_price, round(last_price, 5) AS last_price, round((last_price - first_price) / first_price * 100, 2) AS change FROM price_history WHERE n > 1 AND last_price < 0.98 * first_price", True)
def j1_price_drops(spark: SparkSession, d: str) -> DataFrame:
    return _drops(spark, d).select("part", "n", r("first_price", 5).alias("first_price"), r("last_price", 5).alias("last_price"), "change")


def _drops(spark: SparkSession, d: str) -> DataFrame:
    h = first_and_last(listings(spark, d)).where("n > 1 and last_price < 0.98 * first_price")
    return h.withColumn("change", r((F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100, 2))


@query(", " + _HISTORY + ", x AS (SELECT *, round((last_price - first_price) / first_price * 100, 2) AS change FROM price_history WHERE n > 1 AND last_price < 0.98 * first_price) SELECT count(*) AS n, round(avg(change), 2) AS mean_change, min(change) AS largest, round(sum(first_price - last_price), 2) AS savings FROM x", True)
def a10_price_drop_summary(spark: SparkSession, d: str) -> DataFrame:
    return _drops(spark, d).agg(F.count("*").alias("n"), r(F.avg("change"), 2).alias("mean_change"), F.min("change").alias("largest"), r(F.sum(F.col("first_price") - F.col("last_price")), 2).alias("savings"))


@query(", c AS (SELECT city, median(ppm2) AS med, avg(ppm2) AS mean, stddev(ppm2) AS sd, count(*) AS n FROM listing GROUP BY city), g AS (SELECT median(ppm2) AS med FROM listing) SELECT city, n, round(c.med, 2) AS median_ppm2, round(mean, 2) AS mean_ppm2, round(sd, 2) AS sd_ppm2, round(c.med / g.med, 4) AS ratio FROM c, g", True)
def a11_city_emergence_stats(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("city", "ppm2"), "listings")
    c = with_quantiles(x, ["city"], {"m": ("ppm2", 0.5)}, F.avg("ppm2").alias("mean"), F.stddev_samp("ppm2").alias("sd"), F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(with_quantiles(x, [], {"g": ("ppm2", 0.5)}, F.count("*").alias("all")))).select("city", "n", r("m", 2).alias("median_ppm2"), r("mean", 2).alias("mean_ppm2"), r("sd", 2).alias("sd_ppm2"), r(F.col("m") / F.col("g")).alias("ratio"))


@query("SELECT city, count(*) AS n, round(avg(price), 2) AS mean_price, round(median(price), 2) AS median_price, round(stddev(price), 2) AS sd_price, min(price) AS min_price, max(price) AS max_price, round(avg(surface), 2) AS mean_surface, round(avg(rooms), 2) AS mean_rooms FROM listing GROUP BY city HAVING count(*) >= 3", True)
def a12_price_model_city_stats(spark: SparkSession, d: str) -> DataFrame:
    x = summarised(
        listings(spark, d), ["city"], {"median_price": ("price", 0.5)},
        F.count("*").alias("n"), r(F.avg("price"), 2).alias("mean_price"), r(F.stddev_samp("price"), 2).alias("sd_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), r(F.avg("surface"), 2).alias("mean_surface"), r(F.avg("rooms"), 2).alias("mean_rooms"),
    )
    return x.where("n >= 3").withColumn("median_price", r("median_price", 2))


_QUARTERS = "WITH q AS (SELECT n_name AS zone, date_trunc('quarter', o_orderdate)::DATE AS quarter, median(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) "


def zoned_orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("zone"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("id"))


@query(_QUARTERS + ", x AS (SELECT zone, quarter, v, lag(v, 4) OVER (PARTITION BY zone ORDER BY quarter) AS earlier, row_number() OVER (PARTITION BY zone ORDER BY quarter DESC) AS k FROM q) SELECT zone, quarter, round(v, 2) AS latest, round(earlier, 2) AS year_ago, round((v - earlier) / earlier * 100, 2) AS yoy FROM x WHERE k = 1")
def a13_year_on_year(spark: SparkSession, d: str) -> DataFrame:
    q = grouped_quantiles(zoned_orders(spark, d).withColumn("quarter", F.date_trunc("quarter", "at").cast("date")), ["zone", "quarter"], {"v": ("price", 0.5)})
    w = Window.partitionBy("zone")
    x = q.withColumns({"e": F.lag("v", 4).over(w.orderBy("quarter")), "k": F.row_number().over(w.orderBy(F.desc("quarter")))}).where("k = 1")
    return x.select("zone", "quarter", r("v", 2).alias("latest"), r("e", 2).alias("year_ago"), r((F.col("v") - F.col("e")) / F.col("e") * 100, 2).alias("yoy"))


_MONTHS = "WITH m AS (SELECT n_name AS zone, date_trunc('month', o_orderdate)::DATE AS month, median(o_totalprice) AS med, avg(o_totalprice) AS mean, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) "


def monthly(spark: SparkSession, d: str) -> DataFrame:
    x = zoned_orders(spark, d).withColumn("month", F.date_trunc("month", "at").cast("date"))
    return summarised(x, ["zone", "month"], {"med": ("price", 0.5)}, F.avg("price").alias("mean"), F.count("*").alias("n"))


@query(_MONTHS + "SELECT zone, month, round(mean, 2) AS mean_price FROM m")
def a14_monthly_means(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).select("zone", "month", r("mean", 2).alias("mean_price"))


@query(_MONTHS + ", top AS (SELECT zone FROM m GROUP BY zone ORDER BY sum(n) DESC, zone LIMIT 15) SELECT zone, month, round(med, 2) AS median_price, round(mean, 2) AS mean_price, n FROM m WHERE zone IN (SELECT zone FROM top)")
def t1_time_series(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d)
    top = m.groupBy("zone").agg(F.sum("n").alias("volume")).orderBy(F.desc("volume"), "zone").limit(15)
    return m.join(F.broadcast(top), "zone", "left_semi").select("zone", "month", r("med", 2).alias("median_price"), r("mean", 2).alias("mean_price"), "n")


@query(_MONTHS + f", s AS (SELECT a.zone, sum(sign(b.med - a.med)) AS s FROM m a JOIN m b ON a.zone = b.zone AND a.month < b.month GROUP BY a.zone), k AS (SELECT zone, count(*) AS n FROM m GROUP BY zone), z AS (SELECT zone, n, s::BIGINT AS s, (CASE WHEN n < 4 OR s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) END)::DOUBLE AS z FROM k JOIN s USING (zone)), p AS (SELECT *, CASE WHEN n < 4 THEN 1.0 ELSE 2 * (1 - {normal_cdf_sql('abs(z)')}) END::DOUBLE AS p FROM z) SELECT zone, n, s, round(z, 4) AS z, round(p, 4) AS p, round(2.0 * s / (n * (n - 1)), 4)::DOUBLE AS tau, CASE WHEN n < 4 OR p >= 0.05 THEN 'stable' WHEN s > 0 THEN 'up' ELSE 'down' END AS trend FROM p")
def t2_mann_kendall(spark: SparkSession, d: str) -> DataFrame:
    return mann_kendall(monthly(spark, d), "zone", "month", "med")


@query(_MONTHS + ", x AS (SELECT zone, med, row_number() OVER (PARTITION BY zone ORDER BY month) - 1 AS i FROM m), g AS (SELECT zone, regr_slope(med, i) AS slope, regr_slope(med, i) / greatest(abs(avg(med)), 1e-9) AS rel FROM x GROUP BY zone) SELECT zone, round(slope, 4) AS slope, round(rel, 6) AS rel, CASE WHEN rel > 0.01 THEN 'up' WHEN rel < -0.01 THEN 'down' ELSE 'stable' END AS direction, CASE WHEN abs(rel) > 0.05 THEN 'high' WHEN abs(rel) > 0.01 THEN 'medium' ELSE 'low' END AS confidence FROM g")
def t3_linear_trend(spark: SparkSession, d: str) -> DataFrame:
    return linear_trend(monthly(spark, d))


def linear_trend(months: DataFrame) -> DataFrame:
    """Each zone's least-squares slope over its months, also in shares of its mean, with direction and confidence."""
    x = months.withColumn("i", F.row_number().over(Window.partitionBy("zone").orderBy("month")) - 1)
    g = x.groupBy("zone").agg(F.regr_slope("med", "i").alias("slope"), F.avg("med").alias("mean")).withColumn("rel", F.col("slope") / F.greatest(F.abs("mean"), F.lit(1e-9)))
    rel = F.col("rel")
    return g.select("zone", r("slope").alias("slope"), r(rel, 6).alias("rel"), F.when(rel > 0.01, "up").when(rel < -0.01, "down").otherwise("stable").alias("direction"), F.when(F.abs(rel) > 0.05, "high").when(F.abs(rel) > 0.01, "medium").otherwise("low").alias("confidence"))


def emerging(df: DataFrame, recent: int = 45, before: int = 90, least: int = 5) -> DataFrame:
    """Zones' growth of median price and volume over two adjoining windows before the latest time, a score of both, its class and severity."""
    as_of = df.agg(F.max("at").alias("as_of"))
    age = F.date_diff("as_of", "at")
    w = df.crossJoin(F.broadcast(as_of)).where(age < before).withColumn("now", age < recent)
    g = w.groupBy("zone").agg(median(F.when(F.col("now"), F.col("price"))).alias("mr"), median(F.when(~F.col("now"), F.col("price"))).alias("mp"), F.count_if("now").alias("n_recent"), F.count_if(~F.col("now")).alias("n_before")).where(F.col("n_recent") >= least)
    price = F.coalesce(F.try_divide(F.col("mr") - F.col("mp"), F.col("mp")), F.lit(0.0))
    volume = F.coalesce(F.try_divide(F.col("n_recent") - F.col("n_before"), F.col("n_before")), F.lit(1.0))
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    x = g.withColumns({"pg": price, "vg": volume}).withColumn("score", F.round(0.6 * clip(F.col("pg") / 0.30) + 0.4 * clip(F.col("vg") / 0.50), 3))
    up, more = F.col("pg") >= 0.08, F.col("vg") >= 0.20
    kind = F.when(up & more, "emerging").when(up, "price surge").when(more, "volume surge").when(F.col("pg") <= -0.08, "declining").otherwise("none")
    size = F.abs("score")
    out = x.withColumns({"class": kind, "severity": F.when(size > 0.7, "critical").when(size > 0.4, "high").otherwise("medium")})
    horizon = F.when(F.col("class") == "declining", 180).when(F.col("severity") == "critical", 30).when(F.col("severity") == "high", 45).otherwise(90)
    return out.select("zone", "n_recent", "n_before", r("pg").alias("price_growth"), r("vg").alias("volume_growth"), r(size, 3).alias("score"), "class", "severity", horizon.cast("long").alias("horizon"))


@query("WITH o AS (SELECT n_name AS zone, o_totalprice AS price, date_diff('day', o_orderdate, max(o_orderdate) OVER ()) AS age FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), g AS (SELECT zone, median(price) FILTER (age < 45) AS mr, median(price) FILTER (age >= 45) AS mp, count(*) FILTER (age < 45) AS n_recent, count(*) FILTER (age >= 45) AS n_before FROM o WHERE age < 90 GROUP BY zone HAVING count(*) FILTER (age < 45) >= 5), x AS (SELECT *, coalesce((mr - mp) / mp, 0) AS pg, coalesce((n_recent - n_before) / nullif(n_before, 0), 1) AS vg FROM g), y AS (SELECT *, round(0.6 * greatest(-1, least(1, pg / 0.30)) + 0.4 * greatest(-1, least(1, vg / 0.50)), 3) AS s, CASE WHEN pg >= 0.08 AND vg >= 0.20 THEN 'emerging' WHEN pg >= 0.08 THEN 'price surge' WHEN vg >= 0.20 THEN 'volume surge' WHEN pg <= -0.08 THEN 'declining' ELSE 'none' END AS class FROM x), z AS (SELECT *, CASE WHEN abs(s) > 0.7 THEN 'critical' WHEN abs(s) > 0.4 THEN 'high' ELSE 'medium' END AS severity FROM y) SELECT zone, n_recent, n_before, round(pg, 4) AS price_growth, round(vg, 4) AS volume_growth, round(abs(s), 3) AS score, class, severity, (CASE WHEN class = 'declining' THEN 180 WHEN severity = 'critical' THEN 30 WHEN severity = 'high' THEN 45 ELSE 90 END)::BIGINT AS horizon FROM z")
def t4_emerging_zones(spark: SparkSession, d: str) -> DataFrame:
    return emerging(zoned_orders(spark, d))


@query(_MONTHS + ", x AS (SELECT zone, med, row_number() OVER (PARTITION BY zone ORDER BY month DESC) AS k FROM m) SELECT zone, round(avg(med) FILTER (k <= 6), 2) AS mean_last, round(min(med) FILTER (k <= 6), 2) AS low, round(max(med) FILTER (k <= 6), 2) AS high FROM x GROUP BY zone")
def t9_forecast_slice(spark: SparkSession, d: str) -> DataFrame:
    x = monthly(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("month")))).where("k <= 6")
    return x.groupBy("zone").agg(r(F.avg("med"), 2).alias("mean_last"), r(F.min("med"), 2).alias("low"), r(F.max("med"), 2).alias("high"))


@query(_MONTHS + "SELECT zone, round((last(med ORDER BY month) / first(med ORDER BY month) - 1) * 100, 2) AS change, round(min(med), 2) AS low, round(max(med), 2) AS high, round(avg(med), 2) AS mean FROM m GROUP BY zone")
def t10_explain_series(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).groupBy("zone").agg(r((F.max_by("med", "month") / F.min_by("med", "month") - 1) * 100, 2).alias("change"), r(F.min("med"), 2).alias("low"), r(F.max("med"), 2).alias("high"), r(F.avg("med"), 2).alias("mean"))


@query("SELECT city, round(avg(ppm2), 2) AS roi, count(*) AS n FROM listing GROUP BY city ORDER BY avg(ppm2) DESC, city LIMIT 5", True)
def a15_top_cities(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("city").agg(F.avg("ppm2").alias("m"), F.count("*").alias("n")).orderBy(F.desc("m"), "city").limit(5).select("city", r("m", 2).alias("roi"), "n")


@query("SELECT least(floor(price / 2000), 59)::BIGINT AS bin, count(*) AS n FROM listing GROUP BY bin", True)
def a16_histogram(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy(F.least(F.floor(F.col("price") / 2000), F.lit(59)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT count(*) AS n, count(lang) AS lang, count(text) AS text, count(nullif(source, 'src0')) AS source FROM documents) SELECT 'lang' AS field, n - lang AS nulls, round((n - lang) * 100.0 / n, 2)::DOUBLE AS pct FROM c UNION ALL SELECT 'text', n - text, round((n - text) * 100.0 / n, 2)::DOUBLE FROM c UNION ALL SELECT 'source', n - source, round((n - source) * 100.0 / n, 2)::DOUBLE FROM c")
def a17_missing_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "text", F.nullif(F.col("source"), F.lit("src0")).alias("source"))
    c = docs.agg(F.count("*").alias("n"), *(F.count_if(F.col(x).isNull()).alias(x) for x in docs.columns))
    return c.unpivot("n", ["lang", "text", "source"], "field", "nulls").select("field", "nulls", r(F.col("nulls") * 100.0 / F.col("n"), 2).alias("pct"))


@query("SELECT count(*) AS n, round(avg(price), 2) AS mean, round(stddev(price), 2) AS sd, min(price) AS low, round(quantile_cont(price, 0.25), 2) AS q1, round(median(price), 2) AS med, round(quantile_cont(price, 0.75), 2) AS q3, max(price) AS high FROM listing", True)
def a18_describe(spark: SparkSession, d: str) -> DataFrame:
    x, p = stored(listings(spark, d).select("price"), "listings"), F.col("price")
    s = with_quantiles(x, [], {"q1": ("price", 0.25), "med": ("price", 0.5), "q3": ("price", 0.75)}, F.count("*").alias("n"), r(F.avg(p), 2).alias("mean"), r(F.stddev_samp(p), 2).alias("sd"), F.min(p).alias("low"), F.max(p).alias("high"))
    return s.select("n", "mean", "sd", "low", *(r(q, 2).alias(q) for q in ("q1", "med", "q3")), "high")


@query("SELECT round(corr(price, surface), 4) AS price_surface, round(corr(price, rooms), 4) AS price_rooms, round(corr(surface, rooms), 4) AS surface_rooms FROM listing", True)
def a19_correlations(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).agg(r(F.corr("price", "surface")).alias("price_surface"), r(F.corr("price", "rooms")).alias("price_rooms"), r(F.corr("surface", "rooms")).alias("surface_rooms"))


@query("SELECT city, round(avg(price), 2) AS mean_price, count(*) AS n FROM listing GROUP BY city ORDER BY avg(price) DESC, city LIMIT 15", True)
def a20_mean_price_by_city(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("city").agg(F.avg("price").alias("m"), F.count("*").alias("n")).orderBy(F.desc("m"), "city").limit(15).select("city", r("m", 2).alias("mean_price"), "n")


@query(", q AS (SELECT avg(CASE WHEN price BETWEEN 1000 AND 1e7 THEN 100.0 ELSE 0 END) AS validity, avg(CASE WHEN title IS NOT NULL AND surface IS NOT NULL THEN 100.0 ELSE 0 END) AS completeness, avg(CASE WHEN surface BETWEEN 5 AND 5000 THEN 100.0 ELSE 0 END) AS relevance, least(100.0, count(DISTINCT city) * 100.0 / 24) AS coverage FROM listing) SELECT round(validity, 2) AS validity, round(completeness, 2) AS completeness, round(relevance, 2) AS relevance, round(coverage, 2)::DOUBLE AS coverage, round((validity + completeness + relevance + coverage) / 4, 2)::DOUBLE AS score, CASE WHEN (validity + completeness + relevance + coverage) / 4 >= 85 THEN 'excellent' WHEN (validity + completeness + relevance + coverage) / 4 >= 70 THEN 'good' WHEN (validity + completeness + relevance + coverage) / 4 >= 55 THEN 'fair' ELSE 'weak' END AS label FROM q", True)
def a21_quality(spark: SparkSession, d: str) -> DataFrame:
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    q = listings(spark, d).agg(pct(F.col("price").between(1000, 1e7)).alias("validity"), pct(F.col("title").isNotNull() & F.col("surface").isNotNull()).alias("completeness"), pct(F.col("surface").between(5, 5000)).alias("relevance"), F.least(F.lit(100.0), F.count_distinct("city") * 100.0 / 24).alias("coverage"))
    names = ("validity", "completeness", "relevance", "coverage")
    score = sum((F.col(n) for n in names), F.lit(0.0)) / 4
    return q.select(*(r(n, 2).alias(n) for n in names), r(score, 2).alias("score"), F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 55, "fair").otherwise("weak").alias("label"))


@query("SELECT event_type AS source, count(*) AS n, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END), 4) AS high_rate, CASE WHEN count(*) < 2000 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY event_type")
def a22_source_health(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), share(F.col("value") > 100).alias("high_rate"), F.when(F.count("*") < 2000, "warning").otherwise("ok").alias("status"))


@query("SELECT count(*) AS n, round(avg(ppm2), 2) AS mean, round(median(ppm2), 2) AS med, round(quantile_cont(ppm2, 0.1), 2) AS p10, round(quantile_cont(ppm2, 0.9), 2) AS p90 FROM listing", True)
def a23_pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("ppm2"), "listings")
    s = with_quantiles(x, [], {"med": ("ppm2", 0.5), "p10": ("ppm2", 0.1), "p90": ("ppm2", 0.9)}, F.count("*").alias("n"), r(F.avg("ppm2"), 2).alias("mean"))
    return s.select("n", "mean", *(r(q, 2).alias(q) for q in ("med", "p10", "p90")))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 2) AS mean_length FROM conversations GROUP BY role")
def a31_chat_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), r(F.avg(F.length("text")), 2).alias("mean_length"))


@query(", s AS (SELECT city, ppm2, row_number() OVER (PARTITION BY city ORDER BY ppm2) AS k, count(*) OVER (PARTITION BY city) AS n FROM listing) SELECT city, n, round(ppm2, 2) AS upper_median FROM s WHERE k = n // 2 + 1", True)
def a32_upper_median(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("city")
    s = listings(spark, d).select("city", "ppm2").withColumns({"k": F.row_number().over(w.orderBy("ppm2")), "n": F.count("*").over(w)})
    return s.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("city", "n", r("ppm2", 2).alias("upper_median"))


@query("SELECT month, round(max(med) FILTER (zone = 'NATION_1'), 2) AS first_zone, round(max(med) FILTER (zone = 'NATION_2'), 2) AS second_zone FROM (" + _MONTHS.replace("WITH m AS (", "SELECT * FROM (") + ") WHERE zone IN ('NATION_1', 'NATION_2') GROUP BY month")
def a35_zone_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = monthly(spark, d).where("zone in ('NATION_1', 'NATION_2')").groupBy("month").pivot("zone", ["NATION_1", "NATION_2"]).agg(r(F.max("med"), 2))
    return p.select("month", F.col("NATION_1").alias("first_zone"), F.col("NATION_2").alias("second_zone"))


@query(", q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listing) SELECT city, count(*) AS n, max(price) AS high FROM listing, q WHERE price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) GROUP BY city", True)
def f3_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return iqr_keep(listings(spark, d), "price", 0.5).groupBy("city").agg(F.count("*").alias("n"), F.max("price").alias("high"))
