"""Answers for one user and whole reports: matches with reasons, bundles, shortlists with projections, backtests, explained forecasts, drift, territory, and the pipeline's run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, grouped_quantiles, ks_distance, mann_kendall, summarised
from .aggregates import emerging, linear_trend, monthly, zoned_orders
from .base import SQL, listings, query, r, table
from .composites import _TRUST_SQL, stacked, trusted
from .models import _QUADRATIC, _RATES, quadratic
from .scoring import _INVEST, _ZONES, clamp, invest


@dataclass(frozen=True)
class Profile:
    """What a buyer asks for; empty texts and zero rooms ask for nothing."""

    budget: float
    surface: float
    city: str = ""
    property_type: str = ""
    rooms: int = 0


BUYER = Profile(60_000.0, 20.0, "nation_7", rooms=2)


def matches(df: DataFrame, who: Profile) -> DataFrame:
    """Rows of ``df`` (with trust and legal risk, either may be null) that meet a profile, with five factors, ``score`` and up to three ``reasons``.

    The factors are nearness to 0.85 of the budget, surface beyond what is asked, nearness to the median price a square metre of all that match, trust, and legal safety.
    """
    f = df.where((F.col("price") <= who.budget) & (F.col("surface") >= who.surface))
    for column, wanted in (("city", who.city), ("property_type", who.property_type)):
        if wanted:
            f = f.where(F.lower(column) == wanted.lower())
    if who.rooms:
        f = f.where(F.col("rooms") >= who.rooms)
    middle = F.lit(exact_quantiles(f, "ppm2", 0.5)[0]).cast("double")
    fit = {
        "budget_fit": clamp(1 - F.abs(F.col("price") / who.budget - 0.85)),
        "surface_fit": F.least(F.lit(1.0), F.col("surface") / max(who.surface, 1) * 0.8) if who.surface > 0 else F.lit(0.7),
        "price_fit": F.when((middle > 0) & (F.col("ppm2") > 0), F.greatest(F.lit(0.0), 1 - F.abs(F.col("ppm2") / middle - 1) * 0.7)).otherwise(0.6),
        "trust": F.coalesce("trust", F.lit(0.65)), "legal": F.coalesce("legal", F.lit(0.2)),
    }
    x = f.withColumns(fit)
    said = F.filter(F.array(*(F.when(F.col(c) > least, name) for c, least, name in (("budget_fit", 0.75, "ideal budget"), ("surface_fit", 0.80, "enough surface"), ("price_fit", 0.75, "fair price"), ("trust", 0.75, "reliable")))), lambda v: v.isNotNull())
    score = 0.30 * F.col("budget_fit") + 0.20 * F.col("surface_fit") + 0.20 * F.col("price_fit") + 0.20 * F.col("trust") + 0.10 * (1 - F.col("legal"))
    return x.withColumns({"score": score, "reasons": F.when(F.size(said) == 0, "meets the criteria").otherwise(F.array_join(F.slice(said, 1, 3), ", "))})


_M = (
    _TRUST_SQL + ", f AS (SELECT *, CASE WHEN seller % 10 < 9 THEN (seller % 10) / 20 END AS risk FROM t WHERE price <= 60000 AND surface >= 20 AND lower(city) = 'nation_7' AND rooms >= 2), g AS (SELECT median(ppm2) AS mid FROM f), "
    "k AS (SELECT *, greatest(0, least(1, 1 - abs(price / 60000 - 0.85))) AS bf, least(1, surface / 20 * 0.8) AS sf, CASE WHEN mid > 0 AND ppm2 > 0 THEN greatest(0, 1 - abs(ppm2 / mid - 1) * 0.7) ELSE 0.6 END AS pf, coalesce(risk, 0.2) AS legal FROM f, g), "
    "m AS (SELECT *, 0.30 * bf + 0.20 * sf + 0.20 * pf + 0.20 * trust + 0.10 * (1 - legal) AS score, list_filter([CASE WHEN bf > 0.75 THEN 'ideal budget' END, CASE WHEN sf > 0.80 THEN 'enough surface' END, CASE WHEN pf > 0.75 THEN 'fair price' END, CASE WHEN trust > 0.75 THEN 'reliable' END], lambda x: x IS NOT NULL) AS why FROM k), "
    "best AS (SELECT * FROM m ORDER BY round(score, 6) DESC, url, part, seller LIMIT 5)"
)
_KEYS = ["url", "part", "seller"]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Listings with trust, and a legal risk by seller that some lack."""
    return trusted(listings(spark, d)).withColumn("legal", F.when(F.col("seller") % 10 < 9, (F.col("seller") % 10) / 20))


@query(_M + " SELECT url, part, seller, city, property_type, price, surface, round(ppm2, 2) AS ppm2, rooms, round(trust, 3) AS trust, round(legal, 3)::DOUBLE AS legal, round(score, 4) AS score, CASE WHEN len(why) = 0 THEN 'meets the criteria' ELSE array_to_string(why[1:3], ', ') END AS reasons FROM best", True)
def r11_personal_matches(spark: SparkSession, d: str) -> DataFrame:
    best = matches(_candidates(spark, d), BUYER).orderBy(F.desc(r("score", 6)), *_KEYS).limit(5)
    return best.select(*_KEYS, "city", "property_type", "price", "surface", r("ppm2", 2).alias("ppm2"), "rooms", r("trust", 3).alias("trust"), r("legal", 3).alias("legal"), r("score").alias("score"), "reasons")


def similar_to(df: DataFrame, ref: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of ``df`` nearest to the one row of ``ref``, which is left out, by standardised price a square metre and surface, with additions for another city or type."""
    sd = df.agg(F.stddev_samp("ppm2").alias("a"), F.stddev_samp("surface").alias("b"))
    q = ref.select(*(F.col(c).alias(f"q_{c}") for c in (*_KEYS, "ppm2", "surface", "city", "property_type")))
    own = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"q_{k}") for k in _KEYS))
    off = lambda c, s: (F.try_divide(F.col(c) - F.col(f"q_{c}"), F.col(s))) ** 2
    dist = F.sqrt(off("ppm2", "a") + off("surface", "b")) + 0.4 * (F.col("city") != F.col("q_city")).cast("int") + 0.2 * (F.col("property_type") != F.col("q_property_type")).cast("int")
    near = df.crossJoin(F.broadcast(sd)).crossJoin(F.broadcast(q)).where(~own).withColumn("dist", dist)  # one row each
    return near.orderBy(r("dist", 6), *_KEYS).limit(top).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.least(F.col("dist") / 5, F.lit(1.0))))


_ITEM = "url::VARCHAR || '/' || part || '/' || seller"


@query(
    _M + ", q AS (SELECT ppm2 AS p0, surface AS s0, city AS c0, property_type AS t0, url AS u0, part AS a0, seller AS e0 FROM best ORDER BY round(score, 6) DESC, url, part, seller LIMIT 1), sd AS (SELECT stddev(ppm2) AS a, stddev(surface) AS b FROM listing), "
    "near AS (SELECT url, part, seller, sqrt(((ppm2 - p0) / a) ** 2 + ((surface - s0) / b) ** 2) + 0.4 * (city <> c0)::INT + 0.2 * (property_type <> t0)::INT AS dist FROM listing, sd, q WHERE NOT (url = u0 AND part = a0 AND seller = e0) ORDER BY round(dist, 6), url, part, seller LIMIT 4), "
    "z(region, g, dem, inf, risk) AS (VALUES " + ", ".join(map(str, _ZONES)) + "), zs AS (SELECT region AS item, round(greatest(0, least(1, 10 * g * 0.35 + dem * 0.30 + inf * 0.20 - risk * 0.15)), 4)::DOUBLE AS value FROM z ORDER BY value DESC, item LIMIT 5) "
    f"SELECT 'matching' AS section, row_number() OVER (ORDER BY round(score, 6) DESC, url, part, seller) AS place, {_ITEM} AS item, round(score, 4) AS value, CASE WHEN len(why) = 0 THEN 'meets the criteria' ELSE array_to_string(why[1:3], ', ') END AS note FROM best "
    f"UNION ALL SELECT 'similar', row_number() OVER (ORDER BY round(dist, 6), url, part, seller), {_ITEM}, round(greatest(0, 1 - least(dist / 5, 1)), 4), '' FROM near "
    "UNION ALL SELECT 'zones', row_number() OVER (ORDER BY value DESC, item), item, value, CASE WHEN value >= 0.65 THEN 'excellent' WHEN value >= 0.50 THEN 'good' WHEN value >= 0.35 THEN 'fair' ELSE 'weak' END FROM zs", True,
)
def w12_daily_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The day's bundle: a profile's five best matches with reasons, the four listings most like the first of them, and the five best zones."""
    x = _candidates(spark, d)
    best = matches(x, BUYER).orderBy(F.desc(r("score", 6)), *_KEYS).limit(5)
    near = similar_to(x, best.orderBy(F.desc(r("score", 6)), *_KEYS).limit(1), 4)
    zones = spark.createDataFrame(_ZONES, "region string, g double, dem double, inf double, risk double").withColumn("value", r(clamp(10 * F.col("g") * 0.35 + F.col("dem") * 0.30 + F.col("inf") * 0.20 - F.col("risk") * 0.15))).orderBy(F.desc("value"), "region").limit(5)
    item = F.concat_ws("/", *_KEYS)
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long").alias("place")  # noqa: E731  (at most five rows each)
    note = F.when(F.col("value") >= 0.65, "excellent").when(F.col("value") >= 0.50, "good").when(F.col("value") >= 0.35, "fair").otherwise("weak")
    return stacked(
        best.select(F.lit("matching").alias("section"), place(F.desc(r("score", 6)), *_KEYS), item.alias("item"), r("score").alias("value"), F.col("reasons").alias("note")),
        near.select(F.lit("similar").alias("section"), place(r("dist", 6), *_KEYS), item.alias("item"), r("similarity").alias("value"), F.lit("").alias("note")),
        zones.select(F.lit("zones").alias("section"), place(F.desc("value"), "region"), F.col("region").alias("item"), "value", note.alias("note")),
    )


# investment --------------------------------------------------------------------------------------------------

BUDGET, PURSE = 60_000.0, 1_000_000.0
_P = (
    ", gr(region, g) AS (VALUES " + ", ".join(map(str, _RATES)) + "), near AS (SELECT count(*) AS near FROM v WHERE price <= 1.15 * 60000), "
    "pr AS (SELECT v.*, greatest(0.040, least(0.115, roi * (1 + 0.8 * coalesce(g, 0.033)))) AS projected FROM v LEFT JOIN gr USING (region), near WHERE price <= CASE WHEN near < 10 THEN 1.30 ELSE 1.15 END * 60000)"
)
_ORDER = "round(score, 9) DESC, url, part, seller"


def within_budget(spark: SparkSession, d: str, budget: float = BUDGET) -> DataFrame:
    """Scored listings up to 1.15 times the budget (1.30 where fewer than ten are), with their projected return."""
    scored = invest(listings(spark, d))
    reach = scored.agg((F.when(F.count_if(F.col("price") <= 1.15 * budget) < 10, 1.30).otherwise(1.15) * budget).alias("reach"))
    growth = spark.createDataFrame(_RATES, "region string, g double")
    x = scored.crossJoin(F.broadcast(reach)).where("price <= reach").join(F.broadcast(growth), "region", "left")
    return x.withColumn("projected", clamp(F.col("roi") * (1 + 0.8 * F.coalesce("g", F.lit(0.033))), 0.040, 0.115))


@query(_INVEST + _P + f", top AS (SELECT * FROM pr ORDER BY {_ORDER} LIMIT 60), c AS (SELECT *, sum(price) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) <= 1000000 AS selected FROM top), fi AS (SELECT *, least(1, score + CASE WHEN selected THEN 0.05 ELSE 0 END) AS final FROM c) SELECT url, part, seller, property_type, city, price, surface, round(roi, 4) AS roi, round(projected, 4) AS projected, decision, round(final, 4) AS final, selected, CASE WHEN len(why) = 0 THEN 'average' ELSE array_to_string(why, ', ') END AS why FROM (SELECT *, list_filter([CASE WHEN norm > 0.7 THEN 'high return' END, CASE WHEN price >= 80000 AND surface <= 40 THEN 'low risk' END, CASE WHEN price <= 0.8 * 60000 THEN 'well within budget' END], lambda x: x IS NOT NULL) AS why FROM fi) ORDER BY round(final, 9) DESC, {_ORDER} LIMIT 15", True)
def r15_personal_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best by final score: the score, and 0.05 for those that a purse would buy in the order of score (only of the 60 best, which is all that it can reach)."""
    order = [F.desc(r("score", 9)), *_KEYS]
    top = within_budget(spark, d).orderBy(*order).limit(60)
    spent = F.sum("price").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of 60 rows
    x = top.withColumn("selected", spent <= PURSE).withColumn("final", F.least(F.lit(1.0), F.col("score") + F.when(F.col("selected"), 0.05).otherwise(0.0)))
    why = F.filter(F.array(F.when(F.col("norm") > 0.7, "high return"), F.when((F.col("price") >= 80000) & (F.col("surface") <= 40), "low risk"), F.when(F.col("price") <= 0.8 * BUDGET, "well within budget")), lambda v: v.isNotNull())
    x = x.orderBy(F.desc(r("final", 9)), *order).limit(15)
    return x.select(*_KEYS, "property_type", "city", "price", "surface", r("roi").alias("roi"), r("projected").alias("projected"), "decision", r("final").alias("final"), "selected", F.when(F.size(why) == 0, "average").otherwise(F.array_join(why, ", ")).alias("why"))


def backtest(df: DataFrame) -> DataFrame:
    """``(n, mae, mape, precision5, mean_projected)``: how far projections lie from returns, and how many of the five best scores are among the ten best returns. Over all rows."""
    best = lambda column, k: df.orderBy(F.desc(r(column, 9)), *_KEYS).limit(k).select(*_KEYS)
    hit = best("score", 5).join(best("roi", 10), _KEYS, "left_semi").agg((F.count("*") / 5).alias("precision5"))
    gap = F.abs(F.col("roi") - F.col("projected"))
    one = df.agg(F.count("*").alias("n"), r(F.avg(gap), 5).alias("mae"), r(F.avg(gap / (F.col("roi") + 1e-9)) * 100, 2).alias("mape"), r(F.avg("projected")).alias("mean_projected"))
    return one.crossJoin(F.broadcast(hit))


_BACK = f"b AS (SELECT count(*) AS n, round(avg(abs(roi - projected)), 5) AS mae, round(avg(abs(roi - projected) / (roi + 1e-9)) * 100, 2) AS mape, round(avg(projected), 4) AS mean_projected FROM pr), h AS (SELECT count(*) / 5 AS precision5 FROM (SELECT url, part, seller FROM pr ORDER BY {_ORDER} LIMIT 5) JOIN (SELECT url, part, seller FROM pr ORDER BY round(roi, 9) DESC, url, part, seller LIMIT 10) USING (url, part, seller))"


@query(_INVEST + _P + ", " + _BACK + " SELECT * FROM b, h", True)
def t13_investment_backtest(spark: SparkSession, d: str) -> DataFrame:
    return backtest(within_budget(spark, d))


@query(_INVEST + _P + ", " + _BACK + ", k AS (SELECT count(*) AS analysed, round(avg(projected) * 100, 2) AS mean_return, count(*) FILTER (decision = 'BUY') AS buys FROM pr) SELECT analysed, mean_return, buys, mae, mape, precision5, 60000.0::DOUBLE AS budget FROM b, h, k", True)
def r15_key_figures(spark: SparkSession, d: str) -> DataFrame:
    x = within_budget(spark, d)
    k = x.agg(F.count("*").alias("analysed"), r(F.avg("projected") * 100, 2).alias("mean_return"), F.count_if(F.col("decision") == "BUY").alias("buys"))
    return k.crossJoin(F.broadcast(backtest(x))).select("analysed", "mean_return", "buys", "mae", "mape", "precision5", F.lit(BUDGET).alias("budget"))


# forecasts and trends ----------------------------------------------------------------------------------------

_MILES = ", ".join(f"max(forecast) FILTER (step = {i}) AS d{30 * i}, max(low) FILTER (step = {i}) AS d{30 * i}_low, max(high) FILTER (step = {i}) AS d{30 * i}_high" for i in (1, 2, 3))


@query(
    _QUADRATIC + f", k AS (SELECT zone, min_by(forecast, step) AS a, max_by(forecast, step) AS b, avg(forecast) AS mean, min(forecast) AS lo, max(forecast) AS hi, avg(high - low) AS width, {_MILES} FROM f GROUP BY zone), l AS (SELECT zone, max_by(y, month) AS last_known FROM m GROUP BY zone), n AS (SELECT median(y) AS national FROM m) "
    "SELECT zone, round((b - a) / (a + 1e-9) * 100, 2) AS trend_pct, CASE WHEN (b - a) / (a + 1e-9) * 100 > 3 THEN 'up' WHEN (b - a) / (a + 1e-9) * 100 < -3 THEN 'down' ELSE 'stable' END AS trend, round(mean, 2) AS mean_forecast, lo AS min_forecast, hi AS max_forecast, round(last_known, 2) AS last_known, round(width, 2) AS interval_width, round(width / (mean + 1e-9) * 100, 1) AS interval_pct, "
    "d30, d30_low, d30_high, d60, d60_low, d60_high, d90, d90_low, d90_high, round(national, 2) AS national, round((mean - national) / (national + 1e-9) * 100, 1) AS vs_national_pct, CASE WHEN (b - a) / (a + 1e-9) * 100 > 5 THEN 'positive' WHEN (b - a) / (a + 1e-9) * 100 < -5 THEN 'negative' ELSE 'neutral' END AS impact FROM k JOIN l USING (zone), n"
)
def t10_forecast_explanation(spark: SparkSession, d: str) -> DataFrame:
    """A zone's forecast in words' terms: trend from first to last, range, width of the band, milestones of one to three months, and its place against the nation."""
    months = monthly(spark, d)
    f = quadratic(months, 6)
    at = lambda c, i: F.max(F.when(F.col("step") == i, F.col(c)))
    miles = [at(c, i).alias(f"d{30 * i}{end}") for i in (1, 2, 3) for c, end in (("forecast", ""), ("low", "_low"), ("high", "_high"))]
    k = f.groupBy("zone").agg(F.min_by("forecast", "step").alias("a"), F.max_by("forecast", "step").alias("b"), F.avg("forecast").alias("mean"), F.min("forecast").alias("min_forecast"), F.max("forecast").alias("max_forecast"), F.avg(F.col("high") - F.col("low")).alias("width"), *miles)
    last = months.groupBy("zone").agg(F.max_by("med", "month").alias("last_known"))
    national = F.lit(exact_quantiles(months, "med", 0.5)[0]).cast("double")
    pct = (F.col("b") - F.col("a")) / (F.col("a") + 1e-9) * 100
    return k.join(last, "zone").select(
        "zone", r(pct, 2).alias("trend_pct"), F.when(pct > 3, "up").when(pct < -3, "down").otherwise("stable").alias("trend"), r("mean", 2).alias("mean_forecast"), "min_forecast", "max_forecast", r("last_known", 2).alias("last_known"),
        r("width", 2).alias("interval_width"), r(F.col("width") / (F.col("mean") + 1e-9) * 100, 1).alias("interval_pct"), *(f"d{30 * i}{end}" for i in (1, 2, 3) for end in ("", "_low", "_high")),
        r(national, 2).alias("national"), r((F.col("mean") - national) / (national + 1e-9) * 100, 1).alias("vs_national_pct"), F.when(pct > 5, "positive").when(pct < -5, "negative").otherwise("neutral").alias("impact"),
    )


_TOP = "(SELECT n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 15)"
_TRENDS = f"SELECT zone, slope, rel, confidence, k.n AS months, z, p, tau, k.trend AS direction FROM ({SQL['t3_linear_trend']}) l JOIN ({SQL['t2_mann_kendall']}) k USING (zone) WHERE zone IN {_TOP} AND k.n >= 2"


def zone_trends(months: DataFrame, top: int = 15) -> DataFrame:
    """Slope and Mann-Kendall test of the ``top`` zones by volume; a direction is only told where the test finds it."""
    volume = months.groupBy("zone").agg(F.sum("n").alias("volume")).orderBy(F.desc("volume"), "zone").limit(top)
    known = months.join(F.broadcast(volume), "zone", "left_semi")
    line = linear_trend(known).select("zone", "slope", "rel", "confidence")
    return line.join(mann_kendall(known, "zone", "month", "med"), "zone").where("n >= 2").select("zone", "slope", "rel", "confidence", F.col("n").alias("months"), "z", "p", "tau", F.col("trend").alias("direction"))


@query(_TRENDS)
def t1_zone_trends(spark: SparkSession, d: str) -> DataFrame:
    return zone_trends(monthly(spark, d))


_NATIONAL = "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, round(median(o_totalprice), 2) AS median_price, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY period"


@query(_NATIONAL)
def t1_national_series(spark: SparkSession, d: str) -> DataFrame:
    x = zoned_orders(spark, d).withColumn("period", F.date_format("at", "yyyy-MM"))
    return summarised(x, ["period"], {"median_price": ("price", 0.5)}, F.count("*").alias("n")).withColumn("median_price", r("median_price", 2))


def leaders(direction: str) -> Column:
    """The five zones of a direction with the largest slopes."""
    rows = F.array_sort(F.collect_list(F.when(F.col("direction") == direction, F.struct((-F.abs("slope")).alias("s"), "zone"))))  # of at most 15 zones
    return F.array_join(F.transform(F.slice(rows, 1, 5), lambda x: x["zone"]), ", ")


@query(f"WITH t AS ({_TRENDS}), p AS (SELECT min(period) AS period_start, max(period) AS period_end FROM ({_NATIONAL})) SELECT count(*) AS zones, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down, count(*) FILTER (direction = 'stable') AS stable, coalesce(array_to_string((list(zone ORDER BY -abs(slope), zone) FILTER (direction = 'up'))[1:5], ', '), '') AS top_up, coalesce(array_to_string((list(zone ORDER BY -abs(slope), zone) FILTER (direction = 'down'))[1:5], ', '), '') AS top_down, any_value(period_start) AS period_start, any_value(period_end) AS period_end FROM t, p")
def t1_summary(spark: SparkSession, d: str) -> DataFrame:
    months = monthly(spark, d)
    way = F.col("direction")
    t = zone_trends(months).agg(F.count("*").alias("zones"), *(F.count_if(way == v).alias(v) for v in ("up", "down", "stable")), leaders("up").alias("top_up"), leaders("down").alias("top_down"))
    p = months.agg(F.date_format(F.min("month"), "yyyy-MM").alias("period_start"), F.date_format(F.max("month"), "yyyy-MM").alias("period_end"))
    return t.crossJoin(F.broadcast(p))


_REGION_MONTHS = "SELECT 'series by region' AS section, region || ' ' || strftime(seen, '%Y-%m') AS item, round(median(price), 4)::DOUBLE AS value FROM listing GROUP BY 2"


@query(
    f" SELECT 'trend by zone' AS section, zone || ' ' || direction AS item, round(slope, 4)::DOUBLE AS value FROM ({_TRENDS}) UNION ALL {_REGION_MONTHS} UNION ALL SELECT 'spatial', city, round(median(ppm2), 4) FROM listing GROUP BY city UNION ALL SELECT 'spatial', region, round(median(ppm2), 4) FROM listing GROUP BY region "
    f"UNION ALL SELECT 'emerging', zone || ' ' || class, score FROM ({SQL['t4_emerging_zones']}) UNION ALL SELECT 'summary', 'listings', count(*) FROM listing UNION ALL SELECT 'summary', 'cities', count(DISTINCT city) FROM listing UNION ALL SELECT 'summary', 'regions', count(DISTINCT region) FROM listing "
    f"UNION ALL SELECT 'summary', 'days', date_diff('day', min(seen), max(seen)) FROM listing UNION ALL SELECT 'summary', 'emerging zones', count(*) FILTER (class = 'emerging') FROM ({SQL['t4_emerging_zones']}) UNION ALL SELECT 'summary', 'alerts', count(*) FILTER (class <> 'none') FROM ({SQL['t4_emerging_zones']})", True,
)
def t5_full_report(spark: SparkSession, d: str) -> DataFrame:
    """The territory's report as one long table: trends by zone, series by region, spatial medians, emerging zones and a summary."""
    x, zones = listings(spark, d), emerging(zoned_orders(spark, d))
    row = lambda section, item, value: (F.lit(section).alias("section"), item.alias("item"), r(value).cast("double").alias("value"))
    series = grouped_quantiles(x.withColumn("period", F.concat_ws(" ", "region", F.date_format("seen", "yyyy-MM"))), ["period"], {"v": ("price", 0.5)})
    facts = x.agg(F.count("*").alias("listings"), F.count_distinct("city").alias("cities"), F.count_distinct("region").alias("regions"), F.date_diff(F.max("seen"), F.min("seen")).cast("long").alias("days")).unpivot([], ["listings", "cities", "regions", "days"], "item", "v")
    alerts = zones.agg(F.count_if(F.col("class") == "emerging").alias("emerging zones"), F.count_if(F.col("class") != "none").alias("alerts")).unpivot([], ["emerging zones", "alerts"], "item", "v")
    return stacked(
        zone_trends(monthly(spark, d)).select(*row("trend by zone", F.concat_ws(" ", "zone", "direction"), F.col("slope"))), series.select(*row("series by region", F.col("period"), F.col("v"))),
        *(grouped_quantiles(x, [c], {"v": ("ppm2", 0.5)}).select(*row("spatial", F.col(c), F.col("v"))) for c in ("city", "region")),
        zones.select(*row("emerging", F.concat_ws(" ", "zone", "class"), F.col("score"))), *(y.select(*row("summary", F.col("item"), F.col("v"))) for y in (facts, alerts)),
    )


# drift and the run -------------------------------------------------------------------------------------------

DRIFT_AT = "1998-06-01"
DRIFTING = ("price", "surface", "ppm2", "rooms")


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """The asymptotic p of the two-sample distance; 1 where the series has nothing to tell."""
    n = F.try_divide(n1 * n2, n1 + n2)
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    total = reduce(lambda a, b: a + b, (2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)))
    return F.when(lam < 0.3, 1.0).otherwise(clamp(total))


def drift(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = DRIFTING, least: int = 30) -> DataFrame:
    """A row for each column with enough values on both sides: distance and p of the distributions, means, deviations, shift, whether it drifted and why, and what all columns ask for."""
    parts = []
    for c in columns:
        side = lambda df, end, c=c: df.agg(F.avg(c).alias(f"mean_{end}"), F.stddev_samp(c).alias(f"sd_{end}"), F.count(c).alias(f"n_{end}"))
        x = side(before, "before").crossJoin(side(after, "after")).crossJoin(ks_distance(before, after, c).select("d", "n1", "n2"))  # one row each
        parts.append(x.where(f"n_before >= {least} and n_after >= {least}").withColumn("column", F.lit(c)))
    x = stacked(*parts).withColumn("p", kolmogorov_p(F.col("d"), F.col("n1"), F.col("n2")))
    x = x.withColumn("shift", (F.col("mean_after") - F.col("mean_before")) / F.greatest(F.abs("mean_before"), F.lit(1e-9)))
    unlike, moved = F.col("p") < 0.05, F.abs("shift") > 0.20
    why = F.array_join(F.filter(F.array(F.when(unlike, "distribution"), F.when(moved & (F.col("shift") > 0), "mean rose"), F.when(moved & (F.col("shift") < 0), "mean fell")), lambda v: v.isNotNull()), ", ")
    x = x.withColumns({"drifted": unlike | moved, "reason": why, "severity": F.when(F.abs("shift") > 0.40, "critical").when(unlike | moved, "warning").otherwise("none")})
    every = Window.partitionBy()  # a row a column
    x = x.withColumn("n_drifted", F.count_if("drifted").over(every)).withColumn("action_required", F.col("n_drifted") >= 2)
    return x.select(
        "column", "drifted", r("d").alias("ks"), r("p").alias("p"), r("mean_before", 2).alias("mean_before"), r("mean_after", 2).alias("mean_after"), r("shift", 3).alias("shift"), r("sd_before", 2).alias("sd_before"), r("sd_after", 2).alias("sd_after"),
        "n_before", "n_after", "severity", "reason", "n_drifted", "action_required",
    )


_SIDES = f", x AS (SELECT col, v, seen < TIMESTAMP '{DRIFT_AT}' AS one FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, seen FROM listing" for c in DRIFTING) + ") WHERE v IS NOT NULL AND seen IS NOT NULL), "
_DRIFT = (
    _SIDES + "st AS (SELECT col, v, sum(one::INT) AS a, sum((NOT one)::INT) AS b FROM x GROUP BY ALL), cu AS (SELECT col, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM st WINDOW w AS (PARTITION BY col ORDER BY v)), "
    "k AS (SELECT col, avg(v) FILTER (one) AS m1, avg(v) FILTER (NOT one) AS m2, stddev(v) FILTER (one) AS s1, stddev(v) FILTER (NOT one) AS s2, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2 FROM x GROUP BY col), "
    "ks AS (SELECT col, round(max(abs(ca / n1 - cb / n2)), 6) AS d FROM cu JOIN k USING (col) GROUP BY col), l AS (SELECT *, (m2 - m1) / greatest(abs(m1), 1e-9) AS shift, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM k JOIN ks USING (col) WHERE n1 >= 30 AND n2 >= 30), "
    "pp AS (SELECT *, CASE WHEN lam < 0.3 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 21), lambda i: 2 * (-1) ** (i - 1) * exp(-2.0 * i * i * lam * lam))))) END AS p FROM l), "
    "dr AS (SELECT *, p < 0.05 OR abs(shift) > 0.20 AS drifted FROM pp)"
)


@query(_DRIFT + " SELECT col AS \"column\", drifted, round(d, 4) AS ks, round(p, 4)::DOUBLE AS p, round(m1, 2) AS mean_before, round(m2, 2) AS mean_after, round(shift, 3) AS shift, round(s1, 2) AS sd_before, round(s2, 2) AS sd_after, n1 AS n_before, n2 AS n_after, CASE WHEN abs(shift) > 0.40 THEN 'critical' WHEN drifted THEN 'warning' ELSE 'none' END AS severity, array_to_string(list_filter([CASE WHEN p < 0.05 THEN 'distribution' END, CASE WHEN shift > 0.20 THEN 'mean rose' END, CASE WHEN shift < -0.20 THEN 'mean fell' END], lambda v: v IS NOT NULL), ', ') AS reason, count(*) FILTER (drifted) OVER () AS n_drifted, (count(*) FILTER (drifted) OVER ()) >= 2 AS action_required FROM dr", True)
def m13_drift_report(spark: SparkSession, d: str) -> DataFrame:
    """Listings before and after a day, column by column."""
    x, cut = listings(spark, d), F.lit(DRIFT_AT).cast("timestamp")
    return drift(x.where(F.col("seen") < cut), x.where(F.col("seen") >= cut))


_RUN = (
    _DRIFT + ", raw AS (SELECT url, min(price) AS lowest, min(price) FILTER (seen < TIMESTAMP '" + DRIFT_AT + "') AS stored, arg_min({'price': price, 'surface': surface, 'kind': property_type, 'rooms': rooms, 'city': city}, {'price': price, 'seller': seller, 'part': part}) AS one, count(*) AS n FROM listing GROUP BY url), "
    "cl AS (SELECT * FROM raw WHERE one.price BETWEEN 1000 AND 1e7 AND one.surface BETWEEN 5 AND 5000), "
    "src AS (SELECT source, count(*) AS n, avg((price IS NULL)::INT) AS lost FROM listing GROUP BY source)"
)


@query(
    _RUN + ", c1 AS (SELECT count(*) AS n, sum(n) AS rows_in, avg((one.rooms IS NOT NULL AND one.city IS NOT NULL)::INT) AS complete FROM raw), c2 AS (SELECT count(*) AS n, count(*) FILTER (one.kind = 'STANDARD') AS filled, count(*) FILTER (stored IS NULL) AS ins, count(*) FILTER (stored <> lowest) AS upd, count(*) FILTER (stored = lowest) AS skp, count(DISTINCT one.city) AS cities FROM cl), "
    f"q AS (SELECT round(100 * (c2.n / c1.n + complete + least(1, cities / 25)) / 3, 2) AS quality FROM c1, c2), val AS (SELECT count(*) AS n, count(*) FILTER (passed) AS ok FROM ({SQL['m14_validation']})), dd AS (SELECT count(*) FILTER (drifted) AS n FROM dr) "
    "SELECT 1 AS step, 'health' AS stage, 'healthy sources' AS metric, count(*) FILTER (n > 0 AND lost <= 0.8)::DOUBLE AS value FROM src UNION ALL SELECT 1, 'health', 'fall back', (count(*) FILTER (n > 0 AND lost <= 0.8) = 0)::INT FROM src "
    "UNION ALL SELECT 2, 'ingest', 'rows', rows_in FROM c1 UNION ALL SELECT 3, 'lineage', 'stamped rows', rows_in FROM c1 UNION ALL SELECT 4, 'duplicates by key', 'removed', rows_in - n FROM c1 UNION ALL SELECT 5, 'duplicates by vector', 'removed', (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM (" + SQL["d12_embedding_dedup"] + ")) "
    "UNION ALL SELECT 6, 'clean', 'rows', n FROM c2 UNION ALL SELECT 7, 'enrich', 'types filled', filled FROM c2 UNION ALL SELECT 8, 'save', 'rows', n FROM c2 UNION ALL SELECT 9, 'drift', 'columns', n FROM dd UNION ALL SELECT 9, 'drift', 'action required', (n >= 2)::INT FROM dd "
    "UNION ALL SELECT 10, 'validate', 'passed', ok FROM val UNION ALL SELECT 10, 'validate', 'score', round(100.0 * ok / n, 1) FROM val UNION ALL SELECT 11, 'quality', 'score', quality FROM q UNION ALL SELECT 12, 'upsert', 'inserted', ins FROM c2 UNION ALL SELECT 12, 'upsert', 'updated', upd FROM c2 UNION ALL SELECT 12, 'upsert', 'skipped', skp FROM c2 "
    "UNION ALL SELECT 13, 'report', 'finished', (n < 2)::INT FROM dd", True,
)
def z7_stage_report(spark: SparkSession, d: str) -> DataFrame:
    """The run of the whole pipeline, stage by stage: what each took in, removed, filled, found and stored, and whether drift fails the run."""
    from .models import d12_embedding_dedup
    from .scoring import m14_validation

    x, cut = listings(spark, d), F.lit(DRIFT_AT).cast("timestamp")
    sources = x.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("price").isNull().cast("int")).alias("lost")).agg(F.count_if((F.col("n") > 0) & (F.col("lost") <= 0.8)).cast("double").alias("healthy"))
    health = sources.select(F.explode(F.array(_entry(1, "health", "healthy sources", F.col("healthy")), _entry(1, "health", "fall back", (F.col("healthy") == 0).cast("int")))).alias("e"))
    one = F.min_by(F.struct("price", "surface", F.col("property_type").alias("kind"), "rooms", "city"), F.struct("price", "seller", "part"))
    raw = x.groupBy("url").agg(F.min("price").alias("lowest"), F.min(F.when(F.col("seen") < cut, F.col("price"))).alias("stored"), one.alias("one"), F.count("*").alias("n"))
    clean = F.col("one.price").between(1000, 1e7) & F.col("one.surface").between(5, 5000)
    only = lambda c: F.count_if(clean & c)
    c = raw.agg(
        F.count("*").alias("urls"), F.sum("n").alias("rows_in"), F.avg((F.col("one.rooms").isNotNull() & F.col("one.city").isNotNull()).cast("int")).alias("complete"), F.count_if(clean).alias("clean"), only(F.col("one.kind") == "STANDARD").alias("filled"),
        only(F.col("stored").isNull()).alias("ins"), only(F.col("stored") != F.col("lowest")).alias("upd"), only(F.col("stored") == F.col("lowest")).alias("skp"), F.count_distinct(F.when(clean, F.col("one.city"))).alias("cities"),
    )
    quality = r(100 * (F.col("clean") / F.col("urls") + F.col("complete") + F.least(F.lit(1.0), F.col("cities") / 25)) / 3, 2)
    counted = c.select(F.explode(F.array(
        _entry(2, "ingest", "rows", F.col("rows_in")), _entry(3, "lineage", "stamped rows", F.col("rows_in")), _entry(4, "duplicates by key", "removed", F.col("rows_in") - F.col("urls")), _entry(6, "clean", "rows", F.col("clean")), _entry(7, "enrich", "types filled", F.col("filled")),
        _entry(8, "save", "rows", F.col("clean")), _entry(11, "quality", "score", quality), _entry(12, "upsert", "inserted", F.col("ins")), _entry(12, "upsert", "updated", F.col("upd")), _entry(12, "upsert", "skipped", F.col("skp")),
    )).alias("e"))
    vectors = table(spark, d, "embeddings").agg(F.count("*").alias("n")).crossJoin(d12_embedding_dedup(spark, d).agg(F.count("*").alias("kept")))
    alike = vectors.select(_entry(5, "duplicates by vector", "removed", F.col("n") - F.col("kept")).alias("e"))
    moved = m13_drift_report(spark, d).agg(F.count_if("drifted").alias("n"))
    drifted = moved.select(F.explode(F.array(_entry(9, "drift", "columns", F.col("n")), _entry(9, "drift", "action required", (F.col("n") >= 2).cast("int")), _entry(13, "report", "finished", (F.col("n") < 2).cast("int")))).alias("e"))
    checks = m14_validation(spark, d).agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    valid = checks.select(F.explode(F.array(_entry(10, "validate", "passed", F.col("ok")), _entry(10, "validate", "score", r(100.0 * F.col("ok") / F.col("n"), 1)))).alias("e"))
    return stacked(health, counted, alike, drifted, valid).select("e.*")


def _entry(step: int, stage: str, metric: str, value: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
