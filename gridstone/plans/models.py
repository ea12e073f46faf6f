"""Models and grouped-map operators: forecasts, clusters, forests, greedy selections."""

from __future__ import annotations

import difflib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arima, semantic, trees
from ..functions.stats import exact_quantiles, grouped_quantiles, narrow_quantiles
from ..functions.text import cosine
from ..operators import dedup
from ..operators.vectors import unlike_vectors
from ..session import shared_folder, stored
from .aggregates import monthly
from .base import listings, query, r, table
from .scoring import _INVEST, _trust, invest

# forecasts ---------------------------------------------------------------------------------------------------


def quadratic(points: DataFrame, periods: int, key: str = "zone", at: str = "month", value: str = "med") -> DataFrame:
    """``(key, step, forecast, low, high)``: a parabola by least squares through each key's points in order, ``periods`` steps ahead, with a band of 1.96 population deviations of the residuals.

    By orthogonal polynomials of the place, so that sums over a key's points give the coefficients. Two points make a line, one a constant.
    """
    n, place = F.count("*").over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
    line = lambda x: x - (F.col("n") - 1) / 2
    bend = lambda u: u * u - (F.col("n") * F.col("n") - 1) / 12
    x = points.select(key, F.col(value).alias("y"), n.alias("n"), place.alias("x")).withColumn("u", line(F.col("x"))).withColumn("v", bend(F.col("u")))
    part = lambda c: F.coalesce(F.try_divide(F.sum(F.col("y") * F.col(c)), F.sum(F.col(c) * F.col(c))), F.lit(0.0))
    fit = x.groupBy(key, "n").agg(F.avg("y").alias("b0"), part("u").alias("b1"), part("v").alias("b2"))
    centre = F.col("b0") + F.col("b1") * F.col("u") + F.col("b2") * F.col("v")
    fit = x.join(fit, [key, "n"]).groupBy(key, "n", "b0", "b1", "b2").agg((1.96 * F.sqrt(F.avg((F.col("y") - centre) ** 2))).alias("band"))
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)).cast("array<long>"))).withColumn("u", line(F.col("n") - 1 + F.col("step"))).withColumn("v", bend(F.col("u")))
    return ahead.select(key, "step", r(centre, 2).alias("forecast"), r(centre - F.col("band"), 2).alias("low"), r(centre + F.col("band"), 2).alias("high"))


_QUADRATIC = (
    "WITH m AS (SELECT n_name AS zone, date_trunc('month', o_orderdate) AS month, median(o_totalprice) AS y FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), "
    "p AS (SELECT zone, y, count(*) OVER (PARTITION BY zone) AS n, row_number() OVER (PARTITION BY zone ORDER BY month) - 1 - (count(*) OVER (PARTITION BY zone) - 1) / 2.0 AS u FROM m), "
    "x AS (SELECT *, u * u - (n * n - 1) / 12.0 AS v FROM p), "
    "c AS (SELECT zone, n, avg(y) AS b0, coalesce(sum(y * u) / nullif(sum(u * u), 0), 0) AS b1, coalesce(sum(y * v) / nullif(sum(v * v), 0), 0) AS b2 FROM x GROUP BY zone, n), "
    "e AS (SELECT zone, c.n, b0, b1, b2, 1.96 * sqrt(avg((y - b0 - b1 * u - b2 * v) ** 2)) AS band FROM x JOIN c USING (zone) GROUP BY zone, c.n, b0, b1, b2), "
    "s AS (SELECT zone, k AS step, band, b0 + b1 * ((n - 1) / 2.0 + k) + b2 * (((n - 1) / 2.0 + k) ** 2 - (n * n - 1) / 12.0) AS centre FROM e, range(1, 7) t(k)), "
    "f AS (SELECT zone, step, round(centre, 2) AS forecast, round(centre - band, 2) AS low, round(centre + band, 2) AS high FROM s)"
)


@query(_QUADRATIC + " SELECT * FROM f")
def t7_quadratic_forecast(spark: SparkSession, d: str) -> DataFrame:
    return quadratic(monthly(spark, d), 6)


@query(_QUADRATIC + ", g AS (SELECT zone, min_by(forecast, step) AS a, max_by(forecast, step) AS b, avg(high - low) AS width FROM f GROUP BY zone) SELECT zone, round((b - a) / a, 4) AS change, CASE WHEN (b - a) / a > 0.02 THEN 'up' WHEN (b - a) / a < -0.02 THEN 'down' ELSE 'stable' END AS trend, round(width, 2) AS width FROM g")
def t6_forecast_with_trend(spark: SparkSession, d: str) -> DataFrame:
    f = t7_quadratic_forecast(spark, d).groupBy("zone").agg(F.min_by("forecast", "step").alias("a"), F.max_by("forecast", "step").alias("b"), F.avg(F.col("high") - F.col("low")).alias("width"))
    change = (F.col("b") - F.col("a")) / F.col("a")
    return f.select("zone", r(change).alias("change"), F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("stable").alias("trend"), r("width", 2).alias("width"))


SEASONAL = "zone string, step long, value double, fitted double, forecast double, low double, high double, aic double, bic double, adf double, adf_p double, growth double"


def seasonal(pdf: pd.DataFrame, season: int = 4, horizon: int = 6, least: int = 8) -> pd.DataFrame:
    """A zone's model of order (1, 1, 1) with a seasonal part (1, 1, 0) by exact likelihood: history with one-step predictions at steps up to 0, forecasts with a band of 95 % beyond; AIC, BIC, the unit-root test and growth on each row."""
    pdf = pdf.sort_values("quarter")
    y = pdf["v"].to_numpy(float)
    names = [c.split()[0] for c in SEASONAL.split(", ")]
    if len(y) < max(least, season + 3):
        return pd.DataFrame(columns=names)
    model = arima.fit(y, season)
    mean, error = model.forecast(horizon)
    tau, p = arima.dickey_fuller(y)
    past, none = pd.DataFrame({"step": range(1 - len(y), 1), "value": y, "fitted": model.fitted()}), np.nan
    ahead = pd.DataFrame({"step": range(1, horizon + 1), "forecast": mean, "low": mean - 1.959964 * error, "high": mean + 1.959964 * error})
    out = pd.concat([past, ahead], ignore_index=True).assign(aic=model.aic, bic=model.bic, adf=tau, adf_p=p, growth=(mean[-1] / y[-1] - 1) * 100 if y[-1] else none)
    return out.round({"value": 2, "fitted": 2, "forecast": 2, "low": 2, "high": 2, "aic": 2, "bic": 2, "adf": 4, "adf_p": 4, "growth": 2}).assign(zone=pdf["zone"].iloc[0])[names]


@query()
def t8_seasonal_model(spark: SparkSession, d: str) -> DataFrame:
    """One zone's quarters are a task's, which is bounded by time, not by rows."""
    q = monthly(spark, d).groupBy("zone", F.date_trunc("quarter", "month").cast("date").alias("quarter")).agg(F.avg("med").alias("v"))
    return q.groupBy("zone").applyInPandas(lambda p: seasonal(p), SEASONAL)


@query(_QUADRATIC + ", g AS (SELECT zone, max_by(forecast, step) AS ahead FROM f GROUP BY zone), w AS (SELECT zone, max_by(y, month) AS now FROM m GROUP BY zone HAVING count(*) >= 8) SELECT zone, round(greatest(ahead, now), 2) AS projected, round(greatest(0.02, least(0.18, ahead / now - 1)), 4)::DOUBLE AS roi FROM w JOIN g USING (zone)")
def t11_projected_prices(spark: SparkSession, d: str) -> DataFrame:
    f = t7_quadratic_forecast(spark, d).groupBy("zone").agg(F.max_by("forecast", "step").alias("ahead"))
    now = monthly(spark, d).groupBy("zone").agg(F.max_by("med", "month").alias("now"), F.count("*").alias("n")).where("n >= 8")
    return now.join(f, "zone").select("zone", r(F.greatest("ahead", "now"), 2).alias("projected"), r(F.greatest(F.lit(0.02), F.least(F.lit(0.18), F.col("ahead") / F.col("now") - 1))).alias("roi"))


_RATES = [("AFRICA", 0.030), ("AMERICA", 0.038), ("ASIA", 0.055), ("EUROPE", 0.033)]


@query(", g(region, g) AS (VALUES " + ", ".join(map(str, _RATES)) + "), x AS (SELECT city, price, coalesce(g, 0.033) AS g FROM listing LEFT JOIN g USING (region)) SELECT city, round(avg(price * power(1 + g, 3)), 2) AS projected, round(avg(greatest(0.040, least(0.115, 0.06 * (1 + 0.8 * g)))), 4) AS roi FROM x GROUP BY city", True)
def t12_compound_projection(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame(_RATES, "region string, g double")
    x = listings(spark, d).join(F.broadcast(g), "region", "left").withColumn("g", F.coalesce("g", F.lit(0.033)))
    return x.groupBy("city").agg(r(F.avg(F.col("price") * F.pow(1 + F.col("g"), 3)), 2).alias("projected"), r(F.avg(F.greatest(F.lit(0.040), F.least(F.lit(0.115), 0.06 * (1 + 0.8 * F.col("g")))))).alias("roi"))


@query("WITH m AS (SELECT n_name AS zone, date_trunc('month', o_orderdate) AS month, median(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), p AS (SELECT zone, month, v, lag(v) OVER (PARTITION BY zone ORDER BY month) AS f FROM m) SELECT zone, round(avg(abs(v - f)), 2) AS mae, round(avg(abs(v - f) / v) * 100, 2) AS mape FROM p WHERE f IS NOT NULL GROUP BY zone")
def t13_backtest(spark: SparkSession, d: str) -> DataFrame:
    p = monthly(spark, d).withColumn("f", F.lag("med").over(Window.partitionBy("zone").orderBy("month"))).where("f is not null")
    gap = F.abs(F.col("med") - F.col("f"))
    return p.groupBy("zone").agg(r(F.avg(gap), 2).alias("mae"), r(F.avg(gap / F.col("med")) * 100, 2).alias("mape"))


# models ------------------------------------------------------------------------------------------------------


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """City-level features with whether the city's recent prices are above its own median."""
    c = monthly(spark, d).groupBy("zone").agg(F.avg("med").alias("mean"), F.stddev_samp("med").alias("sd"), F.sum("n").cast("double").alias("volume"), F.max_by("med", "month").alias("last"))
    return c.withColumn("label", (F.col("last") > F.col("mean")).cast("double"))


_FEATURES = ["price", "surface", "rooms_", "ppm2"]


def _listing_frame(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).withColumn("rooms_", F.col("rooms").cast("double")).withColumn("label", (F.col("source") == "N").cast("double"))
    return x.select("url", "city", "property_type", "label", *_FEATURES)


#: The nine features of the trust classifier.
TRUST_FEATURES = ["price", "surface", "ppm2", "bedrooms", "bathrooms", "source_code", "city_code", "text_length", "has_place"]


def trust_frame(x: DataFrame, top: int = 20) -> DataFrame:
    """Listings with the nine features: unknown counts of rooms are -1, sources and cities are numbered by how common they are, cities beyond the ``top`` are one."""
    common = x.groupBy("city").count().orderBy(F.desc("count"), "city").limit(top).select(F.col("city").alias("__city"), F.lit(True).alias("__common"))
    y = x.join(F.broadcast(common), F.col("city") == F.col("__city"), "left").withColumn("place", F.when(F.col("__common"), F.col("city")).otherwise("other"))
    for name, out in (("source", "source_code"), ("place", "city_code")):
        codes = y.groupBy(name).count().select(F.col(name).alias("__key"), (F.row_number().over(Window.orderBy(F.desc("count"), name)) - 1).cast("double").alias(out))  # a row a source, at most top + 1 places
        y = y.join(F.broadcast(codes), F.col(name).eqNullSafe(F.col("__key")), "left").drop("__key")
    return y.withColumns({
        "bedrooms": F.coalesce(F.col("rooms").cast("double"), F.lit(-1.0)), "bathrooms": F.lit(-1.0), "text_length": F.coalesce(F.length("title"), F.lit(0)).cast("double"), "has_place": F.col("city").isNotNull().cast("double"),
        "price": F.coalesce("price", F.lit(0.0)), "surface": F.coalesce(F.col("surface").cast("double"), F.lit(0.0)), "ppm2": F.coalesce("ppm2", F.lit(0.0)),
    }).drop("__city", "__common")


@query()
def m1_trust_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on nine features; the label is whether the source is the trusted one, as no trained weights are given."""
    x = trust_frame(listings(spark, d)).withColumn("label", (F.col("source") == "N").cast("double"))
    x = VectorAssembler(inputCols=TRUST_FEATURES, outputCol="features").transform(x)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1, subsamplingRate=0.5).fit(x)
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(x).select("url", r(p).alias("trust"), (p >= 0.6).alias("reliable"), r(F.greatest(p, 1 - p)).alias("confidence"))


@query()
def m8_emergence_classifier(spark: SparkSession, d: str) -> DataFrame:
    x = VectorAssembler(inputCols=["mean", "sd", "volume", "last"], outputCol="features").transform(_frame(spark, d))
    model = GBTClassifier(maxIter=5, maxDepth=2, seed=1).fit(x)
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(x).select("zone", r(p).alias("chance"), F.when(p > 0.7, "buy").otherwise("watch").alias("advice"))


def trust_net(spark: SparkSession, d: str) -> DataFrame:
    """Listings with the net's ``prediction`` and an array ``p`` of its three class probabilities."""
    raw = VectorAssembler(inputCols=_FEATURES, outputCol="raw").transform(_listing_frame(spark, d)).withColumn("label", F.when(F.col("ppm2") < 1200, 0.0).when(F.col("ppm2") < 1800, 1.0).otherwise(2.0))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    model = MultilayerPerceptronClassifier(layers=[4, 6, 3], maxIter=15, seed=1).fit(x)
    return model.transform(x).withColumn("p", vector_to_array(F.col("probability")))


@query()
def m9_trust_net(spark: SparkSession, d: str) -> DataFrame:
    return trust_net(spark, d).select("url", F.col("prediction").cast("long").alias("class"), *(r(F.col("p")[i]).alias(f"p{i}") for i in range(3)))


@query()
def m7_segments(spark: SparkSession, d: str) -> DataFrame:
    x = stored(listings(spark, d).select("city", "price", "ppm2"), "listings")
    c = stored(narrow_quantiles(x, ["city"], {"price": ("price", 0.5), "ppm2": ("ppm2", 0.5)}).coalesce(1).sortWithinPartitions("city"), "cities")  # a row a city, in one order, as seeds go by it
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v := VectorAssembler(inputCols=["price", "ppm2"], outputCol="raw").transform(c)).transform(v)
    return KMeans(k=4, seed=1).fit(x).transform(x).select("city", F.col("prediction").cast("long").alias("segment"), r("price", 2).alias("price"))


@query()
def m11_price_forest(spark: SparkSession, d: str) -> DataFrame:
    x = _listing_frame(spark, d).select("url", "city", "surface", "rooms_", F.col("price").alias("label"))
    steps = [Imputer(strategy="median", inputCols=["surface", "rooms_"], outputCols=["s", "k"]), StringIndexer(inputCol="city", outputCol="ci", handleInvalid="keep"), OneHotEncoder(inputCol="ci", outputCol="co"), VectorAssembler(inputCols=["s", "k", "co"], outputCol="features")]
    train, test = x.where(F.pmod(F.xxhash64("url"), F.lit(5)) != 0), x.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    said = Pipeline(stages=[*steps, RandomForestRegressor(numTrees=10, maxDepth=6, seed=1)]).fit(train).transform(test)
    scores = [(m, float(RegressionEvaluator(metricName=m).evaluate(said))) for m in ("rmse", "r2")]
    return spark.createDataFrame(scores, "metric string, value double").withColumn("value", r("value"))


ESTIMATE = "city string, surface double, predicted double, low double, high double, confidence long, price_m2 double, city_median double, city_ppm2 double, delta_pct double, budget_delta double, surface_possible double"


def estimates(asked: DataFrame, forest: trees.Trees, rmse: float, budget: float) -> DataFrame:
    """``asked`` rows (city, surface, rooms_, and the city's med, ppm2) with the forest's mean, a band of 1.28 deviations of its trees or half the error on held-out rows if that is wider, and what a budget buys."""

    def run(batches):
        for pdf in batches:
            each = forest.each(pdf[["surface", "rooms_"]].to_numpy(float))
            mean, sd = each.mean(0), each.std(0)
            half = np.maximum(1.28 * sd, 0.5 * rmse)
            surface, known = pdf["surface"].to_numpy(float), mean > 0
            yield pd.DataFrame({
                "city": pdf["city"], "surface": surface, "predicted": mean.round(2), "low": np.maximum(0, mean - half).round(2), "high": (mean + half).round(2),
                "confidence": np.where(known, np.clip(np.floor((1 - sd / np.where(known, mean, 1)) * 100), 0, 100), 0).astype(int), "price_m2": (mean / surface).round(2), "city_median": pdf["med"].round(2), "city_ppm2": pdf["ppm2"].round(2),
                "delta_pct": ((mean / pdf["med"] - 1) * 100).round(1), "budget_delta": (budget - mean).round(2), "surface_possible": np.round(budget / (mean / surface)),
            })

    return asked.select("city", "surface", "rooms_", "med", "ppm2").mapInPandas(run, ESTIMATE)


@query()
def r17_price_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A forest's estimate for each city's middle listing; a fifth of the rows is held out to measure the error."""
    x = VectorAssembler(inputCols=["surface", "rooms_"], outputCol="features").transform(_listing_frame(spark, d).withColumn("label", F.col("price")))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = RandomForestRegressor(numTrees=10, maxDepth=5, seed=1).fit(x.where(~held))
    rmse = float(RegressionEvaluator(metricName="rmse").evaluate(model.transform(x.where(held))))
    asked = grouped_quantiles(x, ["city"], {"surface": ("surface", 0.5), "rooms_": ("rooms_", 0.5), "med": ("price", 0.5), "ppm2": ("ppm2", 0.5)})
    return estimates(asked, trees.of_model(model), rmse, 50_000.0)


def isolation_forest(x: DataFrame, columns: list[str], n: int = 100, size: int = 256) -> tuple[trees.Trees, DataFrame, int]:
    """``(forest, rows, size)``: isolation trees on subsamples of the whole table, and ``x`` with ``filled``, its columns with nulls at their medians, as numbers of standard deviations from their means.

    One pass deals every row to one tree by a hash, and rows of low enough hashes reach it, so each row can be drawn, whatever the table's size; trees grow in tasks of their own, on at most ``size`` rows each.
    """
    middle = {c: exact_quantiles(x, c, 0.5)[0] for c in columns}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double"), F.lit(0.0)) for c in columns}
    stats = x.agg(F.count("*").alias("n"), *(F.avg(v).alias(f"m_{c}") for c, v in filled.items()), *(F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items())).first()
    scaled = F.array(*((v - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c, v in filled.items()))
    rows = x.withColumn("filled", scaled)
    draw = F.xxhash64(*x.columns)
    low = min(1 << 40, (1 << 40) * 2 * n * size // max(stats["n"], 1) + 1)  # twice as many as are wanted, so that every tree gets enough
    drawn = rows.select("filled", F.pmod(draw, F.lit(n)).cast("int").alias("tree"), F.pmod(F.xxhash64(draw, F.lit(1)), F.lit(1 << 40)).alias("u")).where(F.col("u") < low)
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("u", "filled"))).where(F.col("place") <= size)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        t = trees.isolation_tree(np.array(pdf.sort_values("place")["filled"].tolist()), np.random.default_rng(tree))
        return pd.DataFrame({"tree": [tree], "feature": [t.feature], "edge": [t.edge], "left": [t.left], "right": [t.right], "value": [t.value], "cover": [t.cover]})

    nodes = "tree int, feature array<long>, edge array<double>, left array<long>, right array<long>, value array<double>, cover array<double>"
    grown = drawn.groupBy("tree").applyInPandas(grow, nodes).orderBy("tree").collect()  # n trees of at most 2 size nodes
    made = [trees.Tree(*(np.array(g[c]) for c in ("feature", "edge", "left", "right", "value", "cover"))) for g in grown]
    return trees.Trees(made, [1 / max(len(made), 1)] * len(made)), rows, min(size, max(int(max((t.cover[0] for t in made), default=1)), 1))


def isolated(x: DataFrame, columns: list[str], contamination: float = 0.05, n: int = 100, size: int = 256) -> DataFrame:
    """``x`` with ``score`` (near 1 where few cuts set a row apart), ``severity`` by bands of it, and ``anomaly`` for the share ``contamination`` of the highest."""
    forest, rows, used = isolation_forest(x, columns, n, size)
    names = x.columns

    def score(batches):
        for pdf in batches:
            v = np.array(pdf["filled"].tolist()).reshape(len(pdf), -1)
            yield pdf[names].assign(score=np.round(trees.isolation_scores(forest, v, used), 4) if forest.trees else 0.0)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    scored = rows.mapInPandas(score, f"{schema}, score double")
    edge = exact_quantiles(scored, "score", 1 - contamination)[0]
    return scored.withColumns({"severity": F.when(F.col("score") > 0.6, "critical").when(F.col("score") > 0.4, "high").otherwise("low"), "anomaly": F.col("score") > F.lit(edge).cast("double")})


@query()
def m2_isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select("url", "part", "seller", "price", "surface", "ppm2", "rooms", F.length("title").alias("text_length"))
    return isolated(x, ["price", "surface", "ppm2", "rooms", "text_length"]).where("anomaly").select("url", "part", "seller", "score", "severity")


_PLACES = "SELECT s_suppkey AS id, 30 + (s_suppkey % 10) * 0.01 + (s_suppkey % 3) * 0.5 AS lat, 8 + (s_suppkey % 7) * 0.012 AS lon FROM supplier"


@query(f"WITH RECURSIVE pt AS ({_PLACES}), pr AS (SELECT a.id AS a, b.id AS b FROM pt a, pt b WHERE 2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 2.0), core AS (SELECT a FROM pr GROUP BY a HAVING count(*) >= 5), l AS (SELECT pr.a, pr.b FROM pr JOIN core x ON x.a = pr.a JOIN core y ON y.a = pr.b), reach(a, m) AS (SELECT a, a FROM core UNION SELECT l.a, reach.m FROM reach JOIN l ON l.b = reach.a), lab AS (SELECT a, min(m) AS m FROM reach GROUP BY a), near AS (SELECT pr.a, min(m) AS market FROM pr JOIN lab ON lab.a = pr.b GROUP BY pr.a) SELECT id, market FROM pt LEFT JOIN near ON near.a = id")
def m5_micro_markets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return micro_markets(table(spark, d, "supplier").select(k.alias("id"), (30 + (k % 10) * 0.01 + (k % 3) * 0.5).alias("lat"), (8 + (k % 7) * 0.012).alias("lon")))


def micro_markets(points: DataFrame, eps_km: float = 2.0, least: int = 5) -> DataFrame:
    """``(id, market)``: density clusters of points (id, lat, lon); market is the least core id in reach, null for noise.

    Points of one place are settled as one, with their number, so a crowded place makes no pairs of its own. Neighbours come from an equi-join on grid cells, each place also in the cells that its radius reaches (more of them in higher latitudes, and across the 180th meridian). Core points then take
    the least label near them, and that one's own label, until none changes; a checkpoint ends each round.
    """
    step = eps_km / 111.0
    across = int(360 / step)
    width = 360 / across
    reach = step / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + step)))
    column = lambda lon: F.floor((lon + 180) / width)
    shared_folder(points.sparkSession)
    places = points.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count("*").alias("n")).checkpoint()
    own = places.select("id", "lat", "lon", "n", F.floor(F.col("lat") / step).alias("y"))
    b = own.select(F.col("id").alias("b"), "lat", "lon", "n", "y", F.pmod(column(F.col("lon")), F.lit(across)).alias("x"))
    low = column(F.col("lon") - reach)
    a = own.withColumns({"x": F.explode(F.sequence(low, F.least(column(F.col("lon") + reach), low + across - 1)))}).withColumn("y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)))
    a = a.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), "y", F.pmod("x", F.lit(across)).alias("x"))
    km = 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), F.sin(F.radians(F.col("lat") - F.col("la")) / 2) ** 2 + F.cos(F.radians("la")) * F.cos(F.radians("lat")) * F.sin(F.radians(F.col("lon") - F.col("lo")) / 2) ** 2)))
    pairs = a.join(b, ["y", "x"]).where(km <= eps_km).select("a", "b", "n").checkpoint()
    core = pairs.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a")
    links = pairs.join(core, "a").join(core.select(F.col("a").alias("b")), "b").checkpoint()
    label = core.select("a", F.col("a").alias("m"))
    while True:
        near = links.join(label.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m")).checkpoint()
        new = near.join(label.select(F.col("a").alias("m"), F.col("m").alias("further")), "m").select("a", F.least("m", "further").alias("m")).checkpoint()
        moved = new.join(label.withColumnRenamed("m", "old"), "a").where("m < old").limit(1).count()
        label = new
        if not moved:
            break
    reached = pairs.join(label.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("market"))
    found = places.join(reached, F.col("id") == F.col("a")).select(F.col("lat").alias("la"), F.col("lon").alias("lo"), "market")
    return points.join(found, (F.col("lat") == F.col("la")) & (F.col("lon") == F.col("lo")), "left").select("id", "market")


@query(_INVEST + "SELECT decision, round(avg(0.40 * norm), 4) AS roi_part, round(avg(0.05 / (1 + ppm2)), 6) AS competition_part, round(avg(score), 4) AS score FROM v GROUP BY decision", True)
def m10_occlusion(spark: SparkSession, d: str) -> DataFrame:
    s = invest(listings(spark, d))
    return s.groupBy("decision").agg(r(F.avg(0.40 * F.col("norm"))).alias("roi_part"), r(F.avg(0.05 / (1 + F.col("ppm2"))), 6).alias("competition_part"), r(F.avg("score")).alias("score"))


#: What the trust score's explanation is told in.
EXPLAINED = ["price_to_city", "surface_share", "twins", "text_length", "source_trust", "rooms"]
EXPLANATION = "url long, part long, seller long, trust double, base double, verdict string, raised array<struct<feature:string,value:double>>, lowered array<struct<feature:string,value:double>>, total double"


def explained(x: DataFrame, forest: trees.Trees, features: list[str], keys: list[str], schema: str, top: int = 3, least: float = 0.005) -> DataFrame:
    """``x``'s predictions with each row's largest contributions either way (those of at least ``least``), by exact tree Shapley values; ``total`` is the sum of all, prediction less base."""
    base = forest.mean

    def run(batches):
        for pdf in batches:
            v = pdf[features].to_numpy(float)
            said, parts = forest.predict(v), forest.shapley(v)
            pick = lambda row, sign: [{"feature": features[i], "value": round(float(row[i]), 4)} for i in np.argsort(-sign * row, kind="stable")[:top] if sign * row[i] > least]
            yield pdf[keys].assign(
                trust=said.round(6), base=round(base, 6), verdict=np.select([said >= 0.75, said >= 0.5], ["reliable", "fair"], "suspect"),
                raised=[pick(p, 1) for p in parts], lowered=[pick(p, -1) for p in parts], total=parts.sum(1).round(6),
            )

    return x.select(*keys, *features).mapInPandas(run, schema)


@query()
def m10_tree_shap(spark: SparkSession, d: str) -> DataFrame:
    """A forest fitted to the rule-based trust score, and what moves each listing's prediction off the mean."""
    x = _trust(spark, d, kept=True).select(
        "url", "part", "seller", "trust", F.coalesce(F.try_divide("ppm2", "med"), F.lit(1.0)).alias("price_to_city"), F.coalesce(F.col("surface") / 500, F.lit(0.3)).cast("double").alias("surface_share"), F.col("twins").cast("double").alias("twins"),
        F.least(F.coalesce("title", F.lit(0)) / 500, F.lit(1.0)).alias("text_length"), F.when(F.col("source") == "A", 0.92).when(F.col("source") == "N", 0.78).otherwise(0.65).alias("source_trust"), F.coalesce("rooms", F.lit(-1)).cast("double").alias("rooms"),
    )
    x = stored(x, "features")  # passed over several times while the forest grows
    model = RandomForestRegressor(numTrees=10, maxDepth=4, seed=42, labelCol="trust").fit(VectorAssembler(inputCols=EXPLAINED, outputCol="features").transform(x.where("trust IS NOT NULL")))
    return explained(x, trees.of_model(model), EXPLAINED, ["url", "part", "seller"], EXPLANATION)


_BEST = "round(score, 9) DESC, url, part, seller"


@query(_INVEST + f", b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY city ORDER BY {_BEST}) <= 3), t AS (SELECT * FROM b ORDER BY {_BEST} LIMIT 60), c AS (SELECT *, sum(price) OVER (ORDER BY {_BEST} ROWS UNBOUNDED PRECEDING) AS spent FROM t) SELECT count(*) AS chosen, count(DISTINCT city) AS cities, round(0.55 * avg(roi) + 0.10 * 0.05 * count(DISTINCT city), 4) AS reward FROM c WHERE spent <= 1000000", True)
def r16_greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    """Assets taken in the order of score while the budget lasts, best of each city first; the reward is that of the chosen set."""
    order = [F.desc(r("score", 9)), "url", "part", "seller"]
    best = Window.partitionBy("city").orderBy(*order)
    top = invest(listings(spark, d)).withColumn("k", F.row_number().over(best)).where("k <= 3").orderBy(*order).limit(60)  # at most 60 rows from here
    spent = F.sum("price").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("spent", spent).where("spent <= 1000000").agg(F.count("*").alias("chosen"), F.count_distinct("city").alias("cities"), r(0.55 * F.avg("roi") + 0.10 * 0.05 * F.count_distinct("city")).alias("reward"))


# similarity with order ---------------------------------------------------------------------------------------


@query(f"WITH x AS (SELECT (label % 5) * 1000000000000 + vec_id AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35), {dedup.GREEDY_SQL} SELECT vec_id AS id FROM x, gone WHERE NOT list_contains(ids, id)")
def d12_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors alike over the whole table, across labels; the one of the more trusted source (here: the label) stays, then the smaller id. The threshold is lower than in use, so that these tables have such pairs."""
    return alike_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") % 5).alias("priority")), 0.35)


def alike_vectors(e: DataFrame, threshold: float = 0.88, **options: int) -> DataFrame:
    """``(id,)``: of ``e(id, embedding, priority)``, the rows that stay when, in the order of priority and id, each leaves that has a cosine of at least ``threshold`` with one that stays. No blocks are given and no pair is left out."""
    usable = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    # of equal vectors only the first can stay: what it leaves for, they leave for too
    first = e.where(usable).groupBy("embedding").agg(F.min(F.struct("priority", "id")).alias("k")).select("k.id", "k.priority", "embedding")
    return unlike_vectors(first, threshold, **options).union(e.where(~F.coalesce(usable, F.lit(False))).select("id"))


@query()
def d17_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp likeness of distinct part names that share their first word; containment counts 0.87."""
    x = table(spark, d, "part").select("p_name").distinct().withColumn("first", F.substring_index("p_name", " ", 1))
    pairs = dedup.met_in_blocks(x, ["first"], "p_name").select(F.col("one.p_name").alias("a"), F.col("two.p_name").alias("b"))

    def score(batches):
        for pdf in batches:
            yield pdf.assign(score=[1.0 if a == b else 0.87 if a in b or b in a else round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for a, b in zip(pdf["a"], pdf["b"])])

    return pairs.mapInPandas(score, "a string, b string, score double")


def sequence_likeness(a: str, b: str) -> float:
    """1 for equal texts, 0.87 where one holds the other; else the Ratcliff-Obershelp ratio and 0.3 times the share of common words, at most 1."""
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.87
    one, two = set(a.split()), set(b.split())
    shared = len(one & two) / max(len(one), len(two)) if one and two else 0.0
    return round(min(1.0, difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * shared), 3)


def like_texts(texts: DataFrame, threshold: float = 0.9, most: int = dedup.BLOCK_ROWS) -> DataFrame:
    """``(a, b, score)`` with a < b for all pairs of the distinct ``texts(t)`` whose ``sequence_likeness`` is at least ``threshold`` (more than 0.87), over all texts, in lower case and trimmed.

    Exact, without scoring all pairs. A ratio is at most twice the number of common letters (with repeats) over both lengths. Texts without a common word need a ratio of ``threshold``: short ones then have equal letters but for one at most on either side, and
    meet at these; of a long one's letters, the rarest first, two such texts share one of the first few. Texts with a common word meet at a word. What meets is tested by its edits (a ratio is at most 1 less their share of both lengths) where it
    meets, then by the bound on letters, before it is scored; a frequent word or letter is dealt into parts.
    """
    known = texts.select(F.lower(F.trim("t")).alias("t")).where(F.col("t") != "").distinct()
    at_word = known.select("t", F.explode(F.array_distinct(F.split("t", r"\s+"))).alias("x"))
    # each letter with the number of its repeat, so that common members are common letters with repeats
    letter = known.select("t", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("i", "c")).withColumn("k", F.row_number().over(Window.partitionBy("t", "c").orderBy("i"))).select("t", F.concat_ws("#", "c", "k").alias("x"))
    rare = letter.join(letter.groupBy("x").agg(F.count("*").alias("n")), "x").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))  # a text's own letters
    size = F.size("o")
    # of a pair's letters at least threshold / (2 - threshold) times the longer one's are common
    need = F.ceil(size * F.lit(threshold / (2 - threshold)) - 1e-9).cast("int")
    spare = lambda n: n - math.ceil(n * threshold / (2 - threshold) - 1e-9)  # noqa: E731  # letters that a text of n letters may have beyond the common ones
    long = next(n for n in itertools.count(1) if spare(n) > 1)
    # a long text's partner may be a little shorter
    head = rare.where(size >= math.ceil(long * threshold / (2 - threshold) - 1e-9)).select("t", F.explode(F.slice("o", F.lit(1), F.greatest(size - need + 1, F.lit(1)))).alias("m")).select("t", F.col("m.x").alias("x"))

    def close(a: Column, b: Column) -> Column:
        one, two = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
        words, both = F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two)), F.length(a) + F.length(b)
        near = lambda edits: 1 - edits / both + 0.3 * words >= threshold - 1e-3
        return near(F.abs(F.length(a) - F.length(b))) & near(F.levenshtein(a, b))

    def sides(x: DataFrame, other: Column | None = None) -> DataFrame:
        met = dedup.met_in_blocks(x, ["x"], "t", most)
        return (met if other is None else met.where(other)).where(close(F.col("one.t"), F.col("two.t"))).select(F.col("one.t").alias("a"), F.col("two.t").alias("b"))

    short = known.where(F.length("t") < long).select("t", F.array_join(F.array_sort(F.split("t", "")), "").alias("x"))
    less = F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.concat(F.substring("x", F.lit(1), i - 1), F.substring("x", i + 1, F.length("x"))))
    less = short.withColumnRenamed("x", "bag").withColumn("x", F.col("bag")).select("t", "bag", F.explode(F.array_distinct(less)).alias("x"))
    enough = lambda more: 2 * F.length("x") >= (threshold - 1e-3) * (2 * F.length("x") + more)
    whole = less.where(enough(1)).select(F.col("t").alias("u"), "x").join(short, "x").where(close(F.col("t"), F.col("u"))).select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"))
    swapped = sides(less.where(enough(2)), F.col("one.bag") != F.col("two.bag"))
    met = sides(at_word).union(sides(head)).union(sides(short)).union(whole).union(swapped).distinct()
    bags = rare.select("t", F.transform("o", lambda m: m["x"]).alias("w"))
    both = met.join(bags.select(F.col("t").alias("a"), F.col("w").alias("wa")), "a").join(bags.select(F.col("t").alias("b"), F.col("w").alias("wb")), "b")
    one, two = F.array_distinct(F.split("a", r"\s+")), F.array_distinct(F.split("b", r"\s+"))
    words = F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two))
    bound = 2 * F.size(F.array_intersect("wa", "wb")) / (F.size("wa") + F.size("wb")) + 0.3 * words
    worth = both.where(bound >= threshold - 1e-3).select("a", "b")

    def score(batches):
        for pdf in batches:
            yield pdf.assign(score=[sequence_likeness(a, b) for a, b in zip(pdf["a"], pdf["b"])])

    return worth.mapInPandas(score, "a string, b string, score double").where(F.col("score") >= threshold)


@query()
def d17_like_names(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and customer names that resemble each other, over all of them."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("t")).union(table(spark, d, "supplier").select("s_name"))
    return like_texts(names, 0.97)


#: Groups of actors that may stand for each other; a pair from different groups is only weakly alike (fixed values).
ACTORS = {"buyer": "client", "client": "client", "tenant": "tenant", "lodger": "tenant", "owner": "owner", "landlord": "owner", "seller": "owner"}


def actor_likeness(a: str, b: str, groups: dict[str, str] = ACTORS, cap: float = 0.20) -> float:
    """``sequence_likeness`` of two actors, at most ``cap`` where both belong to groups and those differ."""
    a, b = a.lower().strip(), b.lower().strip()
    known = sequence_likeness(a, b)
    return min(known, cap) if groups.get(a, groups.get(b)) != groups.get(b, groups.get(a)) else known


@query("WITH q(asked) AS (VALUES ('red wigdet'), ('smal ring'), ('blue bolt'), ('zzz')), h AS (SELECT asked, min({'edits': levenshtein(asked, p_name), 't': p_name}) AS m FROM q, (SELECT DISTINCT p_name FROM part) WHERE levenshtein(asked, p_name) <= 3 GROUP BY asked) SELECT asked, coalesce(m.t, 'unknown') AS name, m.edits::BIGINT AS edits FROM q LEFT JOIN h USING (asked)")
def d18_resolve_name(spark: SparkSession, d: str) -> DataFrame:
    """The nearest known name by edit distance, at most 3 edits; else the default. The questions are a fixed list."""
    q = spark.createDataFrame([("red wigdet",), ("smal ring",), ("blue bolt",), ("zzz",)], "asked string")
    n = table(spark, d, "part").select(F.col("p_name").alias("t")).distinct()
    hit = n.crossJoin(F.broadcast(q)).withColumn("edits", F.levenshtein("asked", "t")).where("edits <= 3").groupBy("asked").agg(F.min(F.struct("edits", "t")).alias("m"))
    return q.join(hit, "asked", "left").select("asked", F.coalesce("m.t", F.lit("unknown")).alias("name"), F.col("m.edits").cast("long").alias("edits"))


@query("WITH x AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 4)) AS w FROM documents), s AS (SELECT id, len(w) AS n FROM x), c AS (SELECT id, unnest(w) AS t FROM x), i AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM c a JOIN c b ON a.t = b.t AND a.id < b.id GROUP BY ALL), p AS (SELECT a, b FROM i JOIN s u ON u.id = a JOIN s v ON v.id = b WHERE 100 * k >= 88 * (u.n + v.n - k)), " + dedup.GREEDY_SQL + " SELECT id FROM x, gone WHERE NOT list_contains(ids, id)")
def d14_dedup_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stay when, in the order of ids, each leaves whose set of words of 4 letters or more is nearly that of one that stays. Over all texts, without blocks."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) >= 4))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    return dedup.unlike_sets(x)


def hybrid_chunks(docs: DataFrame, cells: int = 6, top: int = 6, topics: int = 16, dims: int = 4096, seed: int = 1) -> DataFrame:
    """``(doc_id, cell, place, lexical, semantic, score, text)``: texts in k-means cells of their TF-IDF vectors, and of each cell the ``top`` by 0.4 lexical and 0.6 semantic likeness to its centroid.

    Lexical likeness is the cosine of term vectors, semantic that of their coordinates in a truncated singular value decomposition of all texts. Centroids are ``cells`` vectors of ``dims`` and of ``topics`` numbers.
    """
    _, rows = semantic.weighted_terms(docs, dims=dims)
    rows = stored(rows.where("text IS NOT NULL"), "terms")  # the decomposition and the centroids pass over them many times
    found = semantic.truncated_svd(rows, "terms", topics, dims)
    model = KMeans(k=cells, seed=seed, featuresCol="terms", predictionCol="cell").fit(rows)
    centres = [np.asarray(c, float) for c in model.clusterCenters()]
    split = docs.sparkSession.createDataFrame([(i, [float(x) for x in c / (np.linalg.norm(c) or 1.0)]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    placed = model.transform(rows).select("doc_id", "text", "cell", "terms")
    wide = semantic.dense(placed.join(F.broadcast(split), "cell").withColumn("lexical", _along("terms", "centre")).select("doc_id", "text", "cell", "lexical", "terms"), found)
    middle = wide.groupBy("cell").agg(F.array(*(F.avg(F.col("dense")[i]) for i in range(found.vectors.shape[1]))).alias("middle"))  # a row a cell
    both = wide.join(F.broadcast(middle), "cell").withColumn("semantic", F.coalesce(cosine("dense", "middle"), F.lit(0.0)))
    score = both.withColumn("score", r(0.4 * F.col("lexical") + 0.6 * F.col("semantic"), 6))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "doc_id"))
    return score.withColumn("place", place).where(F.col("place") <= top).select("doc_id", F.col("cell").cast("long").alias("cell"), F.col("place").cast("long").alias("place"), r("lexical", 6).alias("lexical"), r("semantic", 6).alias("semantic"), "score", "text")


def _along(terms: str, centre: str) -> Column:
    """The inner product of a vector and an array, where the vector has a number."""
    return F.aggregate(F.zip_with(vector_to_array(F.col(terms)), F.col(centre), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


@query()
def m16_hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_chunks(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query()
def m16_merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's best texts as one, in their order."""
    chunks = hybrid_chunks(table(spark, d, "documents").select("doc_id", "text"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")  # at most six texts
    return chunks.groupBy("cell").agg(F.count("*").alias("n"), merged.alias("text"), r(F.avg("score"), 6).alias("mean_score"))
