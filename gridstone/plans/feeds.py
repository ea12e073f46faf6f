"""Source feeds mapped to listings, column harmonisation, sinks, and the smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import median
from ..sources.delimited import Registry, read_robust, union_files
from ..session import shared_folder
from .aggregates import monthly, zoned_orders
from .base import listings, query, r, table
from .scoring import _INVEST, invest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# sources and sinks -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def s1_robust_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s1")
    table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).option("sep", ";").csv(path)
    return read_robust(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("SELECT r_regionkey::VARCHAR AS k, r_name AS name, NULL AS nationkey FROM region UNION ALL SELECT n_regionkey::VARCHAR, n_name, n_nationkey::VARCHAR FROM nation")
def s2_union_of_files(spark: SparkSession, d: str) -> DataFrame:
    a, b = _folder(spark, "s2a"), _folder(spark, "s2b")
    table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).write.option("header", True).csv(a)
    table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nationkey")).write.option("header", True).option("sep", ";").csv(b)
    return union_files(spark, [a, b]).drop("_source_file")


@query("SELECT o_orderstatus AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total, 0 AS unknown_surface FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT 'parts', count(*), round(sum(p_retailprice), 2), 0 FROM part")
def s7_connector_contract(spark: SparkSession, d: str) -> DataFrame:
    reg = Registry({"price": "double", "surface": "double", "title": "string"})
    reg.register("O", 1, lambda s: table(s, d, "orders").where("o_orderstatus = 'O'").withColumn("surface", F.lit(1)), {"o_totalprice": "price", "o_orderpriority": "title"})
    reg.register("parts", 2, lambda s: table(s, d, "part"), {"p_retailprice": "price", "p_size": "surface", "p_name": "title"})
    return reg.ingest(spark).groupBy("source").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"), F.count_if(F.col("surface").isNull()).cast("int").alias("unknown_surface"))


@query("SELECT p_partkey, coalesce(nullif(p_size, 1), try_cast(regexp_extract(p_brand, '[0-9]+', 0) AS INT))::BIGINT AS surface, CASE WHEN p_type LIKE '%SMALL%' THEN 'studio' WHEN p_type LIKE '%LARGE%' THEN 'villa' ELSE 'autre' END AS kind FROM part")
def s8_normalise_portal(spark: SparkSession, d: str) -> DataFrame:
    surface = F.coalesce(F.nullif(F.col("p_size"), F.lit(1)), F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("int"))
    return table(spark, d, "part").select("p_partkey", surface.cast("long").alias("surface"), F.when(F.col("p_type").contains("SMALL"), "studio").when(F.col("p_type").contains("LARGE"), "villa").otherwise("autre").alias("kind"))


@query("SELECT page_id, CASE WHEN starts_with(p, '/') THEN 'https://www.example.com' || p ELSE p END AS link FROM (SELECT page_id, regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS p FROM pages)")
def s10_absolute_links(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract("html", 'href="([^"]*)"', 1)
    return table(spark, d, "pages").select("page_id", F.when(p.startswith("/"), F.concat(F.lit("https://www.example.com"), p)).otherwise(p).alias("link"))


@query("SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'villa' WHEN 1 THEN 'maison' WHEN 2 THEN 'terrain' ELSE 'autre' END AS kind, 'https://agency.example/' || s_suppkey AS url, nullif(s_acctbal, 0) AS price FROM supplier")
def s11_type_codes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in {0: "villa", 1: "maison", 2: "terrain"}.items() for x in kv))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.try_element_at(kinds, F.col("s_nationkey") % 4), F.lit("autre")).alias("kind"), F.concat(F.lit("https://agency.example/"), F.col("s_suppkey").cast("string")).alias("url"), F.nullif(F.col("s_acctbal"), F.lit(0.0)).alias("price"))


@query("SELECT event_id, k FROM (SELECT event_id, unnest([json_extract_string(props, '$.k')::BIGINT, event_id % 7]) AS k FROM events) WHERE k > 95")
def s20_explode_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long").getField("k")
    return table(spark, d, "events").select("event_id", F.explode(F.array(k, F.col("event_id") % 7)).alias("k")).where("k > 95")


@query("WITH a AS (SELECT event_id, [{'lang': 'fr', 'text': event_type}, {'lang': 'en', 'text': upper(event_type)}] AS ds FROM events) SELECT event_id, list_filter(ds, lambda x: x.lang = 'en')[1].text AS description FROM a")
def s19_pick_by_language(spark: SparkSession, d: str) -> DataFrame:
    ds = F.array(F.struct(F.lit("fr").alias("lang"), F.col("event_type").alias("text")), F.struct(F.lit("en").alias("lang"), F.upper("event_type").alias("text")))
    return table(spark, d, "events").select("event_id", F.filter(ds, lambda x: x["lang"] == "en")[0]["text"].alias("description"))


@query("SELECT zone, quarter, round(median(price), 2) AS value FROM (SELECT n_name AS zone, date_trunc('quarter', o_orderdate)::DATE AS quarter, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) GROUP BY ALL")
def s23_quarterly_panel(spark: SparkSession, d: str) -> DataFrame:
    return zoned_orders(spark, d).groupBy("zone", F.date_trunc("quarter", "at").cast("date").alias("quarter")).agg(r(median("price"), 2).alias("value"))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def k9_json_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "k9")
    table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("event_type string, day date, n long").json(path)


@query("SELECT * FROM (SELECT DISTINCT source AS name, 'actor' AS kind FROM documents UNION ALL SELECT DISTINCT lang, 'target' FROM documents WHERE lang IS NOT NULL)")
def k12_graph_export(spark: SparkSession, d: str) -> DataFrame:
    path, x = _folder(spark, "k12"), table(spark, d, "documents")
    nodes = x.select(F.col("source").alias("name"), F.lit("actor").alias("kind")).distinct().union(x.where("lang is not null").select("lang", F.lit("target")).distinct())
    nodes.write.option("header", True).csv(path)
    return spark.read.schema("name string, kind string").option("header", True).csv(path)


@query("SELECT run, max(rows_out) AS rows_out, max(status) AS status FROM (SELECT event_id % 50 AS run, arg_max(value, event_id) AS rows_out, arg_max(event_type, event_id) AS status FROM events GROUP BY run) GROUP BY run")
def k5_run_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("event_id") % 50).alias("run")).agg(F.max_by("value", "event_id").alias("rows_out"), F.max_by("event_type", "event_id").alias("status"))


@query("SELECT user_id, min(event_id) AS since, count(*) AS n FROM events e WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 250) GROUP BY user_id")
def k7_active_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("event_type = 'signup'").join(e.where("event_type = 'error' and value > 250").select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("since"), F.count("*").alias("n"))


# harmonisation -----------------------------------------------------------------------------------------------


def harmonise(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Each wanted column from its aliases: an alias that is absent or all null is skipped, the rest fill each other row by row. The null rates take one aggregation."""
    held = sorted({a for names in wanted.values() for a in names if a in df.columns})
    rate = df.agg(*(F.count(F.col(c)).alias(c) for c in held)).first() if held else {}
    pick = lambda names: [F.col(a) for a in names if a in df.columns and rate[a]]
    return df.select(*((F.coalesce(*cs) if (cs := pick(names)) else F.lit(None)).alias(c) for c, names in wanted.items()))


@query("SELECT p_partkey AS id, coalesce(nullif(p_name, 'red widget'), p_brand) AS title, p_retailprice AS price, NULL AS city FROM part")
def p1_normalise_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").withColumns({"titre": F.nullif(F.col("p_name"), F.lit("red widget")), "prix": F.lit(None).cast("double")})
    return harmonise(raw, {"id": ["p_partkey"], "title": ["titre", "p_brand"], "price": ["prix", "p_retailprice"], "city": ["ville", "commune"]})


@query("SELECT p_partkey, 'https://' || lower(split(p_type, ' ')[1]) || '.example/' || p_partkey AS url, CASE WHEN p_brand LIKE '%1%' THEN 'first' WHEN p_brand LIKE '%2%' THEN 'second' ELSE 'csv' END AS source, round(p_retailprice / nullif(p_size, 0), 6) AS ppm2 FROM part")
def p2_harmonise_file(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://"), F.lower(F.split("p_type", " ")[0]), F.lit(".example/"), F.col("p_partkey").cast("string")).alias("url"), F.when(b.contains("1"), "first").when(b.contains("2"), "second").otherwise("csv").alias("source"), r(F.try_divide("p_retailprice", "p_size"), 6).alias("ppm2"))


@query("SELECT count(*) AS n, round(sum(ppm2), 1) AS total, count(*) FILTER (ppm2 IS NULL) AS missing FROM (SELECT CASE WHEN surface > 2 THEN round(price / surface, 2) END AS ppm2 FROM listing)", True)
def p5_price_per_m2(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d).select(F.when(F.col("surface") > 2, r(F.col("price") / F.col("surface"), 2)).alias("ppm2"))
    return x.agg(F.count("*").alias("n"), r(F.sum("ppm2"), 1).alias("total"), F.count_if(F.col("ppm2").isNull()).alias("missing"))


@query("SELECT 'order' AS source, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders UNION ALL SELECT 'part', count(*), round(avg(p_retailprice), 2) FROM part UNION ALL SELECT 'supplier', count(*), round(avg(s_acctbal), 2) FROM supplier")
def p6_union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(n).alias("source"), F.col(c).alias("price")) for t, n, c in (("orders", "order", "o_totalprice"), ("part", "part", "p_retailprice"), ("supplier", "supplier", "s_acctbal"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"), r(F.avg("price"), 2).alias("mean"))


_INDEXED = "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src19')) "


@query(_INDEXED + "SELECT doc_id, coalesce(i, -1) AS source_index, length(text) AS length, (lang = 'en')::BIGINT AS english FROM documents LEFT JOIN s USING (source)")
def p7_feature_frame(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    s = x.where("source <> 'src19'").select("source").distinct().withColumn("i", F.row_number().over(Window.orderBy("source")) - 1)
    return x.join(s, "source", "left").select("doc_id", F.coalesce("i", F.lit(-1)).cast("long").alias("source_index"), F.length("text").cast("long").alias("length"), (F.col("lang") == "en").cast("long").alias("english"))


@query("SELECT doc_id, CASE WHEN n_chars < 800 THEN 'low' WHEN n_chars < 2000 THEN 'medium' ELSE 'high' END AS budget, list_slice(split(text, ' '), 1, 3) AS top FROM documents")
def p10_response_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n < 800, "low").when(n < 2000, "medium").otherwise("high").alias("budget"), F.slice(F.split("text", " "), 1, 3).alias("top"))


# smaller operators -------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), b AS (SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean FROM documents WHERE doc_id % 2 = 1 GROUP BY lang) SELECT lang, b.n - a.n AS n_delta, round(b.mean - a.mean, 2) AS mean_delta FROM a JOIN b USING (lang)")
def a26_compare_versions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("lang is not null")
    v = lambda k: x.where(f"doc_id % 2 = {k}").groupBy("lang").agg(F.count("*").alias(f"n{k}"), r(F.avg("n_chars"), 2).alias(f"m{k}"))
    return v(0).join(v(1), "lang").select("lang", (F.col("n1") - F.col("n0")).alias("n_delta"), r(F.col("m1") - F.col("m0"), 2).alias("mean_delta"))


@query("WITH c AS (SELECT event_type AS field, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT field, sum(n)::BIGINT AS total, round(avg(n), 4) AS mean_uses, arg_max(user_id, n * 1000 - user_id) AS mode_user FROM c GROUP BY field")
def a28_correction_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("field"), "user_id").agg(F.count("*").alias("n"))
    return c.groupBy("field").agg(F.sum("n").alias("total"), r(F.avg("n")).alias("mean_uses"), F.max_by("user_id", F.col("n") * 1000 - F.col("user_id")).alias("mode_user"))


@query("WITH x AS (SELECT p_partkey, p_size::DOUBLE AS truth, p_size * (1 + (p_partkey % 9 - 4) / 50.0) AS said FROM part) SELECT field, count(*) AS n, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 4) AS rate FROM (SELECT 'within 5' AS field, abs(said - truth) <= 0.05 * truth AS ok FROM x UNION ALL SELECT 'within 10', abs(said - truth) <= 0.10 * truth FROM x) GROUP BY field")
def a29_extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    truth = F.col("p_size").cast("double")
    said = F.col("p_size") * (1 + (F.col("p_partkey") % 9 - 4) / 50.0)
    gap = F.abs(said - truth)
    x = table(spark, d, "part").select((gap <= 0.05 * truth).alias("within 5"), (gap <= 0.10 * truth).alias("within 10"))
    return x.unpivot([], x.columns, "field", "ok").groupBy("field").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), r(F.avg(F.col("ok").cast("int"))).alias("rate"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round((max(o_totalprice) - min(o_totalprice)) / min(o_totalprice) * 100, 2) AS spread, count(*) FILTER (o_totalprice < 100000) AS drops FROM orders GROUP BY o_custkey")
def a33_portfolio_totals(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(r(F.sum(p), 2).alias("total"), r((F.max(p) - F.min(p)) / F.min(p) * 100, 2).alias("spread"), F.count_if(p < 100000).alias("drops"))


@query("SELECT s_suppkey, round((s_suppkey % 10 + s_nationkey % 10 + length(s_name) % 10 + floor(s_acctbal / 1000) + s_suppkey % 7) / 5, 2) AS score FROM supplier")
def a34_attractiveness(spark: SparkSession, d: str) -> DataFrame:
    axes = [F.col("s_suppkey") % 10, F.col("s_nationkey") % 10, F.length("s_name") % 10, F.floor(F.col("s_acctbal") / 1000), F.col("s_suppkey") % 7]
    return table(spark, d, "supplier").select("s_suppkey", r(sum(axes, F.lit(0)) / 5, 2).alias("score"))


@query(", n AS (SELECT url, price, part, row_number() OVER (ORDER BY url, price, part, seller) AS k FROM listing WHERE city = 'NATION_4') SELECT CASE WHEN k <= 50 THEN 'scored' ELSE 'rest' END AS rows, count(*) AS n, round(avg(CASE WHEN k <= 50 THEN price / 200000 ELSE 0.1 END), 4) AS mean_risk FROM n GROUP BY 1", True)
def b4_scored_head(spark: SparkSession, d: str) -> DataFrame:
    head = listings(spark, d).where("city = 'NATION_4'").select("url", "price", "part", "seller")
    first = head.orderBy("url", "price", "part", "seller").limit(50).agg(F.count("*").alias("n"), F.avg(F.col("price") / 200000).alias("m"))
    total = head.agg(F.count("*").alias("all"))
    x = first.crossJoin(F.broadcast(total))
    return x.where("n > 0").select(F.lit("scored").alias("rows"), "n", r("m").alias("mean_risk")).union(x.select(F.lit("rest"), F.col("all") - F.col("n"), F.lit(0.1)).where("all > n"))


@query("SELECT m AS month, i AS index, CASE WHEN i < 98 THEN 'favourable' WHEN i > 103 THEN 'unfavourable' ELSE 'neutral' END AS verdict FROM (VALUES (1, 96.5), (2, 97.0), (3, 99.5), (4, 101.0), (5, 102.5), (6, 104.0), (7, 105.5), (8, 105.0), (9, 102.0), (10, 100.0), (11, 98.5), (12, 96.0)) t(m, i)")
def b7_reference_window(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1, 96.5), (2, 97.0), (3, 99.5), (4, 101.0), (5, 102.5), (6, 104.0), (7, 105.5), (8, 105.0), (9, 102.0), (10, 100.0), (11, 98.5), (12, 96.0)], "month int, index double")
    return t.withColumn("verdict", F.when(F.col("index") < 98, "favourable").when(F.col("index") > 103, "unfavourable").otherwise("neutral"))


@query("WITH c AS (SELECT arg_max(v, month) AS last_v, zone FROM (SELECT n_name AS zone, date_trunc('month', o_orderdate) AS month, round(median(o_totalprice), 2) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY zone) SELECT zone, last_v AS projected FROM c")
def b19_last_point(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).groupBy("zone").agg(r(F.max_by("med", "month"), 2).alias("projected"))


@query("WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS mu, list_stddev_pop(v) AS sd FROM a) SELECT vec_id, round(mu, 6) AS mu, round(sd, 5) AS sd, round((v[1] - mu) / sd, 4) AS first_value FROM m")
def b20_row_standardise(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    a = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumn("mu", total(F.col("v")) / F.size("v"))
    b = a.withColumn("sd", F.sqrt(total(F.transform("v", lambda y: (y - F.col("mu")) * (y - F.col("mu")))) / F.size("v")))
    return b.select("vec_id", r("mu", 6).alias("mu"), r("sd", 5).alias("sd"), r((F.col("v")[0] - F.col("mu")) / F.col("sd")).alias("first_value"))


@query("WITH e AS (SELECT avg((toxic = 1)::INT) AS t, avg((quality = 0)::INT) AS q FROM labels) SELECT array_to_string(list_filter([CASE WHEN t > 0.05 THEN 'review toxic texts' END, CASE WHEN q > 0.05 THEN 'filter low quality' END, CASE WHEN q > 0.9 THEN 'rebuild' END], lambda x: x IS NOT NULL), '; ') AS advice FROM e")
def b32_recommendations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labels").agg(F.avg((F.col("toxic") == 1).cast("int")).alias("t"), F.avg((F.col("quality") == 0).cast("int")).alias("q"))
    advice = F.array(F.when(F.col("t") > 0.05, "review toxic texts"), F.when(F.col("q") > 0.05, "filter low quality"), F.when(F.col("q") > 0.9, "rebuild"))
    return e.select(F.array_join(F.filter(advice, lambda x: x.isNotNull()), "; ").alias("advice"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50) WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 10")
def b34_alert_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(50).where("event_type = 'error'").orderBy(F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(round(total, 2), 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def b35_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce(r("t", 2), F.lit(0.0)).alias("total"))


@query("WITH s AS (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, c_nationkey, c_acctbal FROM customer) SELECT c_nationkey, c_custkey, c_acctbal, round(c_acctbal * 0.9, 2) AS reduced FROM s WHERE k <= 3")
def w5_top_negotiable(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").withColumn("k", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("k <= 3")
    return s.select("c_nationkey", "c_custkey", "c_acctbal", r(F.col("c_acctbal") * 0.9, 2).alias("reduced"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10")
def w6_top_suspects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").orderBy("s_acctbal", "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def w13_paged_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(25).limit(25).select("o_orderkey", "o_orderdate")


@query(", r AS (SELECT city, property_type, median(price) / 150 AS rent, count(*) AS n FROM listing WHERE status = 'O' GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT city, property_type, median(price) AS sale, count(*) AS n FROM listing WHERE status = 'F' GROUP BY ALL HAVING count(*) >= 2) SELECT city, property_type, round(rent, 3) AS rent, round(sale, 5) AS sale FROM r JOIN s USING (city, property_type) WHERE rent <= 0.02 * sale", True)
def j3_rent_with_sale(spark: SparkSession, d: str) -> DataFrame:
    x = listings(spark, d)
    side = lambda s, n: x.where(F.col("status") == s).groupBy("city", "property_type").agg(median("price").alias(n), F.count("*").alias("k")).where("k >= 2").drop("k")
    return side("O", "o").join(side("F", "sale"), ["city", "property_type"]).withColumn("rent", F.col("o") / 150).where("rent <= 0.02 * sale").select("city", "property_type", r("rent", 3).alias("rent"), r("sale", 5).alias("sale"))


@query("WITH n AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY h), o AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT doc_id FROM n WHERE h NOT IN (SELECT h FROM o)")
def j12_insert_if_new(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    new = x.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return new.join(x.where("doc_id % 2 = 1").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("SELECT s_suppkey, n_name AS city, CASE WHEN s_suppkey % 3 = 0 THEN 30 + s_suppkey % 70 * 0.1 END AS lat FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j16_with_coordinates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    c = s.where("s_suppkey % 3 = 0").select("s_suppkey", (30 + F.col("s_suppkey") % 70 * 0.1).alias("lat"))
    return s.join(c, "s_suppkey", "left").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("city"), "lat")


@query("SELECT event_type, severity, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS severity, unnest(['mail', 'web', 'sms']) AS channel, user_id FROM events) WHERE list_contains(CASE WHEN severity = 'high' THEN ['mail', 'sms'] ELSE ['web'] END, channel) GROUP BY ALL")
def j8_alert_dispatch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("severity", F.when(F.col("value") > 100, "high").otherwise("low"))
    subs = spark.createDataFrame([("mail",), ("web",), ("sms",)], "channel string")  # a fixed list of three
    wanted = F.when(F.col("severity") == "high", F.array(F.lit("mail"), F.lit("sms"))).otherwise(F.array(F.lit("web")))
    return e.crossJoin(F.broadcast(subs)).where(F.array_contains(wanted, F.col("channel"))).groupBy("event_type", "severity").agg(F.count("*").alias("n"))


@query(_INVEST + "SELECT url, part, seller, price, round(score, 4) AS score, decision FROM v WHERE price <= 1.15 * 60000 ORDER BY round(v.score, 9) DESC, url, part, seller LIMIT 15", True)
def r15_investment_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best within 1.15 times the budget, with what makes the score."""
    x = invest(listings(spark, d)).where(F.col("price") <= 1.15 * 60000)
    return x.orderBy(F.desc(r("score", 9)), "url", "part", "seller").limit(15).select("url", "part", "seller", "price", r("score").alias("score"), "decision")
