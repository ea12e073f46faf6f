"""Sources by file and upload, surfaces that users extend or call, and composed loads and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of, tokens
from ..operators import dedup
from ..sources.delimited import newest, read_latin, read_robust, read_upload
from ..sources.paged import paged
from . import aggregates, composites, scoring
from .base import QUERIES, SQL, listings, query, r, table
from .composites import _TRUST_SQL, stacked, trusted
from .feeds import _folder
from .language import _TOK
from .models import trust_net
from .relational import _sample_listings
from .scoring import _SENT, sentiment, sentiment_label

# sources -----------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation")
def s3_newest_file(spark: SparkSession, d: str) -> DataFrame:
    """Of two deliveries of a feed, the one written last is read."""
    root = _folder(spark, "s3")
    for version, name in (("1", "region"), ("2", "nation")):
        table(spark, d, name).coalesce(1).write.option("header", True).csv(f"{root}/{version}")
    return read_robust(spark, newest(spark, root, "*.csv"), "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name")


_UPLOAD = "Unnamed: 0;ville;prix\n0;NATION_0;120\n1;NATION_1;\n2;NATION_7;95\n3;ailleurs;10\n"


@query("SELECT u.*, n_nationkey FROM (VALUES ('NATION_0', 120.0), ('NATION_1', NULL), ('NATION_7', 95.0), ('ailleurs', 10.0)) u(ville, prix) LEFT JOIN nation ON n_name = ville")
def s4_upload(spark: SparkSession, d: str) -> DataFrame:
    u = read_upload(spark, _UPLOAD.encode(), _folder(spark, "s4")).withColumn("prix", F.col("prix").cast("double"))
    return u.join(table(spark, d, "nation"), F.col("ville") == F.col("n_name"), "left").select(*u.columns, "n_nationkey")


@query("SELECT p_partkey AS id, p_name || ' équipé' AS title, p_retailprice AS price, p_size::DOUBLE AS surface FROM part")
def s12_latin_history(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s12")
    french = table(spark, d, "part").select(F.col("p_partkey").alias("Numéro"), F.concat("p_name", F.lit(" équipé")).alias("Intitulé"), F.col("p_retailprice").alias("Prix"), F.col("p_size").alias("Superficie"))
    french.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    x = read_latin(spark, path, {"Numéro": "id", "Intitulé": "title", "Prix": "price", "Superficie": "surface"})
    return x.select(F.col("id").cast("long"), "title", F.col("price").cast("double"), F.col("surface").cast("double"))


def _feed(page: int) -> list[tuple]:
    return [(page, item, f"https://feed.example/{page}/{item}") for item in range(1, 26)]


@query("SELECT r_name, count(*) AS items, min(url) AS first FROM (SELECT p AS page, 'https://feed.example/' || p || '/' || i AS url FROM range(1, 11) a(p), range(1, 26) b(i)) JOIN region ON r_regionkey = page % 5 GROUP BY r_name")
def u2_registered_source(spark: SparkSession, d: str) -> DataFrame:
    """A source that is registered at run time and read page by page."""
    spark.dataSource.register(paged("example_feed", "page int, item int, url string", _feed))
    feed = spark.read.format("example_feed").option("pages", 10).load()
    return feed.join(table(spark, d, "region"), F.col("page") % 5 == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("items"), F.min("url").alias("first"))


# surfaces ----------------------------------------------------------------------------------------------------


class Rules:
    """Expectations that users add one by one; all are measured in one pass."""

    def __init__(self) -> None:
        self.held: list[tuple[str, bool, Column, float, float]] = []

    def expect(self, name: str, measure: Column, least: float = float("-inf"), most: float = float("inf"), critical: bool = False) -> Rules:
        self.held.append((name, critical, measure, least, most))
        return self

    def check(self, df: DataFrame) -> DataFrame:
        return scoring.validate(df, self.held)


@query("""WITH m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT o_orderkey)::DOUBLE AS k, min(o_totalprice) AS least, count(*) FILTER (o_custkey IS NULL)::DOUBLE AS orphans FROM orders)
SELECT 'rows' AS rule, true AS critical, n AS value, n >= 1 AS passed FROM m UNION ALL SELECT 'keys', true, k, k >= 100000000 FROM m UNION ALL SELECT 'least price', false, least, least >= 0 FROM m UNION ALL SELECT 'orphans', false, orphans, orphans <= 0 FROM m""")
def u1_own_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = Rules().expect("rows", F.count("*"), 1, critical=True).expect("keys", F.count_distinct("o_orderkey"), 1e8, critical=True)
    return rules.expect("least price", F.min("o_totalprice"), 0).expect("orphans", F.count_if(F.col("o_custkey").isNull()), most=0).check(table(spark, d, "orders"))


@query(_TRUST_SQL + """ SELECT 'market' AS tool, json_object('city', city, 'n', count(*), 'price', round(median(price))::BIGINT)::VARCHAR AS answer FROM listing GROUP BY city
UNION ALL SELECT 'suspects', json_object('source', source, 'n', count(*))::VARCHAR FROM t WHERE trust < 0.6 GROUP BY source
UNION ALL SELECT 'span', json_object('first', strftime(min(seen), '%Y-%m-%d'), 'last', strftime(max(seen), '%Y-%m-%d'))::VARCHAR FROM listing""", True)
def u3_agent_tools(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three tools as JSON, a row each."""
    x = listings(spark, d)
    answer = lambda tool, df: df.select(F.lit(tool).alias("tool"), F.to_json(F.struct("*")).alias("answer"))
    market = x.groupBy("city").agg(F.count("*").alias("n"), F.round(composites.median("price")).cast("long").alias("price"))
    suspects = trusted(x).where("trust < 0.6").groupBy("source").agg(F.count("*").alias("n"))
    span = x.agg(F.date_format(F.min("seen"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("seen"), "yyyy-MM-dd").alias("last"))
    return stacked(answer("market", market), answer("suspects", suspects), answer("span", span))


def page_of(spark: SparkSession, d: str, name: str, order: list[str], page: int, size: int) -> DataFrame:
    """A page (from 1) of a catalogue query's answer in a total order, as a service would return it: a top-n by Spark, never the whole answer."""
    return QUERIES[name](spark, d).orderBy(*order).offset((page - 1) * size).limit(size)


@query(f"SELECT * FROM ({SQL['a4_spatial_by_nation']}) ORDER BY city LIMIT 10 OFFSET 10")
def u5_page_of_statistics(spark: SparkSession, d: str) -> DataFrame:
    return page_of(spark, d, aggregates.a4_spatial_by_nation.__name__, ["city"], 2, 10)


@query(f"SELECT * FROM ({SQL['r21_rule_risk']}) ORDER BY risk DESC, o_orderkey LIMIT 25")
def u6_page_of_rules(spark: SparkSession, d: str) -> DataFrame:
    return page_of(spark, d, "r21_rule_risk", [F.desc("risk"), "o_orderkey"], 1, 25)


@query(f"SELECT * FROM ({SQL['t12_compound_projection']}) ORDER BY projected DESC, city LIMIT 5 OFFSET 5")
def u7_page_of_projections(spark: SparkSession, d: str) -> DataFrame:
    return page_of(spark, d, "t12_compound_projection", [F.desc("projected"), "city"], 2, 5)


#: A dictionary of terms, and terms that are added at run time; an added term replaces an older one.
_TERMS, _ADDED = [("le", "the"), ("la", "the"), ("dans", "inside")], [("avec", "with"), ("dans", "in")]


def with_terms(spark: SparkSession, base: DataFrame, added: list[tuple[str, str]]) -> DataFrame:
    new = spark.createDataFrame(added, "word string, plain string")
    return new.unionByName(base.join(new, "word", "left_anti"))


@query(f"WITH w AS (SELECT unnest({_TOK}) AS word FROM conversations), t(word, plain) AS (VALUES ('le', 'the'), ('la', 'the'), ('dans', 'in'), ('avec', 'with')) SELECT coalesce(plain, word) AS term, count(*) AS n FROM w LEFT JOIN t USING (word) GROUP BY term")
def u8_added_terms(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of words after the dictionary, with its added terms, has been applied. Equal words are counted before the join."""
    terms = with_terms(spark, spark.createDataFrame(_TERMS, "word string, plain string"), _ADDED)
    words = table(spark, d, "conversations").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(terms, "word", "left").groupBy(F.coalesce("plain", "word").alias("term")).agg(F.sum("n").alias("n"))


# pairs, explanations and loads -------------------------------------------------------------------------------


@query("WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal <= 0 THEN -1 ELSE floor(s_acctbal * 10 / 15000) * 15000 END::BIGINT AS block, n_name AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT a.id AS a, b.id AS b, a.block AS block FROM s a JOIN s b ON a.block = b.block AND a.city = b.city AND a.id < b.id")
def j7_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.block_pairs(_sample_listings(spark, d)).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.col("one.block").alias("block"))


@query(_TRUST_SQL + """, e AS (SELECT url, part, seller, trust, round((ppm2 / med - 1) * 100, 2) AS vs_city, CASE source WHEN 'A' THEN 0.92 WHEN 'N' THEN 0.78 ELSE 0.65 END AS s, surface, price FROM t)
SELECT url, part, seller, trust, vs_city, CASE WHEN vs_city > 10 THEN 'above' WHEN vs_city < -10 THEN 'below' ELSE 'in line' END AS position, round(trust - 0.3 * s - 0.7, 4) AS price_part, round(0.3 * s - 0.3, 4) AS source_part,
concat_ws(',', CASE WHEN abs(vs_city) > 30 THEN 'price far from city' END, CASE WHEN s < 0.7 THEN 'weak source' END, CASE WHEN surface < 5 THEN 'small surface' END) AS flags FROM e WHERE trust < 0.75""", True)
def b8_explain_trust(spark: SparkSession, d: str) -> DataFrame:
    """Why a listing's trust is low: what price and source take from it, its place in the city's market, and flags."""
    s = F.when(F.col("source") == "A", 0.92).when(F.col("source") == "N", 0.78).otherwise(0.65)
    x = trusted(listings(spark, d)).where("trust < 0.75").withColumns({"vs_city": r((F.col("ppm2") / F.col("med") - 1) * 100, 2), "s": s})
    gap = F.col("vs_city")
    flags = F.concat_ws(",", F.when(F.abs(gap) > 30, "price far from city"), F.when(F.col("s") < 0.7, "weak source"), F.when(F.col("surface") < 5, "small surface"))
    return x.select(
        "url", "part", "seller", "trust", "vs_city", F.when(gap > 10, "above").when(gap < -10, "below").otherwise("in line").alias("position"),
        r(F.col("trust") - 0.3 * F.col("s") - 0.7).alias("price_part"), r(0.3 * F.col("s") - 0.3).alias("source_part"), flags.alias("flags"),
    )


@query(f"WITH s AS (SELECT doc_id, round({_SENT}, 4) AS score, concat_ws(',', CASE WHEN lower(text) LIKE '%urgent%' THEN 'pressure' END, CASE WHEN regexp_matches(lower(text), 'idiot|moron|clown|worthless') THEN 'insult' END, CASE WHEN regexp_matches(text, '[0-9]{{8,}}') THEN 'number' END) AS flags FROM documents) SELECT *, CASE WHEN score >= 0.75 THEN 'positive' WHEN score >= 0.55 THEN 'neutral' WHEN score >= 0.35 THEN 'doubtful' ELSE 'negative' END AS label FROM s")
def b9_sentiment_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Each text's score by rule, its label and its flags."""
    low = F.lower("text")
    flags = F.concat_ws(",", F.when(low.contains("urgent"), "pressure"), F.when(any_of(low, ["idiot", "moron", "clown", "worthless"]), "insult"), F.when(F.col("text").rlike("[0-9]{8,}"), "number"))
    return table(spark, d, "documents").select("doc_id", r(sentiment()).alias("score"), flags.alias("flags")).withColumn("label", sentiment_label(F.col("score")))


@query()
def b18_trust_batch(spark: SparkSession, d: str) -> DataFrame:
    """The net's class by name, a score between the classes, and its probabilities."""
    p = F.col("p")
    named = F.element_at(F.array(*map(F.lit, ("suspect", "fair", "reliable"))), F.col("prediction").cast("int") + 1)
    return trust_net(spark, d).select("url", named.alias("class"), r(0.5 * p[1] + p[2]).alias("score"), *(r(p[i]).alias(f"p{i}") for i in range(3)))


@query("""WITH i AS (SELECT o_orderkey AS url, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price, o_orderdate AS seen FROM orders), k AS (SELECT url, price, CASE WHEN price IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - abs(price - 250000) / 250000)) END AS score, strftime(seen, '%Y-%m-%dT%H:%M:%S') AS published FROM i WHERE price BETWEEN 5000 AND 450000 OR price IS NULL),
c AS (SELECT o_orderkey AS url, o_totalprice + CASE o_orderstatus WHEN 'P' THEN 10 ELSE 0 END AS price FROM orders WHERE o_orderdate < DATE '1998-01-01')
SELECT CASE WHEN c.url IS NULL THEN 'insert' WHEN k.url IS NULL THEN 'keep' WHEN c.price IS DISTINCT FROM k.price THEN 'update' ELSE 'skip' END AS action, count(*) AS n, round(avg(score), 4) AS mean_score, max(published) AS latest FROM k FULL JOIN c ON c.url = k.url GROUP BY action""")
def b26_initial_load(spark: SparkSession, d: str) -> DataFrame:
    """A first load from end to end: rename and cast, keep plausible or unknown prices, score, ISO times, upsert against what is stored."""
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("string")).alias("prix"), F.unix_timestamp("o_orderdate").alias("publication"))
    x = raw.withColumn("price", F.col("prix").try_cast("double")).where(F.col("price").between(5000, 450000) | F.col("price").isNull())
    score = F.when(F.col("price").isNull(), 0.5).otherwise(scoring.clamp(1 - F.abs(F.col("price") - 250000) / 250000))
    clean = x.select("url", "price", score.alias("score"), F.date_format(F.timestamp_seconds("publication"), "yyyy-MM-dd'T'HH:mm:ss").alias("published"))
    stored = table(spark, d, "orders").where("o_orderdate < date'1998-01-01'").select(F.col("o_orderkey").alias("url"), (F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "P", 10).otherwise(0)).alias("price"))
    acted = dedup.upsert(stored.withColumns({"score": F.lit(None).cast("double"), "published": F.lit(None).cast("string")}), clean, "url", ["price"], also=["score", "published"])
    return acted.groupBy("action").agg(F.count("*").alias("n"), r(F.avg("new_score")).alias("mean_score"), F.max("new_published").alias("latest"))
