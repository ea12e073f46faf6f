"""Records of nested sources, page texts behind a domain guard, and like rules of a rule set."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rooms_number, slug
from ..operators import dedup
from ..operators.vectors import cosine_pairs
from .base import query, r, table

# nested listings ---------------------------------------------------------------------------------------------

ITEM = """external_id string, id string, title string, description string, price double, url string, images array<string>,
    location struct<governorate: string, delegation: string>,
    metadata struct<publishedOn: string, state: string, subCategory: string, producttype: int, publisher: struct<name: string, isShop: boolean, isApproved: boolean>>"""


def known_text(x: Column) -> Column:
    """Without blanks around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def normalised_items(items: DataFrame, json_col: str = "item", site: str = "https://listings.example") -> DataFrame:
    """A flat row for each nested item, and ``known``: the names of its fields that are not null, in order.

    A missing level of the nesting, a missing list and a wrong type give nulls; so does text that isn't JSON. The own identifier comes before the internal one, the given address before one made from title and identifier.
    """
    i = items.select(F.from_json(json_col, ITEM).alias("i")).select("i.*")
    title, about, meta = known_text(F.col("title")), known_text(F.col("description")), F.col("metadata")
    said = F.concat_ws(" ", title, about)
    published = known_text(meta["publishedOn"])
    key = F.coalesce("external_id", "id")
    direct = F.when(F.col("url").startswith("/"), F.concat(F.lit(site), "url")).otherwise(F.col("url"))
    guess = F.concat(F.lit(f"{site}/item/"), F.coalesce(slug(title), F.lit("-")), F.lit("/"), key)
    fields = {
        "external_id": key,
        "title": title,
        "description": about,
        "price": F.col("price"),
        "city": known_text(F.col("location.governorate")),
        "area": known_text(F.col("location.delegation")),
        "image": F.get("images", F.lit(0)),
        "images_count": F.when(F.col("images").isNull(), 0).otherwise(F.size("images")).cast("long"),
        "published_on": published,
        "published_epoch": F.unix_seconds(published.try_cast("timestamp")).cast("double"),
        "state": meta["state"],
        "category_id": meta["subCategory"],
        "product_type": meta["producttype"],
        "publisher_name": known_text(meta["publisher"]["name"]),
        "publisher_is_shop": meta["publisher"]["isShop"],
        "publisher_is_approved": meta["publisher"]["isApproved"],
        "surface_m2_text": F.regexp_extract(F.lower(said), r"(\d+) ?m(?:2|²)", 1).try_cast("double"),
        "rooms_text": F.when(F.lower(said).rlike(r"s\s*\+\s*\d"), rooms_number(said)),
        "url_direct": direct,
        "url_guess": guess,
        "url": F.coalesce(direct, guess),
    }
    flat = i.select(*(c.alias(n) for n, c in fields.items()))
    return flat.withColumn("known", F.concat_ws(",", *(F.when(F.col(n).isNotNull(), F.lit(n)) for n in fields)))


def nested_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the nested items that a listing service would send; some levels, lists and fields are absent."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    unless = lambda n, c: F.when(k % n != 0, c)
    publisher = F.struct(F.col("c_name").alias("name"), (k % 2 == 0).alias("isShop"), unless(3, k % 4 == 0).alias("isApproved"))
    item = F.struct(
        unless(5, F.concat(F.lit("x"), k)).alias("external_id"), k.cast("string").alias("id"), F.concat(F.lit("  "), "o_orderpriority", F.lit(" home, S+"), k % 4, F.lit(" ")).alias("title"),
        F.when(k % 7 == 0, "   ").otherwise(unless(3, F.concat(F.lit("Flat of "), k % 200, F.lit(" m2")))).alias("description"), F.col("o_totalprice").alias("price"), F.when(k % 6 == 0, F.concat(F.lit("/i/"), k)).alias("url"),
        unless(13, F.transform(F.filter(F.sequence(F.lit(0), (k % 4).cast("int")), lambda x: x > 0), lambda x: F.concat(k, F.lit("-"), x))).alias("images"),
        unless(11, F.struct(F.col("n_name").alias("governorate"), F.col("r_name").alias("delegation"))).alias("location"),
        unless(17, F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedOn"), F.col("o_orderstatus").alias("state"), F.lit("homes").alias("subCategory"), (k % 2).cast("int").alias("producttype"), unless(9, publisher).alias("publisher"))).alias("metadata"),
    )
    return o.select(F.to_json(item).alias("item"))


_META = "CASE WHEN k % 17 <> 0 THEN {} END"
_ITEM_SQL = {
    "external_id": "CASE WHEN k % 5 <> 0 THEN 'x' || k ELSE k::VARCHAR END",
    "title": "title",
    "description": "CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 'Flat of ' || k % 200 || ' m2' END",
    "price": "o_totalprice",
    "city": "CASE WHEN k % 11 <> 0 THEN n_name END",
    "area": "CASE WHEN k % 11 <> 0 THEN r_name END",
    "image": "CASE WHEN k % 13 <> 0 AND k % 4 > 0 THEN k || '-1' END",
    "images_count": "CASE WHEN k % 13 <> 0 THEN k % 4 ELSE 0 END",
    "published_on": _META.format("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"),
    "published_epoch": _META.format("epoch(o_orderdate)::DOUBLE"),
    "state": _META.format("o_orderstatus"),
    "category_id": _META.format("'homes'"),
    "product_type": _META.format("k % 2"),
    "publisher_name": _META.format("CASE WHEN k % 9 <> 0 THEN c_name END"),
    "publisher_is_shop": _META.format("CASE WHEN k % 9 <> 0 THEN k % 2 = 0 END"),
    "publisher_is_approved": _META.format("CASE WHEN k % 9 <> 0 AND k % 3 <> 0 THEN k % 4 = 0 END"),
    "surface_m2_text": "CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN (k % 200)::DOUBLE END",
    "rooms_text": "k % 4 + 1",
    "url_direct": "CASE WHEN k % 6 = 0 THEN 'https://listings.example/i/' || k END",
    "url_guess": "'https://listings.example/item/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '/' || CASE WHEN k % 5 <> 0 THEN 'x' || k ELSE k::VARCHAR END",
    "url": "coalesce(url_direct, url_guess)",
}


@query("WITH o AS (SELECT *, o_orderkey AS k, o_orderpriority || ' home, S+' || o_orderkey % 4 AS title FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), f AS (SELECT " + ", ".join(f"{s} AS {n}" for n, s in _ITEM_SQL.items()) + " FROM o) SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in _ITEM_SQL) + ") AS known FROM f")
def s14_nested_items(spark: SparkSession, d: str) -> DataFrame:
    """Nested items as flat rows of twenty-one fields, with the names of those that are known."""
    return normalised_items(nested_items(spark, d))


# page texts --------------------------------------------------------------------------------------------------

#: Lone letters of the upright mark at a page's edge, the printer's line, and words of the domain, for the given tables.
MARKS, PRINTER, DOMAIN = ("TN", "RT"), "Official Printing Office", ("la", "de", "en", "st")


def page_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, ...] = MARKS, printer: str = PRINTER, words: tuple[str, ...] = DOMAIN, least: int = 50) -> DataFrame:
    """``(id, pages, hits, in_domain, body)`` of laid-out texts whose pages end with form feeds.

    Empty lines, a mark of at most 5 characters behind over 40 blanks, the printer's line, page numbers and dotted leaders go, then empty pages and control characters. ``hits`` counts the domain's words, also inside others;
    a text of fewer than ``least`` is outside the domain and has no body. A null text has no pages.
    """
    s = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
    noise = lambda x: (s(x) == "") | ((lead(x) > 40) & (F.length(s(x)) <= 5) & s(x).isin(*marks)) | x.contains(printer) | x.rlike(r"^\s*[0-9]{1,3}\s*$") | x.rlike(r"^\s*[.…]{4,}")
    page = lambda p: F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda x: ~noise(x)), s), "\n")
    split = docs.select(F.col(id_col).alias("id"), F.split(text_col, "\f").alias("p"))
    clean = F.regexp_replace(F.array_join(F.filter(F.transform("p", page), lambda x: x != ""), "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    told = split.select("id", F.when(F.col("p").isNull(), 0).otherwise(F.size("p")).cast("long").alias("pages"), F.regexp_replace(clean, r"\n{3,}", "\n\n").alias("body"))
    low = F.lower("body")
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
    counted = told.withColumn("hits", F.coalesce(F.round(hits), F.lit(0.0)).cast("long")).withColumn("in_domain", F.col("hits") >= least)
    return counted.select("id", "pages", "hits", "in_domain", F.when(F.col("in_domain"), F.col("body")).alias("body"))


_NOISE_SQL = f"s(x) = '' OR length(x) - length(regexp_replace(x, '^\\s+', '')) > 40 AND length(s(x)) <= 5 AND s(x) IN {MARKS} OR contains(x, '{PRINTER}') OR regexp_matches(x, '^\\s*[0-9]{{1,3}}\\s*$') OR regexp_matches(x, '^\\s*[.…]{{4,}}')".replace("s(x)", "regexp_replace(x, '^\\s+|\\s+$', '', 'g')")
_HITS_SQL = " + ".join(f"(length(lower(b)) - length(replace(lower(b), '{w}', ''))) // {len(w)}" for w in DOMAIN)


@query(f"WITH p AS (SELECT doc_id, string_split(repeat(' ', 45) || 'TN' || chr(10) || text || chr(10) || '  12 ' || chr(10) || '{PRINTER}, page 12' || chr(12) || '......... 7' || chr(10) || text || chr(12), chr(12)) AS p FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id AS id, len(p)::BIGINT AS pages, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(p, lambda q: array_to_string(list_transform(list_filter(string_split(q, chr(10)), lambda x: NOT ({_NOISE_SQL})), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10))), lambda q: q <> ''), chr(10)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS b FROM p) SELECT id, pages, ({_HITS_SQL})::BIGINT AS hits, hits >= 50 AS in_domain, CASE WHEN hits >= 50 THEN md5(b) END AS body FROM b")
def s22_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text laid out on two pages with marks, page numbers, the printer's line and leaders, cleaned again; texts outside the domain are told apart. The body as its MD5."""
    blank = F.lit(" " * 45 + "TN\n")
    laid = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(blank, "text", F.lit(f"\n  12 \n{PRINTER}, page 12\f......... 7\n"), "text", F.lit("\f")).alias("text"))
    return page_texts(laid).withColumn("body", F.md5("body"))


# like rules --------------------------------------------------------------------------------------------------


def _status(x: Column | str) -> Column:
    return F.coalesce(F.col(x).cast("string") if isinstance(x, str) else x.cast("string"), F.lit("\0"))  # unknown statuses are equal to each other


def like_rules(rules: DataFrame, threshold: float = 0.85, **options: int) -> DataFrame:
    """``(a, b, likeness)`` with a < b: of ``rules(id, status, vec)``, the pairs of one status whose vectors have a cosine of at least ``threshold``, over the whole table. Exact.

    Of rules that are equal in status and vector, the first stands for all, and each other is only paired with it. Null and zero vectors and non-finite numbers take no part.
    """
    usable = F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    known = rules.select("id", _status("status").alias("status"), F.col("vec").cast("array<double>").alias("vec")).where(usable)
    first = known.groupBy("vec", "status").agg(F.min("id").alias("first"))
    copies = known.join(first, ["vec", "status"]).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness")).distinct()
    # vectors meet once, whatever their statuses; the rules of each are found by the smallest id
    head = F.min("first").over(Window.partitionBy("vec"))
    member = first.withColumn("head", head).select("head", "status", "first")  # one row for a status of a vector
    apart = cosine_pairs(first.groupBy("vec").agg(F.min("first").alias("id")), threshold, vec_col="vec", **options)
    one, two = (member.select(F.col("head").alias(s), "status", F.col("first").alias(f"{s}_rule")) for s in "ab")
    met = apart.join(one, "a").join(two, ["b", "status"])
    return met.select(F.least("a_rule", "b_rule").alias("a"), F.greatest("a_rule", "b_rule").alias("b"), r("cosine", 3).alias("likeness")).unionByName(copies)


_LIKE = 0.3


@query(f"WITH x AS (SELECT vec_id AS id, label % 3 AS status, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY label % 3, embedding) AS h FROM embeddings) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 3) AS likeness FROM x a JOIN x b ON a.status = b.status AND a.id < b.id WHERE a.id = a.h AND b.id = b.h AND list_cosine_similarity(a.v, b.v) >= {_LIKE} UNION ALL SELECT DISTINCT h, id, 1.0 FROM x WHERE id > h")
def d16_semantic_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules (here: the given vectors, with a third of the labels as a status) that mean the same. The threshold is lower than in use, so that these tables have such pairs."""
    return like_rules(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("status"), F.col("embedding").alias("vec")), _LIKE)


def like_statements(rules: DataFrame, threshold: float = 0.85, most: int = dedup.BLOCK_ROWS) -> DataFrame:
    """``(status, a, b, likeness)`` with a < b: of the distinct statements in ``rules(status, actor, action, target)``, the pairs of one status whose Ratcliff-Obershelp ratio is at least ``threshold``. Exact; for rule sets without vectors.

    A statement is its three parts in lower case; a null part is empty. A ratio is at most twice the common letters (with repeats) over both lengths, so of a pair's letters, the rarest of a status first, one of the first few is
    common: statements meet there, a frequent letter is dealt into parts, and only pairs within that bound are scored.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("actor", "action", "target")]
    known = rules.select(_status("status").alias("status"), F.lower(F.trim(F.concat_ws(" ", *parts))).alias("t")).where("t <> ''").distinct()
    letter = known.select("status", "t", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("i", "c"))
    letter = letter.withColumn("k", F.row_number().over(Window.partitionBy("status", "t", "c").orderBy("i"))).select("status", "t", F.concat_ws("#", "c", "k").alias("x"))
    common = letter.groupBy("status", "x").agg(F.count("*").alias("n"))
    bags = letter.join(common, ["status", "x"]).groupBy("status", "t").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))  # a statement's own letters
    size = F.size("o")
    need = F.ceil(size * F.lit(threshold / (2 - threshold)) - 1e-9).cast("int")
    bags = bags.select("status", "t", F.transform("o", lambda m: m["x"]).alias("w"), F.greatest(size - need + 1, F.lit(1)).alias("head"))
    places = bags.select("status", "t", F.explode(F.slice("w", F.lit(1), F.col("head"))).alias("x"))
    met = dedup.met_in_blocks(places, ["status", "x"], "t", most).select(F.col("one.status").alias("status"), F.col("one.t").alias("a"), F.col("two.t").alias("b")).distinct()
    side = lambda s: bags.select("status", F.col("t").alias(s), F.col("w").alias(f"w{s}"))
    both = met.join(side("a"), ["status", "a"]).join(side("b"), ["status", "b"])
    worth = both.where(2 * F.size(F.array_intersect("wa", "wb")) / (F.size("wa") + F.size("wb")) >= threshold - 1e-9).select("status", "a", "b")

    def score(batches):
        for pdf in batches:
            yield pdf.assign(likeness=[statement_ratio(a, b) for a, b in zip(pdf["a"], pdf["b"])])

    scored = worth.mapInPandas(score, "status string, a string, b string, likeness double").where(F.col("likeness") >= threshold)
    return scored.select(F.nullif("status", F.lit("\0")).alias("status"), "a", "b", r("likeness", 3).alias("likeness"))


def statement_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@query()
def d16_like_statements(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rules: brand, type and name are actor, action and target, the size is the status."""
    return like_statements(table(spark, d, "part").select(F.col("p_size").alias("status"), F.col("p_brand").alias("actor"), F.col("p_type").alias("action"), F.col("p_name").alias("target")), 0.95)
