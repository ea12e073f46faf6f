"""Text parsing, retrieval, classification of texts, and rule checks."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import semantic
from ..functions.text import cosine, tokens
from .base import query, r, table

# parsers: texts made from the tables' numbers, so that both engines read the same strings ---------------------


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, max(CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN round(l_extendedprice / 1000) * 1000 ELSE (floor(l_quantity) / 10) * 1e6 END) AS price FROM lineitem GROUP BY ALL")
def x1_price_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    whole = F.floor("l_extendedprice").cast("string")
    said = F.when(n == 0, "Prix sur demande").when(n == 1, F.concat(F.substring(whole, F.lit(1), F.length(whole) - 3), F.lit(" "), F.substring(whole, -3, 3), F.lit(" DT"))).when(n == 2, F.concat(F.round(F.col("l_extendedprice") / 1000).cast("int").cast("string"), F.lit("k"))).otherwise(F.concat((F.floor("l_quantity") / 10).cast("string"), F.lit(" million TND")))
    fixed = F.when((n == 1) & (F.length(whole) <= 3), whole).otherwise(said)
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", T.price_number(fixed).alias("price"))
    return x.groupBy("id", "l_partkey").agg(F.max("price").alias("price"))


@query("SELECT p_partkey, round(p_retailprice, 1) AS price FROM part")
def x2_decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.regexp_replace(F.round("p_retailprice", 1).cast("string"), r"\.", ","), F.lit(" TND"))
    return table(spark, d, "part").select("p_partkey", T.decimal_comma_price(said).alias("price"))


@query("SELECT p_partkey, p_size::DOUBLE AS surface FROM part")
def x3_surface_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.surface_number(F.concat(F.col("p_size").cast("string"), F.lit(" m2"))).alias("surface"))


@query("SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 WHEN p_size BETWEEN 1 AND 20 THEN p_size END)::BIGINT AS rooms FROM part")
def x4_rooms_text(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S+"), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" pièces")))
    return table(spark, d, "part").select("p_partkey", T.rooms_number(said).cast("long").alias("rooms"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'machine' WHEN regexp_matches(lower(p_type), 'small') THEN 'small' ELSE 'other' END AS kind FROM part")
def x6_property_type(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.lower("p_name"), F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(name.rlike("ring|bolt"), "fastener").when(name.rlike("widget|gear"), "machine").when(kind.rlike("small"), "small").otherwise("other").alias("kind"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def x8_clean_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.without_tags(F.col("html"))).alias("digest"))


@query("SELECT page_id, try_cast(replace(regexp_extract(html, '[0-9]+([.,][0-9]+)?', 0), ',', '.') AS DOUBLE) AS number FROM pages")
def x9_first_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", r"[0-9]+([.,][0-9]+)?", 0), ",", ".").try_cast("double").alias("number"))


@query("WITH m AS (SELECT median(value) AS med FROM events WHERE value > 10) SELECT event_type, round(avg(coalesce(CASE WHEN value > 10 THEN value END, med)), 4) AS mean FROM events, m GROUP BY event_type")
def x10_median_imputation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")))
    return e.crossJoin(F.broadcast(e.agg(F.percentile("v", F.lit(0.5)).alias("med")))).groupBy("event_type").agg(r(F.avg(F.coalesce("v", "med"))).alias("mean"))


@query("SELECT doc_id, left(trim(regexp_replace(translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '-'), 90) AS slug FROM documents")
def x12_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events")
def x14_iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


_STOP = {"en": ["the", "and", "of", "with", "for"], "fr": ["les", "des", "est", "une", "dans"], "de": ["und", "der", "die", "nicht", "auf"], "es": ["los", "las", "una", "por", "del"]}


@query("WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9àâäéèêëîïôöùûüçñóíáúß]+'), lambda w: length(w) > 1) AS ws FROM documents), v AS (SELECT doc_id, lang, " + ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in ws)}))) AS {g}" for g, ws in _STOP.items()) + " FROM w) SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS guess FROM v")
def x17_detect_language(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("ws"))
    held = lambda ws: F.size(F.filter("ws", lambda x: x.isin(ws)))
    v = w.select("doc_id", *(held(ws).alias(g) for g, ws in _STOP.items()))
    most = F.greatest("en", "fr", "de", "es")
    return v.select("doc_id", F.when(most == 0, "unknown").when(F.col("en") == most, "en").when(F.col("fr") == most, "fr").when(F.col("de") == most, "de").otherwise("es").alias("guess"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9àâäéèêëîïôöùûüçñóíáúß]+'), lambda w: length(w) > 1)"


@query(f"SELECT conv_id, turn, len({_TOK})::BIGINT AS n, coalesce(array_to_string(list_transform(range(1, least(4, len({_TOK}))), lambda i: {_TOK}[i] || '_' || {_TOK}[i + 1]), ' '), '') AS pairs FROM conversations")
def x19_tokens_and_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("w", tokens(F.col("text")))
    n = F.size("w")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.least(F.lit(3), n - 1)), lambda i: F.concat_ws("_", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", n.cast("long").alias("n"), F.array_join(pairs, " ").alias("pairs"))


@query(f"WITH t AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), r AS (SELECT conv_id, u AS word, count(*) AS n FROM (SELECT conv_id, unnest(w) AS u FROM t WHERE turn = 0) GROUP BY ALL), h AS (SELECT conv_id, u AS word, count(*) AS n FROM (SELECT conv_id, unnest(w) AS u FROM t WHERE turn = 1) GROUP BY ALL) SELECT conv_id, round(sum(least(h.n, coalesce(r.n, 0))) / sum(h.n), 4) AS bleu FROM h LEFT JOIN r USING (conv_id, word) GROUP BY conv_id")
def x20_bleu(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("turn in (0, 1)").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("word"))
    n = c.groupBy("conv_id", "word").agg(F.count_if(F.col("turn") == 0).alias("a"), F.count_if(F.col("turn") == 1).alias("b")).where("b > 0")
    return n.groupBy("conv_id").agg(r(F.sum(F.least("a", "b")) / F.sum("b")).alias("bleu"))


@query("WITH s AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS line FROM (SELECT doc_id, split(text, chr(10)) AS x FROM documents)) SELECT doc_id, k, length(line) AS size FROM s WHERE length(line) > 400")
def x25_segments(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return s.where(F.length("line") > 400).select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.length("line").cast("long").alias("size"))


@query("WITH c AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) SELECT source, count(*) AS parts, max(upto)::BIGINT AS used FROM c WHERE upto <= 20000 GROUP BY source")
def x27_context_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").withColumn("upto", F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return c.where("upto <= 20000").groupBy("source").agg(F.count("*").alias("parts"), F.max("upto").alias("used"))


@query("SELECT event_type, json_extract_string(j, '$.step') AS step, max(json_extract_string(j, '$.k')::BIGINT) AS top FROM (SELECT event_type, to_json({step: event_type, k: json_extract_string(props, '$.k')::BIGINT}) AS j FROM events) GROUP BY ALL")
def x28_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("event_type").alias("step"), F.from_json("props", "k long").getField("k").alias("k")))
    back = F.from_json(j, "step string, k long")
    return table(spark, d, "events").select("event_type", back.alias("b")).groupBy("event_type", F.col("b.step").alias("step")).agg(F.max("b.k").alias("top"))


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), left(source, 3), 'autre') AS filled FROM documents")
def x29_merge_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.substring("source", 1, 3), F.lit("autre")).alias("filled"))


# classifiers -------------------------------------------------------------------------------------------------


def class_scores(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """``(key, label, score)``: the log of prior times likelihood of each text in each class, by multinomial Naive Bayes with add-one smoothing.

    ``train`` has (label, words), ``test`` (key, words). Counts are joined by word; unseen words weigh log(1 / (N + V)). Classes are few, and broadcast by size only.
    """
    term = train.select("label", F.explode("words").alias("w")).groupBy("label", "w").agg(F.count("*").alias("n"))
    size = term.groupBy("label").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(term.agg(F.count_distinct("w").alias("v"))))
    prior = train.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(train.agg(F.count("*").alias("all"))))
    classes = size.join(prior, "label").select("label", (F.col("total") + F.col("v")).alias("base"), F.log(F.col("c") / F.col("all")).alias("prior"))
    seen = test.select(key, F.explode("words").alias("w")).groupBy(key, "w").agg(F.count("*").alias("k"))
    held = seen.join(term, "w").groupBy(key, "label").agg(F.sum(F.col("k") * F.log(F.col("n") + 1.0)).alias("gain"))
    length = test.select(key, F.size("words").alias("size"))
    all_classes = length.crossJoin(F.broadcast(classes)).join(held, [key, "label"], "left")
    score = F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.log("base")
    return all_classes.select(key, "label", score.alias("score"))


def naive_bayes(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """``(key, label, score)``: the best class of each text by ``class_scores``."""
    best = class_scores(train, test, key)
    return best.groupBy(key).agg(F.max_by("label", F.struct(r("score", 6), "label")).alias("label"), r(F.max("score"), 3).alias("score"))


def mean_posteriors(train: DataFrame, variants: list[DataFrame], key: str = "id") -> DataFrame:
    """``(key, label, confidence)``: the class of the largest mean posterior over a text's variants."""
    every, parts = Window.partitionBy(key), None
    for test in variants:
        s = class_scores(train, test, key)
        e = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(every)))  # a row a class
        p = e.select(key, "label", (F.col("e") / F.sum("e").over(every)).alias("p"))
        parts = p if parts is None else parts.union(p)
    mean = parts.groupBy(key, "label").agg(F.sum("p").alias("p"))
    mean = mean.withColumn("p", r(F.col("p") / F.sum("p").over(every)))
    return mean.groupBy(key).agg(F.max_by("label", F.struct("p", "label")).alias("label"), F.max("p").alias("confidence"))


_BAYES = (
    f"c AS (SELECT conv_id * 1000 + turn AS id, role AS label, conv_id % 2 = 0 AS train, {_TOK} AS w FROM conversations), t AS (SELECT label, u AS w, count(*) AS n FROM (SELECT label, unnest(w) AS u FROM c WHERE train) GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM t), s AS (SELECT label, sum(n) AS total FROM t GROUP BY label), "
    "p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM c WHERE train)) AS prior FROM c WHERE train GROUP BY label)"
)


def _bayes_sql(name: str, words: str) -> str:
    """Posteriors of one variant of the messages that were not learned from."""
    return (
        f"{name}c AS (SELECT id, {words} AS w FROM c WHERE NOT train), {name}x AS (SELECT id, u AS w, count(*) AS k FROM (SELECT id, unnest(w) AS u FROM {name}c) GROUP BY ALL), {name}g AS (SELECT id, label, sum(k * ln(n + 1)) AS gain FROM {name}x JOIN t USING (w) GROUP BY ALL), "
        f"{name}z AS (SELECT y.id, p.label, prior + coalesce(gain, 0) - len(y.w) * ln(total + v) AS score FROM {name}c y, p JOIN s USING (label), v LEFT JOIN {name}g g ON g.id = y.id AND g.label = p.label), {name}e AS (SELECT id, label, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM {name}z), {name}p AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS q FROM {name}e)"
    )


@query("WITH " + _BAYES + ", " + _bayes_sql("one", "w") + ", " + _bayes_sql("two", "list_filter(w, lambda x: length(x) >= 4)") + ", m AS (SELECT id, label, sum(q) AS q FROM (SELECT * FROM onep UNION ALL SELECT * FROM twop) GROUP BY ALL), n AS (SELECT id, label, round(q / sum(q) OVER (PARTITION BY id), 4) AS q FROM m) SELECT id, label, q AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY q DESC, label DESC) = 1")
def x16_trained_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """A message's intent (here: its role) by the trained classifier's mean posterior over its words and over its longer words."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label"), (F.col("conv_id") % 2 == 0).alias("train"), tokens(F.col("text")).alias("words"))
    test = c.where("not train").select("id", "words")
    return mean_posteriors(c.where("train"), [test, test.withColumn("words", F.filter("words", lambda w: F.length(w) >= 4))])


@query(f"WITH c AS (SELECT conv_id * 1000 + turn AS id, role AS label, conv_id % 2 = 0 AS train, {_TOK} AS w FROM conversations), t AS (SELECT label, u AS w, count(*) AS n FROM (SELECT label, unnest(w) AS u FROM c WHERE train) GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM t), s AS (SELECT label, sum(n) AS total FROM t GROUP BY label), p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM c WHERE train)) AS prior FROM c WHERE train GROUP BY label), x AS (SELECT id, u AS w, count(*) AS k FROM (SELECT id, unnest(w) AS u FROM c WHERE NOT train) GROUP BY ALL), g AS (SELECT id, label, sum(k * ln(n + 1)) AS gain FROM x JOIN t USING (w) GROUP BY ALL), z AS (SELECT c.id, p.label, prior + coalesce(gain, 0) - len(c.w) * ln(total + v) AS score FROM c, p JOIN s USING (label), v LEFT JOIN g ON g.id = c.id AND g.label = p.label WHERE NOT c.train) SELECT id, label, round(score, 3) AS score FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, label DESC) = 1")
def m12_naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label"), (F.col("conv_id") % 2 == 0).alias("train"), tokens(F.col("text")).alias("words"))
    return naive_bayes(c.where("train"), c.where("not train"))


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 'legal' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'contact' WHEN regexp_matches(text, '@[a-z0-9.]+') THEN 'mail' ELSE 'prose' END AS kind FROM documents")
def m6_keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(F.lower(t).contains("license"), "legal").when(t.rlike("[0-9]{3}-[0-9]{4}"), "contact").when(t.rlike("@[a-z0-9.]+"), "mail").otherwise("prose").alias("kind"))


_CONCEPTS = {"people": ["idiot", "clown"], "terms": ["license", "rights"], "links": ["example", "http"]}


def times(text: Column, word: str) -> Column:
    """How often a word occurs, by what its removal takes from the length."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


@query("WITH k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS concept, doc_id, ({' + '.join(f'(length(t) - length(replace(t, {w!r}, {chr(39) * 2}))) / {len(w)}' for w in ws)}) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)" for c, ws in _CONCEPTS.items()) + "), x AS (SELECT concept, doc_id, hits, row_number() OVER (PARTITION BY concept ORDER BY hits DESC, doc_id) AS place FROM k WHERE hits > 0) SELECT concept, doc_id, round(hits, 2)::DOUBLE AS hits, place FROM x WHERE place <= 20")
def m17_concept_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = F.array(*(F.struct(F.lit(c).alias("concept"), sum((times(F.col("t"), w) for w in ws), F.lit(0.0)).alias("hits")) for c, ws in _CONCEPTS.items()))
    k = docs.select("doc_id", F.explode(hits).alias("x")).select("x.concept", "doc_id", "x.hits").where("hits > 0")
    return k.withColumn("place", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("hits"), "doc_id"))).where("place <= 20").withColumn("hits", r("hits", 2))


def text_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label", dims: int = 1 << 14):
    """``(features, labels, weights, bias)``: hashed TF-IDF, and one linear SVM for each class against the rest (a column of ``weights`` each)."""
    steps = [RegexTokenizer(inputCol=text_col, outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="counts", numFeatures=dims), IDF(inputCol="counts", outputCol="features")]
    features, classes = Pipeline(stages=steps).fit(train), StringIndexer(inputCol=label_col, outputCol="class", stringOrderType="alphabetAsc").fit(train)
    one = OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), labelCol="class", featuresCol="features").fit(classes.transform(features.transform(train)))
    return features, classes.labels, np.column_stack([m.coefficients.toArray() for m in one.models]), np.array([m.intercept for m in one.models])


def classified(model, df: DataFrame) -> DataFrame:
    """``df`` with ``model_type``, the class of the largest margin, and ``margin``."""
    features, labels, weights, bias = model
    x = semantic.dense(features.transform(df).select(*df.columns, "features"), semantic.Decomposition(bias, weights), "features", "scores")
    margins = F.zip_with("scores", F.array(*(F.lit(float(b)) for b in bias)), lambda m, b: m + b)
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    return x.withColumn("margins", margins).select(*df.columns, F.element_at(F.array(*map(F.lit, labels)), best).alias("model_type"), F.array_max("margins").alias("margin"))


@query()
def m6_type_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Types (here: languages) by text: the model's where its margin is positive, else by keywords in order; only a generic type (here: of a fifth of the rows, or null) is overridden. The model learns from the rows that have a type."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang")).alias("label"))
    model = text_classifier(docs.where("label IS NOT NULL AND text <> ''"))
    x = classified(model, docs)
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    words = F.when(low.contains(" the "), "en").when(low.contains(" und "), "de").when(low.contains(" les "), "fr").when(low.contains(" que "), "es").otherwise("autre")
    kind = F.coalesce("label", F.when((F.col("margin") > 0) & (F.col("text") != ""), F.col("model_type")).otherwise(words))
    by = F.when(F.col("label").isNotNull(), "given").when((F.col("margin") > 0) & (F.col("text") != ""), "model").otherwise("keywords")
    return x.select("doc_id", kind.alias("type"), by.alias("by"), r("margin").alias("margin"))


def concept_chunks(docs: DataFrame, concepts: dict[str, list[str]], candidates: int = 20, top: int = 4, topics: int = 16, dims: int = 4096) -> DataFrame:
    """``(concept, doc_id, place, lexical, semantic, score, coverage)``: of each concept's ``candidates`` texts with most keywords the ``top`` by 0.4 lexical (divided by the concept's largest) and 0.6 semantic score.

    Semantic is the cosine between a text and the concept's keywords along the leading singular vectors of all texts' TF-IDF; coverage is the percentage of a concept's keywords that its chosen texts hold.
    """
    spark = docs.sparkSession
    known = docs.where("text IS NOT NULL").select("doc_id", "text", F.lower("text").alias("t"))
    hits = F.array(*(F.struct(F.lit(c).alias("concept"), sum((times(F.col("t"), w) for w in ws), F.lit(0.0)).alias("hits"), F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(F.col("t"), w)).alias("held")) for c, ws in concepts.items()))
    k = known.select("doc_id", "text", F.explode(hits).alias("x")).select("x.*", "doc_id", "text").where("hits > 0")
    some = k.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("hits"), "doc_id"))).where(F.col("rank") <= candidates).drop("rank")
    model, rows = semantic.weighted_terms(known.select("doc_id", "text"), dims=dims)
    found = semantic.truncated_svd(rows, "terms", topics, dims)
    asked = spark.createDataFrame([(c, " ".join(ws)) for c, ws in concepts.items()], "concept string, text string")  # a row a concept
    meant = semantic.dense(semantic.with_terms(model, asked).select("concept", "terms"), found, out="meant")
    placed = semantic.dense(semantic.with_terms(model, some), found).join(F.broadcast(meant), "concept")
    every = Window.partitionBy("concept")  # at most ``candidates`` rows each
    x = placed.withColumns({"lexical": F.col("hits") / F.max("hits").over(every), "semantic": F.coalesce(cosine("dense", "meant"), F.lit(0.0))})
    x = x.withColumn("score", r(0.4 * F.col("lexical") + 0.6 * F.col("semantic"), 6))
    x = x.withColumn("place", F.row_number().over(every.orderBy(F.desc("score"), "doc_id"))).where(F.col("place") <= top)
    total = F.create_map(*(F.lit(v) for c, ws in concepts.items() for v in (c, len(ws))))
    x = x.withColumn("coverage", r(100 * F.size(F.array_distinct(F.flatten(F.collect_list("held").over(every)))) / total[F.col("concept")], 1))
    return x.select("concept", "doc_id", F.col("place").cast("long").alias("place"), r("lexical", 6).alias("lexical"), r("semantic", 6).alias("semantic"), "score", "coverage")


@query()
def m17_concept_coverage(spark: SparkSession, d: str) -> DataFrame:
    return concept_chunks(table(spark, d, "documents").select("doc_id", "text"), {**_CONCEPTS, "words": ["with", "from", "that", "zzzz"]})


@query("WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, label AS ql FROM embeddings WHERE vec_id IN (3, 77)), s AS (SELECT qid, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) + least(0.15, 0.03 * (label = ql)::INT) AS s FROM q, embeddings WHERE vec_id <> qid) SELECT qid, vec_id, round(s, 4) AS score, CASE WHEN s >= 0.70 THEN 'high' WHEN s >= 0.45 THEN 'medium' WHEN s >= 0.25 THEN 'low' ELSE 'none' END AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) <= 5")
def m18_vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id in (3, 77)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("ql"))  # a stated pair of queries
    s = e.crossJoin(F.broadcast(q)).where("vec_id <> qid").withColumn("s", cosine("q", "embedding") + F.least(F.lit(0.15), 0.03 * (F.col("label") == F.col("ql")).cast("int")))
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "vec_id"))).where("k <= 5")
    return top.select("qid", "vec_id", r("s").alias("score"), F.when(F.col("s") >= 0.70, "high").when(F.col("s") >= 0.45, "medium").when(F.col("s") >= 0.25, "low").otherwise("none").alias("confidence"))


@query("SELECT doc_id, round(least(1.0, ((length(t) - length(replace(t, 'the', ''))) / 3 + (length(t) - length(replace(t, 'tion', ''))) / 4) / 10), 4)::DOUBLE AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE t LIKE '%the%' ORDER BY score DESC, doc_id LIMIT 50")
def m19_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    s = F.least(F.lit(1.0), (times(t, "the") + times(t, "tion")) / 10)
    return table(spark, d, "documents").where(t.contains("the")).select("doc_id", r(s).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


# rules -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE length(text) >= 3 AND source IN ('src0', 'src1', 'src2') AND lang IS NOT NULL AND NOT regexp_matches(lower(text), 'idiot|moron|clown|worthless') AND regexp_matches(lower(text), 'license|the|der|les|los')")
def f11_valid_rules(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "documents").where((F.length("text") >= 3) & F.col("source").isin("src0", "src1", "src2") & F.col("lang").isNotNull() & ~low.rlike("idiot|moron|clown|worthless") & low.rlike("license|the|der|les|los")).select("doc_id")


@query("SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_matches(text, '!!') THEN 'shouting' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN lower(text) LIKE '%moron%' THEN 'insult' END AS reason, count(*) AS n FROM documents GROUP BY reason")
def f12_first_reason(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy(F.when(t.isNull() | (t == ""), "empty").when(t.rlike("!!"), "shouting").when(t.rlike("[#$%&*]{3}"), "symbols").when(F.lower(t).contains("moron"), "insult").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(list_filter(['license', 'rights', 'mail', 'token'], lambda k: contains(lower(text), k)))::BIGINT AS hits FROM documents WHERE len(list_filter(['license', 'rights', 'mail', 'token'], lambda k: contains(lower(text), k))) > 0")
def f13_domain_gate(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ["license", "rights", "mail", "token"]))
    x = table(spark, d, "documents").withColumn("low", F.lower("text")).where(F.exists(words, lambda k: F.contains(F.col("low"), k)))
    return x.select("doc_id", F.size(F.filter(words, lambda k: F.contains(F.col("low"), k))).cast("long").alias("hits"))


@query("SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f14_rules_page(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").where("o_orderpriority like '%HIGH%' and o_orderstatus = 'O'")
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("total")))).orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice", "total")


@query("WITH c AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4)) AS ws FROM documents), q AS (SELECT ['with', 'from', 'that', 'this', 'were'] AS needed) SELECT doc_id, len(list_filter(needed, lambda w: list_contains(ws, w)))::BIGINT AS found, len(list_filter(needed, lambda w: list_contains(ws, w))) < 2 AS missing FROM c, q")
def x22_missing_conditions(spark: SparkSession, d: str) -> DataFrame:
    ws = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 4))
    needed = F.array(*map(F.lit, ["with", "from", "that", "this", "were"]))
    found = F.size(F.array_intersect(needed, F.col("ws")))
    return table(spark, d, "documents").select("doc_id", ws.alias("ws")).select("doc_id", found.cast("long").alias("found"), (found < 2).alias("missing"))


@query("SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'other' END AS actor, regexp_replace(source, '^src', 's') AS action, count(*) AS n FROM documents GROUP BY ALL")
def x21_rule_normalisers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "french").otherwise("other").alias("actor"), F.regexp_replace("source", "^src", "s").alias("action")).agg(F.count("*").alias("n"))
