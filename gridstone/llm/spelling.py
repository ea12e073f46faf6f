"""Spelling variants by anagram hashing.

A word's key is the sum over its letters of a power of the letter's code, so anagrams share it and one letter more, fewer or other changes it by a known value.
For each of its different letters a word has a *reduced* key, its own less that letter's value. Words that differ by an added or removed letter meet where one's reduced key
is the other's own key; words that differ by a replaced letter meet where their reduced keys are equal. Anagrams meet there too, so pairs are verified by the order of their letters.

Two words that differ at one place agree before the middle or behind it. Keys are therefore joined together with the half that agrees, which leaves
anagrams that differ all over out of the join, and keeps the words of a frequent key apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POWER = 5
#: Keys are sums modulo this prime, so that no word is too long for 64 bits; differences keep their meaning, and pairs are verified.
MODULUS = (1 << 61) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "([A-Za-z\\u00C0-\\u00FF]+)"


def words(docs: DataFrame, every: int = 97, least_letters: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: lower-cased runs of letters of whole texts, from which rule ``every`` deletes a letter of some, that have ``least_letters`` and occur ``least`` times.

    With h the CRC-32 of ``<id>:<run>``, a run loses the letter at h modulo its length if ``every`` divides h. A null text has no runs; a null id counts as an empty string.
    Runs too short to give a word are left out before the shuffle, and counts are combined before it, so a frequent word is one row a task.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUNS), 1)).alias("run"))
    runs = runs.where(F.length("run") >= least_letters).withColumn("run", F.translate("run", UPPER, LOWER))
    h, size = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.length("run")
    at = F.pmod(h, size.cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    word = F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def _keyed(vocabulary: DataFrame) -> DataFrame:
    letters = F.split("word", "")
    letters = F.filter(letters, lambda x: x != "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: F.pmod(a + _value(x), F.lit(MODULUS)))
    return vocabulary.select("word", "n", F.array_distinct(letters).alias("letters"), key.alias("key"), F.length("word").alias("size"))


def _meeting(kind: int, key: Column, size: Column, *halves: Column) -> Column:
    """One number for a key, a length and each half of a word: what a near word shares one of. (Equal numbers of unlike things only add candidates.)"""
    return F.explode(F.array(*(F.xxhash64(F.lit(2 * kind + i), key, size, half) for i, half in enumerate(halves))))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(a, b, b_n)``, both ways: different words of ``(word, n)`` that differ by exactly one added, removed or replaced letter.

    A word of L letters (d of them different) has 2 d reduced keys for either join, and 2 own ones. Words meet only in equi-joins on key, length and half; what meets is verified by Levenshtein distance.
    """
    keyed = _keyed(vocabulary)
    word, size = F.col("word"), F.col("size")
    before = lambda cut: F.substring(word, F.lit(1), cut)
    behind = lambda cut: F.substring(word, cut + 1, size)
    reduced = keyed.select("word", "n", "size", "key", F.explode("letters").alias("letter")).withColumn("key", F.pmod(F.col("key") - _value(F.col("letter")), F.lit(MODULUS)))
    # one letter replaced: both words lack it, and agree before or behind the middle; anagrams lack the same one
    middle = (size / 2).cast("int")
    parts = reduced.select("word", "n", F.ascii("letter").alias("letter"), _meeting(0, F.col("key"), size, before(middle), behind(middle)).alias("met"))
    one, two = parts.alias("one"), parts.alias("two")
    replaced = one.join(two, F.col("one.met") == F.col("two.met")).where("one.letter < two.letter").select(F.col("one.word").alias("a"), F.col("one.n").alias("n"), F.col("two.word").alias("b"), F.col("two.n").alias("b_n"))
    # one letter removed from the longer word: its reduced key is the shorter one's key; the shorter word's middle cuts both
    cut = ((size - 1) / 2).cast("int")
    longer = reduced.select(word.alias("a"), "n", _meeting(1, F.col("key"), size - 1, before(cut), behind(cut + 1)).alias("met"))
    shorter = keyed.select(word.alias("b"), F.col("n").alias("b_n"), _meeting(1, F.col("key"), size, before(middle), behind(middle)).alias("met"))
    removed = longer.join(shorter, "met").select("a", "n", "b", "b_n")
    pairs = replaced.union(removed).where(F.levenshtein("a", "b", 1) == 1).distinct()
    sides = F.array(F.struct("a", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("b_n")))
    return pairs.select(F.explode(sides).alias("pair")).select("pair.*")


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``(word, n)`` with each word once.

    A word's form is its most frequent near word (ties: the smaller in code-point order), if that is at least ``ratio`` times as frequent; else null. Its root is where forms lead to: counts
    at least double at each step, so there are no circles, and the number of steps is at most the logarithm of the largest count; roots double their reach in each round.
    An empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms need at least twice the count, or they might lead in circles")
    vocabulary = written(vocabulary, "spelling-words")
    best = F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("word")))
    near = near_pairs(vocabulary).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    table = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("best.rank"))
    enough = F.col("form_n") >= ratio * F.col("n")
    table = written(table.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "spelling-forms")
    links = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
