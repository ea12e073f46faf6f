"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms (fixed values).
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalised(x: Column) -> Column:
    """Lower case without accents; runs of anything but letters and digits become one space."""
    plain = F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def trigrams(x: Column) -> Column:
    """The set of character trigrams; a shorter text is its own."""
    many = F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) < 3, F.array(x)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def any_of(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (x.contains(w) for w in words))


def how_many(x: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, (x.contains(w).cast("int") for w in words))


def price_number(x: Column) -> Column:
    """A price from text: null for words of asking; currency, blanks and thousands marks go; "million" and a final "k" multiply."""
    low = F.lower(F.trim(x))
    asked = low.rlike("demande|n[ée]gociable|contact|consulter|appel|[àa] voir")
    bare = F.regexp_replace(low, r"tnd|dt|[\s,]", "")
    number = F.regexp_extract(bare, r"\d+(\.\d+)?", 0).try_cast("double")
    return F.when(asked, None).otherwise(number * F.when(bare.contains("million"), 1e6).when(bare.rlike("k$"), 1e3).otherwise(1.0))


def decimal_comma_price(x: Column) -> Column:
    """The other reading of price text: a comma is a decimal sign, and any "k" multiplies."""
    low = F.regexp_replace(F.lower(F.trim(x)), ",", ".")
    number = F.regexp_extract(F.regexp_replace(low, r"\s", ""), r"\d+(\.\d+)?", 0).try_cast("double")
    return number * F.when(low.contains("k"), 1e3).otherwise(1.0)


def surface_number(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.lower(x), r"m2|m²", ""), r"\d+(\.\d+)?", 0).try_cast("double")


def rooms_number(x: Column) -> Column:
    """``S+N`` is N + 1 rooms; else the first number, if from 1 to 20."""
    plus = F.regexp_extract(F.lower(x), r"s\s*\+\s*(\d+)", 1).try_cast("int") + 1
    first = F.regexp_extract(x, r"\d+", 0).try_cast("int")
    return F.coalesce(plus, F.when(first.between(1, 20), first))


def without_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def slug(x: Column, most: int = 90) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def tokens(x: Column) -> Column:
    """Words of more than one character between anything but letters and digits, in lower case."""
    return F.filter(F.split(F.lower(x), r"[^a-z0-9àâäéèêëîïôöùûüçñóíáúß]+"), lambda w: F.length(w) > 1)


def cosine(a: str, b: str) -> Column:
    """Of two arrays, in double precision; null if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
