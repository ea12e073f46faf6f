"""Statistics as Column expressions and DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def median(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(x: str | Column, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def share(condition: Column, digits: int = 4) -> Column:
    """The share of rows that meet a condition."""
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), digits)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by a polynomial of five terms, to 7 digits (coefficients are fixed values)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


NORMAL_CDF_SQL = "(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return NORMAL_CDF_SQL.format(z=z, tail=f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {poly})")


def iqr_keep(df: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """Rows inside the Tukey fence, and nulls; all rows where the spread is null or zero."""
    low, high = exact_quantiles(df, column, 0.25, 0.75)
    if low is None or low == high:
        return df
    return df.where(F.col(column).isNull() | F.col(column).between(low - factor * (high - low), high + factor * (high - low)))


def mann_kendall(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``(key, n, s, z, p, tau, trend)`` of each series: the sign of all pairs in order, with a continuity-corrected normal test.

    The number of points of a series is bounded by its periods; pairs are formed inside a series only, from its array of points, without a join.
    """
    points = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.greatest(F.size("v") - i - 1, F.lit(0))), lambda y: F.signum(y[value] - x[value]))))
    s = points.select(key, F.size("v").cast("long").alias("n"), F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x).cast("long").alias("s"))
    n = F.col("n")
    var = n * (n - 1) * (2 * n + 5) / 18.0
    z = F.when((n < 4) | (F.col("s") == 0), 0.0).otherwise((F.col("s") - F.signum(F.col("s"))) / F.sqrt(var))
    out = s.withColumn("z", z).withColumn("p", F.when(n < 4, 1.0).otherwise(2 * (1 - normal_cdf(F.abs("z")))))
    trend = F.when((n < 4) | (F.col("p") >= 0.05), "stable").when(F.col("s") > 0, "up").otherwise("down")
    return out.select(key, "n", "s", F.round("z", 4).alias("z"), F.round("p", 4).alias("p"), F.round(F.when(n > 1, 2.0 * F.col("s") / (n * (n - 1))).otherwise(0.0), 4).alias("tau"), trend.alias("trend"))


def place_among(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, by a binary search in one expression."""
    table, steps = F.array(*map(F.lit, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda s, k: F.when((s + k <= len(cuts)) & (F.try_element_at(table, s + k) <= x), s + k).otherwise(s)) if cuts else F.lit(0)


def running(df: DataFrame, by: str, *sums: str, pieces: int | None = None, cuts: list[float] | None = None, source: DataFrame | None = None) -> DataFrame:
    """``df`` (one row for each value of ``by``) with ``<sum>_upto`` for each of ``sums``: its total over the values up to the row's own.

    Values are dealt into ranges, at ``cuts`` or by approximate quantiles of ``df`` or of its ``source`` (the rows that it was counted from), ``pieces`` of them (four for each shuffle partition by
    default), so that no task sorts them all; a range's total, one row each, is then added to the ranges after it.
    """
    n = pieces or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(cuts)) if cuts is not None else sorted(set((df if source is None else source).select(F.percentile_approx(by, [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    dealt = df.withColumn("__range", place_among(F.col(by), cuts))
    per = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums))  # one row a range
    upto = Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.join(F.broadcast(before), "__range")
    return both.withColumns({f"{c}_upto": F.sum(c).over(upto) + F.col(f"__{c}") for c in sums}).drop("__range", *(f"__{c}" for c in sums))


def exact_quantiles(df: DataFrame, column: str, *shares: float, accuracy: int = 10_000) -> list[float | None]:
    """The exact quantiles (with interpolation) of a whole column, nulls left out; None for each if there are no values.

    An approximate pass finds edges that enclose each one; then the values between them are counted one by one, and all below and above as one each. So no
    task holds the column's values, as an exact percentile does.
    """
    known = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    slack, inf = 2 / accuracy, float("inf")
    n, edges = known.agg(F.count("*"), F.percentile_approx("x", [p for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))], accuracy)).first()
    out: list[float | None] = []
    for q, lo, hi in zip(shares, (edges or [])[::2], (edges or [])[1::2]):
        k = q * (n - 1)
        for low, high in ((lo, hi), (-inf, inf)):  # the second if the edges don't enclose it
            key = F.when(F.col("x") < low, -inf).when(F.col("x") > high, inf).otherwise(F.col("x"))
            at = running(known.groupBy(key.alias("x")).agg(F.count("*").alias("n")), "x", "n", cuts=[lo + (hi - lo) * i / 64 for i in range(65)])
            least = lambda rank: F.min(F.when(F.col("n_upto") > rank, F.col("x")))
            a, b = at.agg(least(math.floor(k)), least(math.ceil(k))).first()
            if abs(a) < inf and abs(b) < inf:
                break
        out.append(a + (b - a) * (k - math.floor(k)))
    return out or [None] * len(shares)


def ks_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``(d, n1, n2)``: the largest gap of two samples' distribution functions; counts are added up by value first."""
    both = a.select(F.col(column).alias("x"), F.lit(1).alias("one"), F.lit(0).alias("two")).unionAll(b.select(column, F.lit(0), F.lit(1))).where(F.col("x").isNotNull())
    steps = both.groupBy("x").agg(F.sum("one").alias("a"), F.sum("two").alias("b"))
    total = steps.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    run = running(steps, "x", "a", "b", source=both).select(F.col("a_upto").alias("ca"), F.col("b_upto").alias("cb")).crossJoin(F.broadcast(total))
    return run.groupBy("n1", "n2").agg(F.round(F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))), 6).alias("d")).select("d", "n1", "n2")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are equal, with the keys of ``left``."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, met, how).drop(*(f"__{k}" for k in keys))


def grouped_quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str | Column, float]], pieces: int = 64) -> DataFrame:
    """``(*by, *wanted)``: exact quantiles (with interpolation) of columns by group, nulls left out; null where a group has no values.

    No buffer and no task holds a group's values: equal values are counted together, approximate edges cut each group into ``pieces``, the counts of the pieces tell which of them hold the wanted ranks, and
    only those are put in order. A hot group is spread over its values for counting and over its pieces for ordering.
    """
    by, columns = list(by), {}
    for value, _ in wanted.values():
        columns.setdefault(value if isinstance(value, str) else value._jc.toString(), F.col(value) if isinstance(value, str) else value)
    place = {name: i for i, name in enumerate(columns)}
    which = {name: (place[v if isinstance(v, str) else v._jc.toString()], q) for name, (v, q) in wanted.items()}
    values = F.filter(F.array(*(F.struct(F.lit(i).alias("c"), x.cast("double").alias("x")) for i, x in enumerate(columns.values()))), lambda s: s["x"].isNotNull())
    long = df.select(*by, F.explode(values).alias("__v")).select(*by, F.col("__v.c").alias("__c"), F.col("__v.x").alias("__x"))
    keys = [*by, "__c"]
    counted = long.groupBy(*keys, "__x").agg(F.count("*").alias("__n"))
    edges = long.groupBy(*keys).agg(F.percentile_approx("__x", [i / pieces for i in range(1, pieces)], 8 * pieces).alias("__edges"), F.count("*").alias("__size"))
    # how many edges lie below a value: ranks stay in order whatever the edges are
    binned = matched(counted, edges, keys).select(*keys, "__x", "__n", "__size", F.size(F.filter("__edges", lambda e: e < F.col("__x"))).alias("__bin"))
    totals = binned.groupBy(*keys, "__bin", "__size").agg(F.sum("__n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = sorted(set(which.values()))
    rank = lambda q: q * (F.col("__size") - 1)
    holds = F.lit(False)
    for c, q in asked:
        for edge in (F.floor(rank(q)), F.ceil(rank(q))):
            holds = holds | ((F.col("__c") == c) & (edge >= F.col("__before")) & (edge < F.col("__before") + F.col("__sum")))
    held = totals.withColumn("__before", before).where(holds).select(*keys, "__bin", "__before")
    inside = matched(binned, held, [*keys, "__bin"])
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    least = lambda c, edge: F.min(F.when((F.col("__c") == c) & (F.col("__upto") > edge), F.col("__x")))
    picked = inside.withColumn("__upto", upto).groupBy(*by).agg(
        *(least(c, F.floor(rank(q))).alias(f"__lo{i}") for i, (c, q) in enumerate(asked)), *(least(c, F.ceil(rank(q))).alias(f"__hi{i}") for i, (c, q) in enumerate(asked)),
        *(F.max(F.when(F.col("__c") == c, rank(q) - F.floor(rank(q)))).alias(f"__part{i}") for i, (c, q) in enumerate(asked)),
    )
    mixed = lambda i: (1 - F.col(f"__part{i}")) * F.col(f"__lo{i}") + F.col(f"__part{i}") * F.col(f"__hi{i}")
    return picked.select(*by, *(mixed(asked.index(which[name])).alias(name) for name in wanted))


def narrow_quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000) -> DataFrame:
    """``(*by, *wanted)``: as ``grouped_quantiles``, for groups so few that a row for each can be broadcast, and none at all: two passes over ``df`` that shuffle next to nothing.

    An approximate pass finds a window of about 4 / ``accuracy`` of a group's rows around each wanted rank. The second counts the values inside the windows one by one, and what lies between windows as one each,
    by its least value. Where a wanted rank is neither inside nor such a least value, ``grouped_quantiles`` takes over.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    shares = sorted({q for _, q in wanted.values()})
    values = F.filter(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns))), lambda s: s["x"].isNotNull())
    if len(columns) > 1:
        long = df.select(*by, F.explode(values).alias("v")).select(*by, F.col("v.c").alias("__c"), F.col("v.x").alias("__x"))
    else:
        long = df.select(*by, F.lit(0).alias("__c"), F.col(columns[0]).cast("double").alias("__x")).where("__x is not null")
    keys, slack = [*by, "__c"], 2 / accuracy
    edges = stored(long.groupBy(*keys).agg(F.percentile_approx("__x", [p for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))], accuracy).alias("__edges")), "edges")
    met = matched(long, F.broadcast(edges), keys)
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(shares)):
        low, high = F.get("__edges", F.lit(2 * i)), F.get("__edges", F.lit(2 * i + 1))
        inside, gap = inside | F.col("__x").between(low, high), gap + (F.col("__x") > high).cast("int")
    kinds = met.select(*keys, "__x", inside.alias("__inside"), gap.alias("__gap"))
    # no value inside a window lies between two of one gap
    counted = kinds.groupBy(*keys, "__inside", F.when(F.col("__inside"), F.col("__x")).alias("__value"), F.when(~F.col("__inside"), F.col("__gap")).alias("__gap")).agg(F.count("*").alias("__n"), F.min("__x").alias("__at"))
    each = Window.partitionBy(*keys)
    ranked = stored(counted, "counts").withColumns({"__upto": F.sum("__n").over(each.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)), "__size": F.sum("__n").over(each)})

    def at(c: int, rank: Column) -> Column:
        here = F.struct(F.col("__at").alias("x"), (F.col("__inside") | (F.col("__upto") - F.col("__n") == rank)).alias("sure"))
        return F.min(F.when((F.col("__c") == c) & (F.col("__upto") > rank), here))

    found = ranked.groupBy(*by).agg(*(
        F.struct(at(columns.index(c), F.floor(k)).alias("lo"), at(columns.index(c), F.ceil(k)).alias("hi"), F.max(F.when(F.col("__c") == columns.index(c), k - F.floor(k))).alias("part")).alias(name)
        for name, (c, q) in wanted.items() for k in [q * (F.col("__size") - 1)]
    ))
    unsure = F.lit(False)
    for name in wanted:
        unsure = unsure | ~F.coalesce(F.col(f"{name}.lo.sure") & F.col(f"{name}.hi.sure"), F.lit(True))
    if found.where(unsure).limit(1).count():
        return grouped_quantiles(df, by, wanted)
    value = lambda n: F.when(F.col(f"{n}.part") == 0, F.col(f"{n}.lo.x")).otherwise((1 - F.col(f"{n}.part")) * F.col(f"{n}.lo.x") + F.col(f"{n}.part") * F.col(f"{n}.hi.x"))
    return found.select(*by, *(value(n).alias(n) for n in wanted))


def with_quantiles(df: DataFrame, by: Sequence[str], quantiles: dict[str, tuple[str, float]], *others: Column) -> DataFrame:
    """``(*by, *others, *quantiles)``: as ``summarised``, for few groups; one row if ``by`` is empty."""
    plain, found = df.groupBy(*by).agg(*others), narrow_quantiles(df, by, quantiles)
    return matched(plain, F.broadcast(found), by, "left") if by else plain.join(F.broadcast(found), how="left")


def summarised(df: DataFrame, by: Sequence[str], quantiles: dict[str, tuple[str | Column, float]], *others: Column) -> DataFrame:
    """``(*by, *others, *quantiles)``: ordinary aggregates of each group beside its exact quantiles."""
    return matched(df.groupBy(*by).agg(*(others or (F.count("*").alias("n"),))), grouped_quantiles(df, by, quantiles), by, "left")


def average_ranks(df: DataFrame, column: str, out: str, cuts: list[float] | None = None, salt: int = 16) -> DataFrame:
    """``df`` with ``out``: the rank of ``column`` over the whole table divided by the number of rows, ties at their average rank; rows with a null have none.

    Equal values are counted together, counts are summed range by range, and rows look their value's rank up by the value and a salt, so a frequent value's rows are dealt over ``salt`` tasks.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    total = per.agg(F.sum("__n").alias("__total"))
    upto = running(per, column, "__n", cuts=cuts, source=df)
    rank = (F.col("__n_upto") - F.col("__n") + 1 + (F.col("__n") - 1) / 2) / F.col("__total")
    ranks = upto.crossJoin(F.broadcast(total)).select(F.col(column).alias("__value"), rank.alias(out), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("__salt"))
    salted = df.withColumn("__own", F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int"))
    return salted.join(ranks, (F.col(column) == F.col("__value")) & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__value", "__salt")
