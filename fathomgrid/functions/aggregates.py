"""Aggregations that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a digit of ``exact_sum``, and the powers of two between which it is exact.
_DIGIT, _LOWEST, _HIGHEST = 32, -192, 352


def exact_sum(values: Column, lowest: int = _LOWEST, highest: int = _HIGHEST) -> Column:
    """AGG-16, AGG-17: the sum of finite doubles, rounded once, the same for any order and partition of the rows.

    Every value is cut into signed digits of 32 bits at fixed places (exactly: powers of two scale without rounding), the
    digits of a place are summed as whole numbers, with partial sums before any shuffle, and the places are carried and
    added at the end. So a group may be of any size up to 2^31 rows. Bits below 2^lowest are added as an ordinary sum;
    a value of 2^highest or more, infinite or NaN is an error. Nulls do not count; a group without values gives null.
    """
    places = list(range(highest - _DIGIT, lowest - 1, -_DIGIT))
    x = F.when(F.abs(values) < 2.0**highest, values).when(values.isNotNull(), F.raise_error(F.lit("a value that exact_sum cannot hold")).cast("double"))
    above = lambda k: F.rint(x / 2.0**k)
    digits = [F.sum((above(k) - (above(k + _DIGIT) * 2.0**_DIGIT if k < places[0] else 0.0)).cast("long")) for k in places]
    return _added(F.array(*digits), F.sum(x - above(places[-1]) * 2.0 ** places[-1]), places)


def _added(sums: Column, rest: Column, places: Sequence[int]) -> Column:
    """Digits' sums, highest place first, carried from the lowest and added from the highest."""
    base = 1 << _DIGIT
    low = lambda x: F.pmod(x + base // 2, F.lit(base)) - base // 2
    carried = F.aggregate(
        F.reverse(sums),
        F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<bigint>").alias("d")),
        lambda acc, x: F.struct(F.shiftright(x + acc["c"] - low(x + acc["c"]), _DIGIT).alias("c"), F.array_append(acc["d"], low(x + acc["c"])).alias("d")),
    )
    digits = F.concat(F.array(carried["c"]), F.reverse(carried["d"]))
    scaled = F.zip_with(digits, F.array(*[F.lit(2.0**k) for k in (places[0] + _DIGIT, *places)]), lambda d, p: d.cast("double") * p)
    return F.when(rest.isNotNull(), neumaier_of(F.array_append(scaled, rest)))


def neumaier_of(values: Column) -> Column:
    """The compensated sum of an array, in its order."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc, x):
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), acc["s"] - t + x).otherwise(x - t + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(values, start, add, lambda acc: acc["s"] + acc["c"])


def neumaier(values: Column) -> Column:
    """AGG-16: a compensated sum of a column in a group, the same for any order of rows.

    The values of a group are gathered and sorted, so this is for groups of a few summary rows; ``exact_sum`` is for any.
    """
    return neumaier_of(F.array_sort(F.collect_list(values)))


def running_totals(sums: DataFrame, value: str, weight: str) -> tuple[DataFrame, float]:
    """``sums`` (one row a value) with ``cum``, the weight of all values up to the row's, and the weight of all.

    Values are dealt to ranges at approximate quantiles; each range sums by itself, on top of the total of those before
    it (one row a range reaches the driver), so no task holds all values.
    """
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(sums.approxQuantile(value, [k / n for k in range(1, n)], 0.02))) if n > 1 else []
    ranged = sums.withColumn("__p", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0))
    totals = {r["__p"]: r["w"] for r in ranged.groupBy("__p").agg(F.sum(weight).alias("w")).collect()}
    before, seen = {}, 0
    for p in sorted(totals):
        before[p] = seen
        seen += totals[p]
    offset = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b))]), F.col("__p")) if before else F.lit(0)
    w = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("cum", offset + F.sum(weight).over(w)).drop("__p"), seen


def weighted_quantiles(rows: DataFrame, value: str, weight: str, shares: Sequence[float]) -> DataFrame:
    """AGG-21, WIN-9: (share, threshold): the least value whose cumulative weight reaches the share of all weight.

    Equal values count together, rows of no weight not at all; nothing is interpolated. Values are pre-aggregated.
    """
    sums = rows.where(F.col(weight) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    running, seen = running_totals(sums, "v", "w")
    least = running.agg(*[F.min(F.when(F.col("cum") >= s * seen, F.col("v"))).alias(f"q{k}") for k, s in enumerate(shares)])
    return least.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("threshold")) for k, s in enumerate(shares)])).alias("r")).select("r.*")


def average_ranks(rows: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """WIN-8: ranks from 1, ties sharing their mean. Ranks come from counts of distinct values, so ties cost nothing."""
    counts = rows.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    running, _ = running_totals(counts, "__v", "__n")
    ranked = running.select("__v", (F.col("cum") - (F.col("__n") - 1) / 2).alias(out))
    return rows.join(ranked, F.col(value) == F.col("__v")).drop("__v")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-28: (spearman, rows): correlation of tie-averaged ranks, null where either has no variance."""
    ranked = average_ranks(average_ranks(rows.select(a, b), a, "ra"), b, "rb")
    out = ranked.agg(F.covar_pop("ra", "rb").alias("c"), F.count(F.lit(1)).alias("rows"), (F.stddev_pop("ra") * F.stddev_pop("rb")).alias("s"))
    return out.select((F.col("c") / F.nullif("s", F.lit(0.0))).alias("spearman"), "rows")


def top_k(rows: DataFrame, measure: str, tie: str, k: int = 10) -> DataFrame:
    """SRT-6, SRT-7: the k largest, ties by id."""
    return rows.orderBy(F.desc(measure), F.asc(tie)).limit(k)
