"""The whole-period relation: successors across midnight, continuity, pairs and their rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import aggregates as A
from ..functions import scalars as S
from ..schemas import ALL_GROUPS

ORDER = ["at", "lat", "lon", "type_code", "grp", "seq"]
EXCLUSIONS = ["invalid_coordinate", "non_increasing_time", "group_change", "maximum_gap", "implied_speed"]


def with_date(rows: DataFrame, ts: str = "at") -> DataFrame:
    """FLT-14: the UTC date, derived and never a window key."""
    return rows.withColumn("utc_date", F.to_date(ts))


def successors(rows: DataFrame, key: str = "vessel", order: Sequence[str] = ORDER, carried: Sequence[str] = ("at", "lat", "lon", "grp", "sog")) -> DataFrame:
    """WIN-4, JN-2, STR-4: each row with its successor's columns as next_*; one window, so one sort, for all of them,
    and no boundary at midnight. Consecutive pairs need no self-join."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})


def continuity(rows: DataFrame, key: str = "vessel", order: Sequence[str] = ORDER) -> DataFrame:
    """WIN-5, AGG-13: pairs over the period, pairs that daily partitioning would lose, and the vessels they belong to."""
    dated = with_date(rows)
    whole, daily = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, "utc_date").orderBy(*order)
    both = dated.withColumn("n", F.lead("at").over(whole)).withColumn("d", F.lead("at").over(daily))
    lost = F.col("n").isNotNull() & F.col("d").isNull()
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count("n").alias("pairs"), F.count("d").alias("daily_pairs"), F.count_if(lost).alias("lost_pairs"), F.count_distinct(F.when(lost, F.col(key))).alias("vessels_crossing")
    )


def crossings(rows: DataFrame, key: str = "vessel", order: Sequence[str] = ORDER) -> DataFrame:
    """WIN-6: successors on another date, with elapsed microseconds."""
    s = with_date(successors(rows, key, order, ["at"]))
    return s.where(F.to_date("next_at") > F.col("utc_date")).select(key, "at", "next_at", (F.unix_micros("next_at") - F.unix_micros("at")).alias("elapsed_us"))


def time_gaps(rows: DataFrame, key: str = "vessel") -> DataFrame:
    """WIN-10: the median gap to the row before, for each vessel, in seconds."""
    w = Window.partitionBy(key).orderBy("at", "seq")
    gap = (F.unix_micros("at") - F.unix_micros(F.lag("at").over(w))) / 1e6
    return rows.withColumn("gap", gap).groupBy(key).agg(F.percentile("gap", 0.5).alias("median_gap_s"), F.count("gap").alias("gaps"))


def segments(rows: DataFrame, key: str = "vessel", order: Sequence[str] = ORDER) -> DataFrame:
    """Pairs with elapsed seconds, projected ends, length (SCL-8) and implied speed. A pair belongs to its start's
    group and date."""
    s = with_date(successors(rows, key, order)).where("next_at is not null")
    x0, y0 = S.project(F.col("lat"), F.col("lon"))
    x1, y1 = S.project(F.col("next_lat"), F.col("next_lon"))
    s = s.withColumns({"elapsed_s": (F.unix_micros("next_at") - F.unix_micros("at")) / 1e6, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
    s = s.withColumn("metres", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return s.withColumn("knots", F.when(F.col("elapsed_s") > 0, F.col("metres") / F.col("elapsed_s") * S.KNOTS_PER_MPS))


def exclusion(gap: Column, speed: Column, valid: Column | None = None) -> Column:
    """FLT-16: the first rule a pair breaks, null if none. ``valid``: whether its coordinates project."""
    ok = valid if valid is not None else S.finite(F.col("metres"))
    return (
        F.when(~ok, EXCLUSIONS[0])
        .when(F.col("elapsed_s") <= 0, EXCLUSIONS[1])
        .when(F.col("grp") != F.col("next_grp"), EXCLUSIONS[2])
        .when(F.col("elapsed_s") > gap, EXCLUSIONS[3])
        .when(F.col("knots") > speed, EXCLUSIONS[4])
    )


def structural(pairs: DataFrame) -> DataFrame:
    """FLT-17: pairs of one group whose time goes on."""
    return pairs.where((F.col("elapsed_s") > 0) & (F.col("grp") == F.col("next_grp")))


def rule_outcomes(pairs: DataFrame, gap: float, speed: float) -> DataFrame:
    """AGG-22 for one rule: (grp, outcome, pairs, km)."""
    named = pairs.withColumn("outcome", F.coalesce(exclusion(F.lit(gap), F.lit(speed)), F.lit("retained")))
    return named.groupBy("grp", "outcome").agg(F.count(F.lit(1)).alias("pairs"), (F.sum("metres") / 1000).alias("km"))


def rule_matrix(pairs: DataFrame, gaps: Sequence[float], speeds: Sequence[float], lengths: Sequence[float | None] = (None,)) -> DataFrame:
    """JN-13, AGG-22: every rule on every pair: a gap, a speed and a least length of vessel (None: any; a vessel of unknown length
    is shorter than any bound). The rules are a literal array, so each pair is expanded within its row and partially
    aggregated before the shuffle."""
    rules = F.array(*[F.struct(F.lit(float(g)).alias("gap"), F.lit(float(v)).alias("speed"), F.lit(m).cast("double").alias("least_length")) for g in gaps for v in speeds for m in lengths])
    each = pairs.withColumn("rule", F.explode(rules)).select("*", "rule.gap", "rule.speed", "rule.least_length")
    short = F.col("least_length").isNotNull() & ~F.coalesce(F.col("length_m") >= F.col("least_length"), F.lit(False)) if "length_m" in pairs.columns else F.lit(False)
    named = each.withColumn("outcome", F.coalesce(exclusion(F.col("gap"), F.col("speed")), F.when(short, "below_length"), F.lit("retained")))
    keys = ["gap", "speed", *(["least_length"] if tuple(lengths) != (None,) else []), "outcome"]
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("metres") == 0).alias("zero_length"),
        F.count_if(F.to_date("next_at") > F.col("utc_date")).alias("cross_midnight"),
        (F.sum("metres") / 1000).alias("km"),
    )


def grouped_sets(rows: DataFrame, key: str = "vessel") -> DataFrame:
    """AGG-7, AGG-23: (date, group), (date, all), (period, group) and (period, all) in one aggregation, with exact
    distinct vessels and vessel-dates."""
    dated = with_date(rows).select("utc_date", "grp", key)
    sets = dated.groupingSets([[F.col("utc_date"), F.col("grp")], [F.col("utc_date")], [F.col("grp")], []], "utc_date", "grp")
    out = sets.agg(F.grouping("utc_date").alias("any_date"), F.grouping("grp").alias("any_group"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("vessels"), F.count_distinct(key, "utc_date").alias("vessel_dates"))
    date = F.when(F.col("any_date") == 1, "period").otherwise(F.col("utc_date").cast("string"))
    group = F.when(F.col("any_group") == 1, ALL_GROUPS).otherwise(F.col("grp"))
    return out.select(date.alias("date_key"), group.alias("group_key"), "rows", "vessels", "vessel_dates")


def dense_sets(sets: DataFrame) -> DataFrame:
    """AGG-8: every date with every group, zero where there is nothing. The skeleton is (dates) x (groups)."""
    dates, groups = sets.select("date_key").distinct(), sets.select("group_key").distinct()
    full = dates.crossJoin(F.broadcast(groups))  # groups are the fixed few and their total
    return full.join(sets, ["date_key", "group_key"], "left").na.fill(0, ["rows", "vessels", "vessel_dates"])


def by_date(rows: DataFrame) -> DataFrame:
    """AGG-6."""
    return with_date(rows).groupBy("utc_date").agg(F.count(F.lit(1)).alias("rows"))


def by_hour(rows: DataFrame, key: str = "vessel") -> DataFrame:
    """AGG-9."""
    return with_date(rows).groupBy("utc_date", F.hour("at").alias("hour"), "grp").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("vessels"))


def band(x: Column, edges: Sequence[float]) -> Column:
    """A band's name: its lower edge, "below" and "unknown" for null."""
    out = F.when(x.isNull(), "unknown").when(x < edges[0], "below")
    for k in range(len(edges) - 1, -1, -1):
        out = out.when(x >= edges[k], F.lit(f"from_{edges[k]:g}"))
    return out


def by_band(rows: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """AGG-10: rows and vessels for each group and band."""
    return rows.groupBy("grp", band(F.col(column), edges).alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("vessel").alias("vessels"))


def strata(pairs: DataFrame, gap_edges: Sequence[float], speed_edges: Sequence[float]) -> DataFrame:
    """AGG-11: pairs by group, gap band and speed band, how often reported speeds agree, and pairs at a band's edge."""
    status, _ = S.endpoint_speed(F.col("sog"), F.col("next_sog"), F.col("knots"))
    at_edge = F.col("elapsed_s").isin(*[float(e) for e in gap_edges])
    return structural(pairs).groupBy("grp", band(F.col("elapsed_s"), gap_edges).alias("gap_band"), band(F.col("knots"), speed_edges).alias("speed_band")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(status == "available").alias("agree"), F.count_if(status == "unavailable").alias("unavailable"), F.count_if(at_edge).alias("at_edge")
    )


def censoring(pairs: DataFrame, gap: float, speed: float) -> DataFrame:
    """AGG-32: how many vessels have no retained pair, and how many lose their first or last."""
    w = Window.partitionBy("vessel").orderBy(*ORDER)
    back = Window.partitionBy("vessel").orderBy(*[F.desc(c) for c in ORDER])
    marked = pairs.withColumn("kept", exclusion(F.lit(gap), F.lit(speed)).isNull()).withColumn("r", F.row_number().over(w)).withColumn("b", F.row_number().over(back))
    each = marked.groupBy("vessel").agg(F.max("kept").alias("any"), F.max(F.when(F.col("r") == 1, F.col("kept"))).alias("first"), F.max(F.when(F.col("b") == 1, F.col("kept"))).alias("last"))
    return each.agg(F.count(F.lit(1)).alias("vessels"), F.count_if(~F.col("any")).alias("without"), F.count_if(~F.col("first")).alias("first_lost"), F.count_if(~F.col("last")).alias("last_lost"))


def transitions(pairs: DataFrame) -> DataFrame:
    """AGG-33: changes of group between a row and its successor."""
    changed = pairs.where(F.col("grp") != F.col("next_grp"))
    return changed.groupBy(F.concat_ws("_to_", "grp", "next_grp").alias("transition")).agg(F.count(F.lit(1)).alias("pairs"))


def histogram(rows: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """AGG-19: (by..., bin, rows) over fixed half-open bins, zero bins left out; see ``distribution`` for the scalars."""
    return rows.where(S.finite(F.col(column))).groupBy(*by, S.bin_index(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def distribution_rows(rows: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """AGG-19: (by..., count, minimum, maximum, sum, mean, bin_counts): exact scalars and a count for every fixed half-open bin,
    those below the first and from the last edge on included, zeros too. A value that is not finite is an error."""
    bad = F.col(column).isNotNull() & ~S.finite(F.col(column))
    x = F.when(bad, F.raise_error(F.lit("a value that is not finite"))).otherwise(F.col(column)).cast("double")
    some = rows.select(*by, x.alias("x"))
    bins = [F.count_if((F.col("x") >= lo if lo is not None else F.lit(True)) & (F.col("x") < hi if hi is not None else F.lit(True)) & F.col("x").isNotNull()) for lo, hi in zip([None, *edges], [*edges, None], strict=True)]
    out = some.groupBy(*by).agg(F.count("x").alias("count"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.coalesce(A.exact_sum(F.col("x")), F.lit(0.0)).alias("sum"), F.array(*bins).alias("bin_counts"))
    return out.withColumn("mean", F.col("sum") / F.nullif("count", F.lit(0)))


def distance_differences(pairs: DataFrame, by: Sequence[str], difference_edges: Sequence[float], relative_edges: Sequence[float]) -> DataFrame:
    """AGG-19: distributions of projected less geodesic metres (columns metres, geodesic_m), signed and absolute, and relative to
    the geodesic length; pairs without such a length have no relative difference (undefined)."""
    d = F.col("metres") - F.col("geodesic_m")
    rel = F.when(F.col("geodesic_m") != 0, d / F.col("geodesic_m"))
    rows = pairs.where(S.finite(F.col("metres")) & S.finite(F.col("geodesic_m"))).select(*by, d.alias("signed"), F.abs(d).alias("absolute"), rel.alias("signed_relative"), F.abs(rel).alias("absolute_relative"))
    parts = [distribution_rows(rows, c, difference_edges if k < 2 else relative_edges, by).withColumn("measure", F.lit(c)) for k, c in enumerate(("signed", "absolute", "signed_relative", "absolute_relative"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    undefined = rows.groupBy(*by).agg(F.count_if(F.col("signed_relative").isNull()).alias("undefined"))
    return out.join(undefined, list(by)) if by else out.crossJoin(undefined)


def evidence_faults(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """VAL-19: (by..., faults): what does not reconcile in a table of ``distance_differences``: bins against counts, scalars of
    empty and other distributions, and the counts of the four measures."""
    whole = F.aggregate("bin_counts", F.lit(0).cast("long"), lambda a, n: a + n) == F.col("count")
    scalars = F.when(F.col("count") == 0, F.col("minimum").isNull() & F.col("maximum").isNull() & F.col("mean").isNull()).otherwise(S.finite(F.col("minimum")) & S.finite(F.col("maximum")) & S.finite(F.col("mean")) & S.finite(F.col("sum")))
    n = lambda m: F.max(F.when(F.col("measure") == m, F.col("count")))
    pairs = (n("signed") == n("absolute")) & (n("signed_relative") == n("absolute_relative")) & (n("signed_relative") + F.max("undefined") == n("signed"))
    return table.groupBy(*by).agg((F.count_if(~whole) + F.count_if(~scalars) + F.when(F.coalesce(pairs, F.lit(False)), 0).otherwise(1)).cast("long").alias("faults"))


def distribution(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-20: count, least, largest, mean and linearly interpolated quartiles and 95th percentile."""
    q = F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    out = rows.where(S.finite(F.col(column))).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("least"), F.max(column).alias("largest"), F.avg(column).alias("mean"), q.alias("q"))
    return out.select(*by, "rows", "least", "largest", "mean", *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75", "p95"))])


def in_global_order(rows: DataFrame, order: Sequence[str] = ORDER, key: str = "vessel") -> DataFrame:
    """SRT-2: all rows in the one order of the period: time first, then the vessel and the keys that settle ties."""
    return rows.orderBy(order[0], key, *order[1:])


def ordered_batches(rows: DataFrame, size: int = 50_000, order: Sequence[str] = ORDER, key: str = "vessel") -> Iterator[pa.RecordBatch]:
    """STR-1: the rows in global order as Arrow batches of at most ``size``. One partition at a time reaches the driver, so its
    memory is bounded by a partition; for consumers that cannot be expressed as a query."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    ordered = in_global_order(rows, order, key)
    names = ordered.columns
    kind = to_arrow_schema(ordered.schema)
    held: list = []
    for row in ordered.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], kind)


def calendar(spark, first: str, last: str) -> DataFrame:
    """The dates of a period."""
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as utc_date")


def with_states(days: DataFrame, state: DataFrame) -> DataFrame:
    """JN-10: every date of the period, "absent" where there is no state."""
    return days.join(state, "utc_date", "left").withColumn("state", F.coalesce("state", F.lit("absent")))


def missing_dates(days: DataFrame, compatible: DataFrame) -> DataFrame:
    """JN-11, SET-1, VAL-18: dates of the period that no compatible day covers."""
    return days.select("utc_date").join(compatible.select("utc_date"), "utc_date", "left_anti")


def readiness(days: DataFrame, state: DataFrame) -> DataFrame:
    """VAL-18: (dates, ready, identity): how many dates of the period there are, whether all are verified, and an identity of the
    contents by date that depends on no path, clock or order."""
    both = days.join(state, "utc_date", "left")
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col("utc_date").cast("string"), F.coalesce("state", F.lit("absent")), F.coalesce("sha256", F.lit("")))))
    # one short text a date of the period
    return both.agg(F.count(F.lit(1)).alias("dates"), (F.count_if(F.coalesce(F.col("state") == "verified", F.lit(False))) == F.count(F.lit(1))).alias("ready"), F.sha2(F.array_join(parts, "|"), 256).alias("identity"))


def speed_balance(means: DataFrame, km: str = "km", rel: float = 1e-12) -> DataFrame:
    """VAL-9: rows of ``sog_means`` with a total (column ``km``), and whether the three categories add up to it."""
    parts = F.col("available_km") + F.col("unavailable_km") + F.col("inconsistent_km")
    return means.withColumn("conserved", F.abs(parts - F.col(km)) <= F.greatest(F.lit(1e-9), rel * F.col(km)))


def sog_means(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG-18, SCL-13, VAL-9: km by speed status, and distance-weighted means from sums, never means of means."""
    status, mean = S.endpoint_speed(F.col("sog"), F.col("next_sog"), F.col("knots"))
    rows = pieces.withColumn("status", status).withColumn("mean", mean)
    km = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("metres"))), F.lit(0.0)) / 1000
    known = F.sum(F.when(F.col("status") == "available", F.col("metres")))
    return rows.groupBy(*by).agg(
        km("available").alias("available_km"), km("unavailable").alias("unavailable_km"), km("inconsistent").alias("inconsistent_km"),
        (F.sum(F.col("metres") * F.col("mean")) / F.nullif(known, F.lit(0.0))).alias("reported_mean"),
        (F.sum(F.col("metres") * F.col("knots")) / F.nullif(F.sum("metres"), F.lit(0.0))).alias("implied_mean"),
    )
