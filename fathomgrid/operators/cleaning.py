"""Cleaning of raw position rows with full accounting.

Every raw row is labelled once with the first check it fails, so one scan and one shuffle give both the survivors and
the counts of the funnel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import RAW_COLUMNS

#: The checks in order; a row's label is the first that it fails, "kept" if none.
REASONS = [
    "invalid_timestamp", "invalid_coordinate", "outside_extent", "invalid_mmsi", "invalid_speed",
    "missing_type", "malformed_type", "unavailable_type", "noncommercial_type", "exact_duplicate", "conflict",
]
EXTENT = (-122.0, -117.0, 30.0, 36.0)


def parsed(raw: DataFrame) -> DataFrame:
    """Typed columns beside the raw text ones."""
    return raw.withColumns(
        {
            "observed_at_utc": S.strict_timestamp(F.col("BaseDateTime")),
            "latitude": S.number(F.col("LAT")),
            "longitude": S.number(F.col("LON")),
            "p_sog": S.number(F.col("SOG")),
            "p_cog": S.number(F.col("COG")),
            "p_heading": S.number(F.col("Heading")),
            "p_type": S.integer(F.col("VesselType")),
            "p_length": S.number(F.col("Length")),
        }
    ).withColumn("type_state", S.type_state(F.col("VesselType"), F.col("p_type")))


def labelled(raw: DataFrame, extent: tuple[float, float, float, float] = EXTENT, columns: list[str] | None = None) -> DataFrame:
    """WIN-1..3, FLT-1..12: raw rows with typed columns and ``label``.

    Identical rows among those that pass all row checks: the first by source row is kept, the others are exact duplicates. Of the rows left
    that share identifier and time, none is kept. Both are windows over the row's own key, so hot vessels spread over
    their times; equality of whole rows is within the same (identifier, time) key, so one shuffle and one sort serve
    both. Rows that fail a check pass through the same windows, each under its own content.
    """
    columns = columns or RAW_COLUMNS
    rows = parsed(raw.withColumn("source_row", F.monotonically_increasing_id()))
    first = (
        F.when(F.col("observed_at_utc").isNull(), "invalid_timestamp")
        .when(~S.valid_coordinate(F.col("latitude"), F.col("longitude")), "invalid_coordinate")
        .when(~S.in_extent(F.col("latitude"), F.col("longitude"), extent), "outside_extent")
        .when(~S.valid_mmsi(F.col("MMSI")), "invalid_mmsi")
        .when(~S.valid_speed(F.col("p_sog")), "invalid_speed")
        .when(F.col("type_state") != "commercial", F.concat(F.col("type_state"), F.lit("_type")))
    )
    key = ["MMSI", "observed_at_utc", "salt"]
    # rows that failed a check have no partner to be found: their content spreads them, whatever their key
    checked = rows.withColumn("row_label", first).withColumn("salt", F.when(F.col("row_label").isNotNull(), F.xxhash64(*columns)))
    same = Window.partitionBy(*key, *[c for c in columns if c != "MMSI"]).orderBy("source_row")
    once = checked.repartition(*[F.col(k) for k in key]).withColumn("copy", F.row_number().over(same))
    of_key = F.count_if(F.col("copy") == 1).over(Window.partitionBy(*key))
    label = F.coalesce("row_label", F.when(F.col("copy") > 1, "exact_duplicate").when(F.col("of_key") > 1, "conflict").otherwise("kept"))
    return once.withColumn("of_key", of_key).withColumn("label", label).drop("copy", "of_key", "row_label", "salt", "source_row")


def cleaned(marked: DataFrame) -> DataFrame:
    """The kept rows in the cleaned schema: sentinels and out-of-range optional measures are null."""
    return marked.where("label = 'kept'").select(
        F.col("MMSI").alias("mmsi"),
        "observed_at_utc",
        "latitude",
        "longitude",
        F.when(F.col("p_sog") != 102.3, F.col("p_sog")).alias("sog_knots"),
        S.optional_measure(F.col("p_cog"), 360.0, 0.0, 360.0).alias("cog_degrees"),
        S.optional_measure(F.col("p_heading"), 511.0, 0.0, 359.0).alias("heading_degrees"),
        F.col("p_type").cast("smallint").alias("vessel_type_code"),
        S.vessel_group(F.col("p_type")).alias("vessel_type_group"),
        S.optional_measure(F.col("p_length"), None, 0.0, None).alias("length_m"),
    )


def in_clean_order(rows: DataFrame) -> DataFrame:
    """SRT-1."""
    return rows.orderBy("observed_at_utc", "mmsi", "latitude", "longitude", "vessel_type_code")


def removal_counts(marked: DataFrame) -> DataFrame:
    """AGG-2, AGG-3: (label, rows), every reason present, zero where nothing was removed, and kept."""
    spark = marked.sparkSession
    all_labels = spark.createDataFrame([(r,) for r in [*REASONS, "kept"]], "label string")
    counts = marked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return all_labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("rows"))


def stage_counts(marked: DataFrame) -> DataFrame:
    """The funnel: rows left after each check, in one pass."""
    left = lambda k: F.count_if(~F.col("label").isin(*REASONS[:k]))
    return marked.agg(
        F.count(F.lit(1)).alias("source_rows"), left(1).alias("after_timestamp"), left(2).alias("after_coordinates"), left(3).alias("after_extent"), left(4).alias("after_mmsi"),
        left(5).alias("after_speed"), left(8).alias("after_type"), left(9).alias("after_commercial"), left(10).alias("after_exact"), left(11).alias("final_rows"),
    )


def assert_conserved(marked: DataFrame) -> None:
    """VAL-1: removals add up to source less final rows."""
    s = stage_counts(marked).first().asDict()
    removed = sum(r["rows"] for r in removal_counts(marked).collect() if r["label"] != "kept")
    if removed != s["source_rows"] - s["final_rows"]:
        raise ValueError(f"{removed} rows removed of {s['source_rows']}, but {s['final_rows']} are left")


def normalisation_counts(marked: DataFrame) -> DataFrame:
    """AGG-4: on kept rows, how many values each normalisation made null. A course or heading that is blank or no number
    counts as out of range, as it is no valid measure either; a sentinel counts as a sentinel alone."""
    k = marked.where("label = 'kept'")
    valid = lambda c, low, high: F.coalesce(S.finite(F.col(c)) & F.col(c).between(low, high), F.lit(False))
    sentinel = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return k.agg(
        F.count_if(F.col("p_sog") == 102.3).alias("sog_sentinel"),
        F.count_if(F.col("p_cog") == 360.0).alias("cog_sentinel"),
        F.count_if(F.col("p_heading") == 511.0).alias("heading_sentinel"),
        F.count_if(~sentinel("p_cog", 360.0) & ~valid("p_cog", 0.0, 360.0)).alias("cog_out_of_range"),
        F.count_if(~sentinel("p_heading", 511.0) & ~valid("p_heading", 0.0, 359.0)).alias("heading_out_of_range"),
        F.count_if(F.col("p_length").isNull() | (F.col("p_length") < 0)).alias("length_unavailable"),
    )


def profile(raw: DataFrame, extent: tuple[float, float, float, float] = EXTENT) -> DataFrame:
    """AGG-1: one total and the counts of each check taken by itself, in one pass."""
    p = parsed(raw)
    return p.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("observed_at_utc").isNull()).alias("invalid_timestamp"),
        F.count_if(~S.valid_coordinate(F.col("latitude"), F.col("longitude"))).alias("invalid_coordinate"),
        F.count_if(S.valid_coordinate(F.col("latitude"), F.col("longitude")) & ~S.in_extent(F.col("latitude"), F.col("longitude"), extent)).alias("outside_extent"),
        F.count_if(~S.valid_mmsi(F.col("MMSI"))).alias("invalid_mmsi"),
        F.count_if(~S.valid_speed(F.col("p_sog"))).alias("invalid_speed"),
        *[F.count_if(F.col("type_state") == t).alias(f"{t}_type") for t in ("missing", "malformed", "unavailable", "noncommercial", "commercial")],
        F.count_if(F.col("p_sog") == 102.3).alias("sog_sentinel"),
        F.count_if(F.col("p_cog") == 360.0).alias("cog_sentinel"),
        F.count_if(F.col("p_heading") == 511.0).alias("heading_sentinel"),
    )


def coverage(rows: DataFrame, ts: str = "observed_at_utc") -> DataFrame:
    """AGG-12: first and last times and days, and how many days."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count_distinct(F.to_date(ts)).alias("days"))


def by_type(rows: DataFrame, type_col: str, id_col: str, speed_col: str) -> DataFrame:
    """AGG-5: rows, distinct vessels, known speeds and their mean for each type code, nulls last."""
    out = rows.groupBy(type_col).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("vessels"), F.count(speed_col).alias("speeds"), F.avg(speed_col).alias("mean_speed"))
    return out.orderBy(F.asc_nulls_last(type_col))


def duplicate_profile(raw: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """AGG-36: rows, distinct rows, keys, keys held by several rows, and nulls of each key column."""
    same = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    keys = same.groupBy(*key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contents"))
    return keys.agg(
        F.sum("rows").alias("rows"), F.sum("contents").alias("distinct_rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("rows") > 1).alias("repeated_keys"), F.count_if(F.col("contents") > 1).alias("conflicting_keys"),
        *[F.sum(F.when(F.col(c).isNull(), F.col("rows")).otherwise(0)).alias(f"null_{c}") for c in key],
    )
