"""Registered queries over the supplied tables, and their DuckDB SQL.

Names begin with the operators they apply. Floats are rounded to few digits on both sides.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import allocate, cleaning, exposure, period
from ..operators import contracts as C
from ..operators import delivery
from ..sources import readers, sinks
from ..streaming import ingest
from . import standins as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Queries that return dates; both sides give them as text.
DATED = {"period_states", "missing_dates", "ingest_upsert", "ingest_failures", "ingest_to_do", "rows_by_date", "rows_by_hour"}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def put(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, sf_dir: f(spark, sf_dir).withColumn("utc_date", F.col("utc_date").cast("string"))) if name in DATED else f
        if sql is not None:
            text = re.sub(r"(?<![\w\"'])at(?![\w\"'(])", '"at"', sql)  # a keyword there
            ORACLES[name] = f"SELECT * REPLACE (CAST(utc_date AS VARCHAR) AS utc_date) FROM ({text})" if name in DATED else text
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pairs(spark, sf_dir):
    return period.segments(I.observations(spark, sf_dir))


_EXCL = """CASE WHEN metres IS NULL OR NOT isfinite(metres) THEN 'invalid_coordinate' WHEN elapsed_s <= 0 THEN 'non_increasing_time' WHEN grp <> next_grp THEN 'group_change'
     WHEN elapsed_s > {gap} THEN 'maximum_gap' WHEN knots > {speed} THEN 'implied_speed' ELSE 'retained' END"""
GAP, SPEED = 43_200.0, 30.0


@query(f"SELECT grp, {_EXCL.format(gap=GAP, speed=SPEED)} AS outcome, count(*) AS pairs, round(sum(metres) / 1000, 4) AS km FROM ({I.PAIRS_DUCK}) GROUP BY 1, 2")
def segment_rules(spark, sf_dir):
    """WIN-4, JN-2, FLT-16, SCL-8, SCL-10, AGG-14: how many consecutive pairs of each group a gap and a speed rule keep or
    exclude, why, and over how many kilometres."""
    return rounded(period.rule_outcomes(pairs(spark, sf_dir), GAP, SPEED))


# --- cleaning ----------------------------------------------------------------------------------------------------------

_NUM = r"'\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*'"
_PARSED = f"""
    SELECT *, CASE WHEN regexp_full_match(BaseDateTime, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN try_strptime(BaseDateTime, '%Y-%m-%dT%H:%M:%S') END AS at,
           {", ".join(f"CASE WHEN regexp_full_match({c}, {_NUM}) THEN try_cast({c} AS DOUBLE) END AS {n}" for c, n in (("LAT", "la"), ("LON", "lo"), ("SOG", "sg"), ("COG", "cg"), ("Heading", "hd"), ("Length", "len")))},
           CASE WHEN regexp_full_match(trim(VesselType), '[0-9]+') THEN try_cast(trim(VesselType) AS INTEGER) END AS vt
    FROM ({I.RAW_DUCK})"""
_LABEL = f"""
    SELECT *, CASE WHEN at IS NULL THEN 'invalid_timestamp' WHEN NOT coalesce(isfinite(la) AND isfinite(lo) AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false) THEN 'invalid_coordinate'
        WHEN NOT (lo BETWEEN -122 AND -117 AND la BETWEEN 30 AND 36) THEN 'outside_extent' WHEN NOT coalesce(regexp_full_match(MMSI, '[1-9][0-9]{{8}}'), false) THEN 'invalid_mmsi'
        WHEN NOT coalesce(sg = 102.3 OR (isfinite(sg) AND sg >= 0), false) THEN 'invalid_speed' WHEN VesselType IS NULL OR trim(VesselType) = '' THEN 'missing_type'
        WHEN NOT regexp_full_match(trim(VesselType), '[0-9]+') THEN 'malformed_type' WHEN vt = 0 THEN 'unavailable_type' WHEN vt IS NULL OR vt NOT BETWEEN 1 AND 99 THEN 'malformed_type'
        WHEN vt NOT BETWEEN 60 AND 89 THEN 'noncommercial_type' END AS bad FROM ({_PARSED})"""
_COLUMNS = "MMSI, BaseDateTime, LAT, LON, SOG, COG, Heading, VesselName, IMO, CallSign, VesselType, Status, Length, Width, Draft, Cargo, TransceiverClass"
_FINAL = f"""
    SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN copy > 1 THEN 'exact_duplicate' WHEN sum(CASE WHEN copy = 1 AND bad IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY MMSI, at, bad IS NULL) > 1 THEN 'conflict' ELSE 'kept' END AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY bad IS NULL, {_COLUMNS}) AS copy FROM ({_LABEL}))"""


@query(f"SELECT l.label, count(f.label) AS rows FROM (SELECT unnest({[*cleaning.REASONS, 'kept']}) AS label) l LEFT JOIN ({_FINAL}) f ON l.label = f.label GROUP BY 1")
def cleaning_removals(spark, sf_dir):
    """FLT-1..9, WIN-2, WIN-3, AGG-2, AGG-3: rows removed by each check."""
    return cleaning.removal_counts(cleaning.labelled(I.raw(spark, sf_dir)))


@query(
    f"SELECT MMSI AS mmsi, epoch_us(at) AS at_us, la AS latitude, lo AS longitude, CASE WHEN sg <> 102.3 THEN sg END AS sog_knots, CASE WHEN cg <> 360 AND cg BETWEEN 0 AND 360 THEN cg END AS cog_degrees, "
    f"CASE WHEN hd <> 511 AND hd BETWEEN 0 AND 359 THEN hd END AS heading_degrees, CAST(vt AS SMALLINT) AS vessel_type_code, CASE WHEN vt < 70 THEN 'passenger' WHEN vt < 80 THEN 'cargo' ELSE 'tanker' END AS vessel_type_group, "
    f"CASE WHEN len >= 0 THEN len END AS length_m FROM ({_FINAL}) WHERE label = 'kept'"
)
def cleaning_rows(spark, sf_dir):
    """FLT-10..12: the cleaned rows."""
    out = cleaning.cleaned(cleaning.labelled(I.raw(spark, sf_dir)))
    return out.select("mmsi", F.unix_micros("observed_at_utc").alias("at_us"), *out.columns[2:])


_LEFT = lambda k: f"count(*) FILTER (label NOT IN ({', '.join(repr(r) for r in cleaning.REASONS[:k])}))"


@query(
    f"SELECT count(*) AS source_rows, {_LEFT(1)} AS after_timestamp, {_LEFT(2)} AS after_coordinates, {_LEFT(3)} AS after_extent, {_LEFT(4)} AS after_mmsi, {_LEFT(5)} AS after_speed, {_LEFT(8)} AS after_type, "
    f"{_LEFT(9)} AS after_commercial, {_LEFT(10)} AS after_exact, {_LEFT(11)} AS final_rows FROM ({_FINAL})"
)
def cleaning_funnel(spark, sf_dir):
    """AGG-2: rows left after each stage."""
    return cleaning.stage_counts(cleaning.labelled(I.raw(spark, sf_dir)))


@query(
    f"SELECT count(*) FILTER (sg = 102.3) AS sog_sentinel, count(*) FILTER (cg = 360) AS cog_sentinel, count(*) FILTER (hd = 511) AS heading_sentinel, count(*) FILTER (trim(COG) = '' OR cg IS NULL OR cg < 0 OR cg > 360) AS cog_out_of_range, "
    f"count(*) FILTER (trim(Heading) = '' OR hd IS NULL OR hd < 0 OR (hd > 359 AND hd <> 511)) AS heading_out_of_range, count(*) FILTER (len IS NULL OR len < 0) AS length_unavailable FROM ({_FINAL}) WHERE label = 'kept'"
)
def cleaning_normalisations(spark, sf_dir):
    """AGG-4."""
    return cleaning.normalisation_counts(cleaning.labelled(I.raw(spark, sf_dir)))


_COORD = "coalesce(isfinite(la) AND isfinite(lo) AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false)"


@query(f"""SELECT count(*) AS rows, count(*) FILTER (at IS NULL) AS invalid_timestamp, count(*) FILTER (NOT {_COORD}) AS invalid_coordinate, count(*) FILTER ({_COORD} AND NOT (lo BETWEEN -122 AND -117 AND la BETWEEN 30 AND 36)) AS outside_extent,
    count(*) FILTER (NOT regexp_full_match(MMSI, '[1-9][0-9]{{8}}')) AS invalid_mmsi, count(*) FILTER (NOT coalesce(sg = 102.3 OR (isfinite(sg) AND sg >= 0), false)) AS invalid_speed,
    count(*) FILTER (t = 'missing') AS missing_type, count(*) FILTER (t = 'malformed') AS malformed_type, count(*) FILTER (t = 'unavailable') AS unavailable_type, count(*) FILTER (t = 'noncommercial') AS noncommercial_type,
    count(*) FILTER (t = 'commercial') AS commercial_type, count(*) FILTER (sg = 102.3) AS sog_sentinel, count(*) FILTER (cg = 360) AS cog_sentinel, count(*) FILTER (hd = 511) AS heading_sentinel
    FROM (SELECT *, CASE WHEN trim(VesselType) = '' THEN 'missing' WHEN NOT regexp_full_match(trim(VesselType), '[0-9]+') THEN 'malformed' WHEN vt = 0 THEN 'unavailable' WHEN vt NOT BETWEEN 1 AND 99 THEN 'malformed'
          WHEN vt NOT BETWEEN 60 AND 89 THEN 'noncommercial' ELSE 'commercial' END AS t FROM ({_PARSED}))""")
def raw_profile(spark, sf_dir):
    """AGG-1: each check by itself, in one scan."""
    return cleaning.profile(I.raw(spark, sf_dir))


@query(f"SELECT count(*) AS rows, epoch_us(min(at)) AS first_us, epoch_us(max(at)) AS last_us, count(DISTINCT CAST(at AS DATE)) AS days FROM ({I.OBS_DUCK})")
def temporal_coverage(spark, sf_dir):
    """AGG-12."""
    c = cleaning.coverage(I.observations(spark, sf_dir), "at")
    return c.select("rows", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "days")


@query(f"SELECT type_code, count(*) AS rows, count(DISTINCT vessel) AS vessels, count(sog) AS speeds, round(avg(sog), 4) AS mean_speed FROM ({I.OBS_DUCK}) GROUP BY 1")
def group_by_type(spark, sf_dir):
    """AGG-5, VAL-21."""
    return rounded(cleaning.by_type(I.observations(spark, sf_dir), "type_code", "vessel", "sog"))


@query(f"""WITH s AS (SELECT MMSI, BaseDateTime, {_COLUMNS.replace("MMSI, BaseDateTime, ", "")}, count(*) AS n FROM ({I.RAW_DUCK}) GROUP BY ALL), k AS (SELECT MMSI, BaseDateTime, sum(n) AS rows, count(*) AS contents FROM s GROUP BY 1, 2)
    SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(contents) AS BIGINT) AS distinct_rows, count(*) AS keys, count(*) FILTER (rows > 1) AS repeated_keys, count(*) FILTER (contents > 1) AS conflicting_keys,
    CAST(sum(CASE WHEN MMSI IS NULL THEN rows ELSE 0 END) AS BIGINT) AS "null_MMSI", CAST(sum(CASE WHEN BaseDateTime IS NULL THEN rows ELSE 0 END) AS BIGINT) AS "null_BaseDateTime" FROM k""")
def duplicate_profile(spark, sf_dir):
    """AGG-36."""
    return cleaning.duplicate_profile(I.raw(spark, sf_dir), _COLUMNS.split(", "), ["MMSI", "BaseDateTime"])


# --- period ------------------------------------------------------------------------------------------------------------


@query(f"SELECT seq, epoch_us(next_at) AS next_us, next_lat, next_grp, epoch_us(next_at) - epoch_us(at) AS elapsed_us FROM ({I.PAIRS_DUCK})")
def successor_pairs(spark, sf_dir):
    """WIN-4, WIN-7, STR-4, SCL-6: every row with its successor, across midnight."""
    return pairs(spark, sf_dir).select("seq", F.unix_micros("next_at").alias("next_us"), "next_lat", "next_grp", (F.unix_micros("next_at") - F.unix_micros("at")).alias("elapsed_us"))


@query(f"""SELECT count(*) AS rows, count(n) AS pairs, count(d) AS daily_pairs, count(*) FILTER (n IS NOT NULL AND d IS NULL) AS lost_pairs, count(DISTINCT CASE WHEN n IS NOT NULL AND d IS NULL THEN vessel END) AS vessels_crossing
    FROM (SELECT *, lead(at) OVER (PARTITION BY vessel ORDER BY {I._ORDER}) AS n, lead(at) OVER (PARTITION BY vessel, CAST(at AS DATE) ORDER BY {I._ORDER}) AS d FROM ({I.OBS_DUCK}))""")
def continuity(spark, sf_dir):
    """WIN-5, AGG-13."""
    return period.continuity(I.observations(spark, sf_dir))


@query(f"SELECT vessel, epoch_us(at) AS at_us, epoch_us(next_at) AS next_us, epoch_us(next_at) - epoch_us(at) AS elapsed_us FROM ({I.PAIRS_DUCK}) WHERE CAST(next_at AS DATE) > utc_date")
def midnight_crossings(spark, sf_dir):
    """WIN-6, FLT-14."""
    return period.crossings(I.observations(spark, sf_dir)).select("vessel", F.unix_micros("at").alias("at_us"), F.unix_micros("next_at").alias("next_us"), "elapsed_us")


@query(f"SELECT vessel, round(quantile_cont(gap, 0.5), 4) AS median_gap_s, count(gap) AS gaps FROM (SELECT vessel, (epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY vessel ORDER BY at, seq))) / 1e6 AS gap FROM ({I.OBS_DUCK})) GROUP BY 1")
def median_gaps(spark, sf_dir):
    """WIN-10."""
    return rounded(period.time_gaps(I.observations(spark, sf_dir)))


_SETS = f"""SELECT coalesce(CASE WHEN grouping(d) = 1 THEN 'period' ELSE CAST(d AS VARCHAR) END) AS date_key, CASE WHEN grouping(grp) = 1 THEN 'all_commercial' ELSE grp END AS group_key, count(*) AS rows,
    count(DISTINCT vessel) AS vessels, count(DISTINCT (vessel, d)) AS vessel_dates FROM (SELECT *, CAST(at AS DATE) AS d FROM ({I.OBS_DUCK})) GROUP BY GROUPING SETS ((d, grp), (d), (grp), ())"""


@query(_SETS)
def grouping_sets(spark, sf_dir):
    """AGG-7, AGG-23, SET-4."""
    return period.grouped_sets(I.observations(spark, sf_dir))


@query(f"WITH s AS ({_SETS}) SELECT d.date_key, g.group_key, coalesce(rows, 0) AS rows, coalesce(vessels, 0) AS vessels, coalesce(vessel_dates, 0) AS vessel_dates FROM (SELECT DISTINCT date_key FROM s) d CROSS JOIN (SELECT DISTINCT group_key FROM s) g LEFT JOIN s ON s.date_key = d.date_key AND s.group_key = g.group_key")
def grouping_sets_dense(spark, sf_dir):
    """AGG-8."""
    return period.dense_sets(period.grouped_sets(I.observations(spark, sf_dir)))


@query(f"SELECT CAST(at AS DATE) AS utc_date, count(*) AS rows FROM ({I.OBS_DUCK}) GROUP BY 1")
def rows_by_date(spark, sf_dir):
    """AGG-6."""
    return period.by_date(I.observations(spark, sf_dir))


@query(f"SELECT CAST(at AS DATE) AS utc_date, CAST(hour(at) AS INT) AS hour, grp, count(*) AS rows, count(DISTINCT vessel) AS vessels FROM ({I.OBS_DUCK}) GROUP BY 1, 2, 3")
def rows_by_hour(spark, sf_dir):
    """AGG-9."""
    return period.by_hour(I.observations(spark, sf_dir))


_LEN = [50.0, 100.0, 200.0, 300.0]
_GAPS, _SPEEDS = [3600.0, 21600.0, 86400.0], [5.0, 30.0, 100.0]


def _band(x, edges):
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < {edges[0]} THEN 'below' " + " ".join(f"WHEN {x} >= {e} THEN 'from_{e:g}'" for e in reversed(edges)) + " END"


@query(f"SELECT grp, {_band('length_m', _LEN)} AS band, count(*) AS rows, count(DISTINCT vessel) AS vessels FROM ({I.OBS_DUCK}) GROUP BY 1, 2")
def length_bands(spark, sf_dir):
    """AGG-10."""
    return period.by_band(I.observations(spark, sf_dir), "length_m", _LEN)


_STATUS = "CASE WHEN sog IS NULL OR next_sog IS NULL OR sog = 102.3 OR next_sog = 102.3 THEN 'unavailable' WHEN abs((sog + next_sog) / 2 - knots) > 5 THEN 'inconsistent' ELSE 'available' END"


@query(f"""SELECT grp, {_band("elapsed_s", _GAPS)} AS gap_band, {_band("knots", _SPEEDS)} AS speed_band, count(*) AS pairs, count(*) FILTER ({_STATUS} = 'available') AS agree, count(*) FILTER ({_STATUS} = 'unavailable') AS unavailable,
    count(*) FILTER (elapsed_s IN (3600, 21600, 86400)) AS at_edge FROM ({I.PAIRS_DUCK}) WHERE elapsed_s > 0 AND grp = next_grp GROUP BY 1, 2, 3""")
def segment_strata(spark, sf_dir):
    """AGG-11, FLT-17, SCL-13."""
    return period.strata(pairs(spark, sf_dir), _GAPS, _SPEEDS)


@query(
    " UNION ALL ".join(
        f"SELECT CAST({g} AS DOUBLE) AS gap, CAST({v} AS DOUBLE) AS speed, {_EXCL.format(gap=g, speed=v)} AS outcome, count(*) AS pairs, count(*) FILTER (metres = 0) AS zero_length, count(*) FILTER (CAST(next_at AS DATE) > utc_date) AS cross_midnight, round(sum(metres) / 1000, 4) AS km FROM ({I.PAIRS_DUCK}) GROUP BY 3"
        for g in (21600.0, 43200.0)
        for v in (15.0, 30.0)
    )
)
def rule_matrix(spark, sf_dir):
    """AGG-22, JN-13."""
    return rounded(period.rule_matrix(pairs(spark, sf_dir), (21600.0, 43200.0), (15.0, 30.0)))


@query(f"SELECT grp || '_to_' || next_grp AS transition, count(*) AS pairs FROM ({I.PAIRS_DUCK}) WHERE grp <> next_grp GROUP BY 1")
def group_transitions(spark, sf_dir):
    """AGG-33."""
    return period.transitions(pairs(spark, sf_dir))


_KEEP = f"({_EXCL.format(gap=GAP, speed=SPEED)} = 'retained')"


@query(f"""SELECT count(*) AS vessels, count(*) FILTER (NOT a) AS without, count(*) FILTER (NOT f) AS first_lost, count(*) FILTER (NOT l) AS last_lost FROM (SELECT vessel, bool_or(k) AS a, arg_min(k, r) AS f, arg_max(k, r) AS l
    FROM (SELECT vessel, {_KEEP} AS k, row_number() OVER (PARTITION BY vessel ORDER BY {I._ORDER}) AS r FROM ({I.PAIRS_DUCK})) GROUP BY 1)""")
def endpoint_censoring(spark, sf_dir):
    """AGG-32."""
    return period.censoring(pairs(spark, sf_dir), GAP, SPEED)


_EDGES = [60.0, 600.0, 3600.0, 21600.0, 86400.0]


@query(f"SELECT grp, CAST({' + '.join(f'(elapsed_s >= {e})::INT' for e in _EDGES)} AS INT) AS bin, count(*) AS rows FROM ({I.PAIRS_DUCK}) GROUP BY 1, 2")
def gap_histogram(spark, sf_dir):
    """AGG-19: bins of gaps."""
    return period.histogram(pairs(spark, sf_dir), "elapsed_s", _EDGES, ["grp"])


@query(f"""SELECT grp, count(*) AS rows, round(min(metres), 3) AS least, round(max(metres), 3) AS largest, round(avg(metres), 3) AS mean, {", ".join(f"round(quantile_cont(metres, {q}), 3) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))}
    FROM ({I.PAIRS_DUCK}) GROUP BY 1""")
def length_distribution(spark, sf_dir):
    """AGG-20."""
    return rounded(period.distribution(pairs(spark, sf_dir), "metres", ["grp"]), 3)


@query(f"""SELECT grp, {", ".join(f"round(coalesce(sum(CASE WHEN st = '{s}' THEN metres END), 0) / 1000, 4) AS {s}_km" for s in ("available", "unavailable", "inconsistent"))},
    round(sum(CASE WHEN st = 'available' THEN metres * (sog + next_sog) / 2 END) / nullif(sum(CASE WHEN st = 'available' THEN metres END), 0), 4) AS reported_mean, round(sum(metres * knots) / nullif(sum(metres), 0), 4) AS implied_mean
    FROM (SELECT *, {_STATUS} AS st FROM ({I.PAIRS_DUCK}) WHERE elapsed_s > 0 AND grp = next_grp) GROUP BY 1""")
def speed_means(spark, sf_dir):
    """AGG-18."""
    return rounded(period.sog_means(period.structural(pairs(spark, sf_dir)), ["grp"]))


_CAL = "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS utc_date"


#: Days of all events: their state follows from what a whole day holds.
_DAY = "SELECT CAST(ts AS DATE) AS utc_date, CASE WHEN sum(event_id) % 3 = 0 THEN 'failed' WHEN count(*) % 2 = 0 THEN 'retrieved' ELSE 'verified' END AS state FROM events GROUP BY 1"


def _days(spark, sf_dir):
    state = F.when(F.sum("event_id") % 3 == 0, "failed").when(F.count(F.lit(1)) % 2 == 0, "retrieved").otherwise("verified")
    return I.events(spark, sf_dir).groupBy(F.to_date("ts").alias("utc_date")).agg(state.alias("state"))


@query(f"SELECT c.utc_date, coalesce(s.state, 'absent') AS state FROM ({_CAL}) c LEFT JOIN ({_DAY}) s ON c.utc_date = s.utc_date")
def period_states(spark, sf_dir):
    """JN-10."""
    return period.with_states(period.calendar(spark, "2024-01-01", "2024-02-29"), _days(spark, sf_dir))


@query(f"SELECT utc_date FROM ({_CAL}) EXCEPT SELECT utc_date FROM ({_DAY}) WHERE state = 'verified'")
def missing_dates(spark, sf_dir):
    """JN-11, SET-1: dates of the period without a verified day."""
    return period.missing_dates(period.calendar(spark, "2024-01-01", "2024-02-29"), _days(spark, sf_dir).where("state = 'verified'"))


@query(f"""SELECT vessel, track, epoch_us(min(at)) AS first_us, epoch_us(max(at)) AS last_us, count(*) AS rows FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY vessel ORDER BY at, seq) AS BIGINT) AS track FROM
    (SELECT *, CASE WHEN epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY vessel ORDER BY at, seq)) > 43200000000 THEN 1 ELSE 0 END AS b FROM ({I.OBS_DUCK}))) GROUP BY 1, 2""")
def gap_tracks(spark, sf_dir):
    """STR-3."""
    return ingest.tracks(I.observations(spark, sf_dir), 43200.0).select("vessel", "track", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "rows")


# --- grid --------------------------------------------------------------------------------------------------------------

_RC = "CAST(floor((y0 + 670000) / 5000) AS INT)", "CAST(floor((x0 + 190000) / 5000) AS INT)"


@query(f"SELECT seq AS point_id, printf('r%03d_c%03d', {_RC[0]}, {_RC[1]}) AS cell_id, 'one' AS status FROM (SELECT seq, {I._X} AS x0, {I._Y} AS y0 FROM ({I.OBS_DUCK}))")
def point_cells(spark, sf_dir):
    """JN-3, SCL-10, SCL-14, SRT-4: the cell of every position."""
    o = I.observations(spark, sf_dir)
    x, y = S.project(F.col("lat"), F.col("lon"))
    points = o.select(F.col("seq").alias("point_id"), x.alias("x"), y.alias("y"))
    return allocate.point_cells(points, allocate.grid(spark)).select("point_id", "cell_id", "status")


@query(f"SELECT seq, round({I._X}, 3) AS x, round({I._Y}, 3) AS y, lat, lon FROM ({I.OBS_DUCK})")
def projection_round_trip(spark, sf_dir):
    """SCL-10, SCL-11: projected positions, and the inverse's latitude and longitude, equal to the input's to 9 digits."""
    o = I.observations(spark, sf_dir)
    x, y = S.project(F.col("lat"), F.col("lon"))
    p = o.select("seq", x.alias("x"), y.alias("y"))
    lat, lon = S.unproject(F.col("x"), F.col("y"))
    return p.select("seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


_BOX = "(SELECT CAST(event_id AS BIGINT) AS segment_id, CAST(event_id * 37 % 16000 AS DOUBLE) + 0.5 AS x0, CAST(event_id * 91 % 12000 AS DOUBLE) + 0.5 AS y0, CAST(event_id * 53 % 16000 AS DOUBLE) + 0.25 AS x1, CAST(event_id * 17 % 12000 AS DOUBLE) + 0.25 AS y1, CAST(user_id % 97 AS STRING) AS vessel, CASE WHEN event_id % 3 = 0 THEN 'cargo' WHEN event_id % 3 = 1 THEN 'tanker' ELSE 'passenger' END AS grp, CAST(ts AS DATE) AS utc_date, CAST(event_id % 3600 + 1 AS DOUBLE) AS elapsed_s FROM {events} WHERE user_id IS NOT NULL)"
_LINES = """(WITH s AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS metres FROM """ + _BOX.format(events="events") + """),
    c AS (SELECT segment_id, 0.0::DOUBLE AS t FROM s UNION SELECT segment_id, 1.0 FROM s UNION SELECT segment_id, (1000.0 * k - x0) / (x1 - x0) FROM s, range(0, 17) r(k) WHERE 1000.0 * k > least(x0, x1) AND 1000.0 * k < greatest(x0, x1)
          UNION SELECT segment_id, (1000.0 * k - y0) / (y1 - y0) FROM s, range(0, 13) r(k) WHERE 1000.0 * k > least(y0, y1) AND 1000.0 * k < greatest(y0, y1)),
    p AS (SELECT segment_id, t AS t0, lead(t) OVER (PARTITION BY segment_id ORDER BY t) AS t1 FROM c)
    SELECT s.*, p.t0, p.t1, metres * (t1 - t0) AS piece_m, elapsed_s * (t1 - t0) AS piece_s, CAST(floor((y0 + (t0 + t1) / 2 * (y1 - y0)) / 1000) AS INT) AS row_index, CAST(floor((x0 + (t0 + t1) / 2 * (x1 - x0)) / 1000) AS INT) AS column_index
    FROM s JOIN p USING (segment_id) WHERE t1 IS NOT NULL)"""


def _box_segments(spark, sf_dir):
    s = spark.sql("SELECT * FROM " + _BOX, events=I.events(spark, sf_dir))
    return s.withColumn("metres", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def _box_pieces(spark, sf_dir):
    cut = allocate.pieces(_box_segments(spark, sf_dir), 0, 0, 1000)
    water = I.cells(spark, sf_dir).where("i % 9 >= 2").select("row_index", "column_index", "cell_id")
    return allocate.allocated(cut, water), water


_W = f"(SELECT row_index, column_index, cell_id FROM ({I.CELLS_DUCK}) WHERE i % 9 >= 2)"


@query(f"SELECT w.cell_id, count(*) AS pieces, round(sum(piece_m), 3) AS metres, round(sum(piece_s), 3) AS seconds FROM {_LINES} l JOIN {_W} w USING (row_index, column_index) GROUP BY 1")
def segment_pieces(spark, sf_dir):
    """JN-4, SRT-8, SCL-30, AGG-31, UDTF: segments cut at grid lines, summed by cell."""
    done, _ = _box_pieces(spark, sf_dir)
    out = done.where("status = 'allocated'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_m").alias("metres"), F.sum("piece_s").alias("seconds"))
    return rounded(out, 3)


@query(f"""SELECT w.cell_id, w.row_index, w.column_index, {", ".join(f"round(coalesce(sum(CASE WHEN grp = '{g}' THEN piece_m END), 0) / 1000, 4) AS vessel_km_{g}" for g in ("passenger", "cargo", "tanker"))},
    round(coalesce(sum(piece_m), 0) / 1000, 4) AS vessel_km_all, {", ".join(f"count(DISTINCT CASE WHEN grp = '{g}' THEN vessel END) AS vessels_{g}" for g in ("passenger", "cargo", "tanker"))}, count(DISTINCT vessel) AS vessels_all,
    count(DISTINCT CASE WHEN vessel IS NOT NULL THEN (vessel, utc_date) END) AS vessel_dates_all FROM {_W} w LEFT JOIN {_LINES} l ON l.row_index = w.row_index AND l.column_index = w.column_index GROUP BY 1, 2, 3""")
def cell_grid(spark, sf_dir):
    """AGG-14, AGG-15, JN-15: every retained cell with km and distinct vessels by group."""
    done, water = _box_pieces(spark, sf_dir)
    return rounded(allocate.cell_totals(done, water))


_PARENTS = f"SELECT grp, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS p, sum(elapsed_s) AS s FROM {_BOX.format(events='events')} GROUP BY 1"


@query(f"""SELECT grp, round(p, 2) AS parent_m, round(a, 2) AS allocated_m, round(o, 2) AS outside_m, abs(p - a - o) <= greatest(1e-6, 1e-9 * p) AS conserved, abs(s - t) <= greatest(1e-6, 1e-9 * s) AS time_conserved FROM ({_PARENTS})
    JOIN (SELECT grp, sum(CASE WHEN w.cell_id IS NOT NULL THEN piece_m ELSE 0 END) AS a, sum(CASE WHEN w.cell_id IS NULL THEN piece_m ELSE 0 END) AS o, sum(piece_s) AS t FROM {_LINES} l LEFT JOIN {_W} w USING (row_index, column_index) GROUP BY 1) USING (grp)""")
def distance_balance(spark, sf_dir):
    """VAL-2: parents against allocated and outside metres and seconds (the oracle's plain sums get a wider tolerance)."""
    done, _ = _box_pieces(spark, sf_dir)
    out = allocate.balance(_box_segments(spark, sf_dir), done)
    return rounded(out.select("grp", "parent_m", "allocated_m", "outside_m", "conserved", "time_conserved"), 2)


@query(f"SELECT count(*) AS cells, count(*) FILTER (abs(coalesce(km, 0) - coalesce(g, 0)) > 1e-6) AS off FROM {_W} w LEFT JOIN (SELECT row_index, column_index, sum(piece_m) / 1000 AS km, sum(CASE WHEN grp = 'cargo' THEN piece_m ELSE 0 END) / 1000 + sum(CASE WHEN grp = 'tanker' THEN piece_m ELSE 0 END) / 1000 + sum(CASE WHEN grp = 'passenger' THEN piece_m ELSE 0 END) / 1000 AS g FROM {_LINES} GROUP BY 1, 2) l USING (row_index, column_index)")
def cells_reconcile(spark, sf_dir):
    """VAL-3: cells whose km are not what was allocated to them."""
    done, water = _box_pieces(spark, sf_dir)
    return allocate.cells_reconcile(done, allocate.cell_totals(done, water))


@query(f"WITH p AS (SELECT segment_id, any_value(elapsed_s) AS e, sum(piece_s) AS s FROM {_LINES} GROUP BY 1) SELECT count(*) AS segments, count(*) FILTER (abs(e - s) > 1e-6) AS off, round(sum(e), 2) AS total_s, round(sum(s), 2) AS pieces_s FROM p")
def segment_times(spark, sf_dir):
    """VAL-4: seconds of segments against those of their pieces, each and in all."""
    done, _ = _box_pieces(spark, sf_dir)
    return rounded(allocate.segment_times(_box_segments(spark, sf_dir), done), 2)


# --- density, overlay, exposure ----------------------------------------------------------------------------------------

_SRC = "(SELECT p_partkey AS source_id, CAST(p_partkey * 131 % 15000 AS DOUBLE) AS sx0, CAST(p_partkey * 71 % 11000 AS DOUBLE) AS sy0, CAST(p_partkey * 131 % 15000 + 200 + p_size * 16 AS DOUBLE) AS sx1, CAST(p_partkey * 71 % 11000 + 300 AS DOUBLE) AS sy1, CAST(p_size AS DOUBLE) / 8 AS density FROM {part})"


def _sources(spark, sf_dir):
    return spark.sql("SELECT * FROM " + _SRC, part=table(spark, sf_dir, "part"))


_COMMON = "greatest(0, least(sx1, cx1) - greatest(sx0, cx0)) * greatest(0, least(sy1, cy1) - greatest(sy0, cy0))"


@query(f"SELECT cell_id, round(sum({_COMMON} * s.density) / 1e6, 6) AS abundance, round(sum({_COMMON}) / 1e6, 6) AS covered_km2, round(sum({_COMMON} * s.density) / sum({_COMMON}), 6) AS density FROM {_SRC.format(part='part')} s JOIN ({I.CELLS_DUCK}) c ON {_COMMON} > 0 GROUP BY 1")
def density_transfer(spark, sf_dir):
    """JN-5, FLT-18: densities of boxes onto cells by common area."""
    return rounded(exposure.transfer_boxes(_sources(spark, sf_dir), I.cells(spark, sf_dir).drop("density"), 1000.0), 6)


@query(f"SELECT cell_id, round(sum({_COMMON} * s.density) / 1e6, 6) AS abundance, round(sum({_COMMON}) / 1e6, 6) AS covered_km2, round(sum({_COMMON} * s.density) / sum({_COMMON}), 6) AS density FROM {_SRC.format(part='part')} s JOIN ({I.CELLS_DUCK}) c ON {_COMMON} > 0 GROUP BY 1")
def density_transfer_polygons(spark, sf_dir):
    """JN-5, SCL-25, SCL-28: the same through WKB polygons and the clipping function."""
    @F.pandas_udf("binary")
    def boxes(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.wkb_of([G.box(*b)]) for b in zip(x0, y0, x1, y1, strict=True)])

    s = _sources(spark, sf_dir).withColumn("geometry", boxes("sx0", "sy0", "sx1", "sy1")).select("source_id", "density", "geometry")
    c = I.cells(spark, sf_dir).drop("density").withColumn("water", F.lit(None).cast("binary"))
    return rounded(exposure.transfer_polygons(s, c, 1000.0, 0.0, 0.0), 6)


@query(f"""WITH b AS (SELECT source_id AS id, sx0 AS x0, sy0 AS y0, sx1 AS x1, sy1 AS y1 FROM {_SRC.format(part="part")}) SELECT a.id AS aid, b.id AS bid,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common FROM b a JOIN b ON a.id < b.id WHERE common > 1""")
def overlapping_sources(spark, sf_dir):
    """JN-6: pairs of source boxes that overlap."""
    b = _sources(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("sx0").alias("x0"), F.col("sy0").alias("y0"), F.col("sx1").alias("x1"), F.col("sy1").alias("y1"))
    return exposure.overlaps(b, 1000.0)


DOMAIN, BOUNDARY = (500.0, 1500.0, 14250.0, 1e7), (4100.0, 0.0, 9900.0, 8300.0)


def _ov(b):
    return f"greatest(0, least(cx1, {b[2]}) - greatest(cx0, {b[0]})) * greatest(0, least(cy1, {b[3]}) - greatest(cy0, {b[1]}))"


_BOTH = (4100.0, 1500.0, 9900.0, 8300.0)
_AREAS = f"SELECT *, 1e6 AS water_m2, {_ov(DOMAIN)} AS qualified_m2, {_ov(_BOTH)} AS inside_m2, {_ov(DOMAIN)} - {_ov(_BOTH)} AS outside_m2 FROM ({I.CELLS_DUCK})"


def _areas(spark, sf_dir):
    return exposure.overlay_boxes(I.cells(spark, sf_dir), DOMAIN, BOUNDARY)


@query(f"SELECT cell_id, CAST(water_m2 AS DOUBLE) AS water_m2, qualified_m2, inside_m2, outside_m2, water_m2 - qualified_m2 AS excluded_m2 FROM ({_AREAS})")
def three_way_overlay(spark, sf_dir):
    """JN-7, SCL-23."""
    return _areas(spark, sf_dir).select("cell_id", "water_m2", "qualified_m2", "inside_m2", "outside_m2", "excluded_m2")


@query(f"SELECT cell_id, CAST(water_m2 AS DOUBLE) AS water_m2, round(qualified_m2, 3) AS qualified_m2, round(inside_m2, 3) AS inside_m2 FROM ({_AREAS})")
def three_way_overlay_polygons(spark, sf_dir):
    """JN-7..9 through the polygon function."""
    c = I.cells(spark, sf_dir).withColumn("water", F.lit(None).cast("binary"))
    out = exposure.overlay_polygons(c, [G.box(*DOMAIN)], [G.box(*BOUNDARY)])
    return rounded(out.select("cell_id", "water_m2", "qualified_m2", "inside_m2"), 3)


_INT = f"SELECT *, CASE WHEN qualified_m2 > 0 THEN density * vessel_km / (water_m2 / 1e6) END AS product, CASE WHEN qualified_m2 > 0 THEN density * ln(1 + vessel_km / (water_m2 / 1e6)) END AS log_ FROM ({_AREAS})"


@query(f"SELECT cell_id, round(product, 6) AS product, round(log_, 6) AS log, round(product / max(product) OVER (), 6) AS product_index, round(log_ / max(log_) OVER (), 6) AS log_index FROM ({_INT})")
def intensity_index(spark, sf_dir):
    """AGG-27, SCL-7."""
    return rounded(exposure.intensities(_areas(spark, sf_dir)).select("cell_id", "product", "log", "product_index", "log_index"), 6)


@query(f"""SELECT m AS method, round(sum(qualified_m2) / 1e6, 6) AS qualified_km2, round(sum(v * qualified_m2) / 1e6, 6) AS integrated_qualified, round(sum(v * inside_m2) / 1e6, 6) AS integrated_inside, round(sum(v * outside_m2) / 1e6, 6) AS integrated_outside, round(max(v), 6) AS maximum,
    round(sum(v * inside_m2) / sum(v * qualified_m2), 6) AS share_inside, round(sum(v * outside_m2) / sum(v * qualified_m2), 6) AS share_outside FROM (SELECT *, 'product' AS m, product AS v FROM ({_INT}) UNION ALL SELECT *, 'log', log_ FROM ({_INT})) WHERE qualified_m2 > 0 GROUP BY 1""")
def integrated_overlap(spark, sf_dir):
    """AGG-25."""
    c = exposure.intensities(_areas(spark, sf_dir))
    parts = [exposure.summary(c, m).select(F.lit(m).alias("method"), "*") for m in exposure.METHODS]
    return rounded(parts[0].unionByName(parts[1]), 6)


_Q = f"""WITH c AS (SELECT * FROM ({_INT}) WHERE qualified_m2 > 0), p AS (SELECT 'all_valid' AS reference, product AS v, sum(qualified_m2) AS w FROM c GROUP BY 2 UNION ALL SELECT 'positive_only', product, sum(qualified_m2) FROM c WHERE product > 0 GROUP BY 2),
    r AS (SELECT *, sum(w) OVER (PARTITION BY reference ORDER BY v) AS cum, sum(w) OVER (PARTITION BY reference) AS total FROM p), t AS (SELECT reference, CAST(s AS DOUBLE) AS share, min(v) AS threshold FROM r, (SELECT unnest([0.8, 0.9, 0.95]) AS s) WHERE cum >= s * total GROUP BY 1, 2)"""


@query(_Q + " SELECT t.reference, t.share, round(t.threshold, 6) AS threshold, round(sum(qualified_m2) / 1e6, 6) AS high_qualified_km2, round(sum(inside_m2) / 1e6, 6) AS high_inside_km2, round(sum(outside_m2) / 1e6, 6) AS high_outside_km2, count(*) AS cells, true AS available FROM t JOIN c ON c.product >= t.threshold AND t.threshold > 0 GROUP BY 1, 2, 3")
def high_thresholds(spark, sf_dir):
    """AGG-21, AGG-26, WIN-9."""
    out = exposure.thresholds(exposure.intensities(_areas(spark, sf_dir)))
    return rounded(out.select("reference", "share", "threshold", "high_qualified_km2", "high_inside_km2", "high_outside_km2", "cells", "available"), 6)


@query("WITH s AS (SELECT l_quantity AS v, sum(l_extendedprice) AS w FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY v) AS cum, sum(w) OVER () AS total FROM s) SELECT CAST(p AS DOUBLE) AS share, min(v) AS threshold FROM r, (SELECT unnest([0.5, 0.8, 0.9]) AS p) WHERE cum >= p * total GROUP BY 1")
def weighted_quantiles(spark, sf_dir):
    """AGG-21 on a large table."""
    return A.weighted_quantiles(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (0.5, 0.8, 0.9))


@query(f"SELECT cell_id, round(product * outside_m2 / 1e6, 6) AS outside_integrated FROM ({_INT}) WHERE product * outside_m2 > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def outside_top(spark, sf_dir):
    """SRT-6."""
    return rounded(exposure.outside_contributors(exposure.intensities(_areas(spark, sf_dir))), 6)


@query(f"""SELECT CAST(floor(cx0 / 2000) * 2000 AS BIGINT) AS coarse_x, CAST(floor(cy0 / 2000) * 2000 AS BIGINT) AS coarse_y, CAST(count(*) AS DOUBLE) AS water_km2, sum(density) AS abundance, sum(vessel_km) AS vessel_km, count(*) AS fine_cells, round(sum(density) / count(*), 6) AS density
    FROM ({I.CELLS_DUCK}) GROUP BY 1, 2""")
def coarsened_cells(spark, sf_dir):
    """AGG-24, SCL-15."""
    c = I.cells(spark, sf_dir).select(F.col("cx0").alias("x_min_m"), F.col("cy0").alias("y_min_m"), F.lit(1.0).alias("water_km2"), F.col("density").alias("abundance"), "vessel_km")
    return rounded(exposure.coarsened(c, 2000), 6)


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0 AS a, rank() OVER (ORDER BY vessel_km) + (count(*) OVER (PARTITION BY vessel_km) - 1) / 2.0 AS b FROM ({I.CELLS_DUCK})) SELECT round(corr(a, b), 6) AS spearman, count(*) AS rows FROM r""")
def rank_correlation(spark, sf_dir):
    """AGG-28, WIN-8."""
    return rounded(A.spearman(I.cells(spark, sf_dir), "density", "vessel_km"), 6)


_SH = f"SELECT round(sum(product * inside_m2) / sum(product * qualified_m2), 6) AS share_inside, round(sum(product * outside_m2) / sum(product * qualified_m2), 6) AS share_outside FROM ({_INT})"


@query(f"SELECT 'as_is' AS run, * FROM ({_SH}) UNION ALL SELECT 'scaled', * FROM ({_SH})")
def scaling_control(spark, sf_dir):
    """AGG-29."""
    return rounded(exposure.scaling_control(_areas(spark, sf_dir), 7.0), 6)


@query(f"""WITH r AS (SELECT 'p' || k AS name, cell_id, CASE WHEN (i + k) % 4 = 0 THEN 0.0 ELSE vessel_km + k * (i % 3) END AS value FROM ({I.CELLS_DUCK}), (SELECT unnest([1, 2, 3]) AS k)) SELECT x.name AS a, y.name AS b, count(*) AS cells, count(*) FILTER (y.value > x.value) AS larger, count(*) FILTER (y.value < x.value) AS smaller,
    count(*) FILTER (x.value = 0 AND y.value > 0) AS newly_positive, CAST(max(abs(y.value - x.value)) AS DOUBLE) AS largest_difference FROM r x JOIN r y ON x.cell_id = y.cell_id AND x.name < y.name GROUP BY 1, 2""")
def candidate_differences(spark, sf_dir):
    """JN-14, AGG-30, SRT-7."""
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    r = I.cells(spark, sf_dir).withColumn("k", k).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"), "cell_id", F.when((F.col("i") + F.col("k")) % 4 == 0, 0.0).otherwise(F.col("vessel_km") + F.col("k") * (F.col("i") % 3)).alias("value"))
    return exposure.pair_differences(r)


@query(f"WITH s AS (SELECT 'primary' AS scenario, * FROM ({_SH}) UNION ALL SELECT 'log', round(sum(log_ * inside_m2) / sum(log_ * qualified_m2), 6), 0 FROM ({_INT})) SELECT a.scenario, round((a.share_inside - b.share_inside) * 100, 3) AS points FROM s a, s b WHERE a.scenario <> 'primary' AND b.scenario = 'primary'")
def scenario_deltas(spark, sf_dir):
    """AGG-35."""
    c = exposure.intensities(_areas(spark, sf_dir))
    s = exposure.summary(c).select(F.lit("primary").alias("scenario"), F.round("share_inside", 6).alias("share_inside")).unionByName(exposure.summary(c, "log").select(F.lit("log").alias("scenario"), F.round("share_inside", 6).alias("share_inside")))
    return rounded(exposure.share_deltas(s), 3)


_ST = "(SELECT s_suppkey AS station_id, CAST(s_suppkey * 997 % 16000 AS DOUBLE) AS sx, CAST(s_suppkey * 613 % 12000 AS DOUBLE) AS sy FROM {supplier})"


@query(f"SELECT DISTINCT cell_id FROM ({I.CELLS_DUCK}) c JOIN {_ST.format(supplier='supplier')} s ON ((cx0 + cx1) / 2 - sx) * ((cx0 + cx1) / 2 - sx) + ((cy0 + cy1) / 2 - sy) * ((cy0 + cy1) / 2 - sy) <= 1500.0 * 1500.0")
def domain_by_distance(spark, sf_dir):
    """JN-8: cells within reach of stations."""
    return exposure.domain_cells(I.cells(spark, sf_dir), spark.sql("SELECT * FROM " + _ST, supplier=table(spark, sf_dir, "supplier")), 1500.0)


@query(f"SELECT c.cell_id, c.density, d.vessel_km, c.row_index FROM ({I.CELLS_DUCK}) c JOIN ({I.CELLS_DUCK}) d USING (cell_id)")
def strict_one_to_one(spark, sf_dir):
    """JN-1."""
    a = I.cells(spark, sf_dir).select("cell_id", "row_index", "density")
    b = I.cells(spark, sf_dir).select("cell_id", "row_index", "vessel_km")
    return exposure.strict_join(a, b, "cell_id", ["row_index"]).select("cell_id", "density", "vessel_km", "row_index")


# --- aggregates and scalars --------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(fsum(l_extendedprice * l_discount), 2) AS exact, round(fsum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def deterministic_sums(spark, sf_dir):
    """AGG-16, AGG-17: sums that no order of rows changes."""
    li = table(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_returnflag").agg(A.exact_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("exact"), A.exact_sum(F.col("l_extendedprice")).alias("total"))
    return rounded(sums, 2)


@query("SELECT event_id, CAST(CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 50 AND value <= 100 THEN 2 END AS INT) AS left_class, CAST(CASE WHEN value = 0 THEN -1 WHEN value > 0 AND value <= 10 THEN 0 WHEN value > 10 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 100 THEN 2 END AS INT) AS right_class FROM events")
def class_breaks(spark, sf_dir):
    """FLT-20."""
    b = [0.0, 10.0, 50.0, 100.0]
    return I.events(spark, sf_dir).select("event_id", S.class_of(F.col("value"), b, False).alias("left_class"), S.class_of(F.col("value"), b, True, True).alias("right_class"))


@query("SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(abs(l_extendedprice / l_quantity * l_quantity - l_extendedprice) <= greatest(1e-6 * l_extendedprice, 1e-9), false)) AS consistent, count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) AS discount, count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'R'), false)) AS flag FROM lineitem")
def rule_violations(spark, sf_dir):
    """FLT-21, FLT-22, VAL-17, SCL-29: rows that break each rule."""
    li = table(spark, sf_dir, "lineitem")
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return C.violations(li, consistent=S.close(p / q * q, p, 1e-6, 1e-9), discount=F.col("l_discount").between(0, 0.05), flag=F.col("l_returnflag").isin("A", "R"))


@query("SELECT event_id, regexp_full_match(props, '[^a-z]*') AS no_letters, trim(' x ' || event_type) AS trimmed, nullif(event_type, 'view') AS not_view, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_text, epoch_us(ts) AS at_us, CAST(hour(ts) AS INT) AS at_hour FROM events")
def scalar_texts(spark, sf_dir):
    """SCL-1..6, FLT-13."""
    e = I.events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    full = F.when(F.col("props").isNotNull(), S.full_match(F.col("props"), "[^a-z]*"))
    return e.select("event_id", full.alias("no_letters"), F.trim(F.concat(F.lit(" x "), F.col("event_type"))).alias("trimmed"), F.nullif("event_type", F.lit("view")).alias("not_view"), S.utc_text(F.col("at")).alias("at_text"), F.unix_micros("at").alias("at_us"), F.hour("at").alias("at_hour"))


@query("SELECT o_orderkey, 'ord-' || substr(sha256(strlen(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || '|' || strlen(o_orderstatus) || ':' || o_orderstatus), 1, 24) AS content_id, regexp_replace('see a' || o_orderkey || '@mail.example.com?token=' || o_orderkey, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g').regexp_replace('(token|key)=[^&\\s]+', '\\1=[redacted]', 'g') AS safe FROM orders")
def content_ids(spark, sf_dir):
    """SCL-17, SCL-21."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("see a"), F.col("o_orderkey").cast("string"), F.lit("@mail.example.com?token="), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", S.content_id("ord-", F.col("o_orderkey"), F.col("o_orderstatus")).alias("content_id"), S.redacted(text).alias("safe"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'complete' WHEN p_size <= 20 THEN 'within_tolerance' ELSE 'partial' END AS coverage, CAST(floor((p_partkey - 500) / 100.0) * 100 AS BIGINT) AS origin, round(p_size * 1852.0 / 1609.344, 6) AS miles FROM part")
def units_and_coverage(spark, sf_dir):
    """SCL-12, SCL-15, SCL-16, SCL-18, SCL-23."""
    p = table(spark, sf_dir, "part")
    uncovered = F.when(F.col("p_size") <= 5, 0.0).when(F.col("p_size") <= 20, 0.05).otherwise(1.0)
    return p.select("p_partkey", S.coverage_status(uncovered).alias("coverage"), S.coarse_origin(F.col("p_partkey") - 500, 100).alias("origin"), F.round(F.col("p_size") * S.NAUTICAL_MILE_M / S.STATUTE_MILE_M, 6).alias("miles"))


@query("SELECT c_custkey, CAST(round(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(30, 10)), 1) AS DECIMAL(30, 1))::VARCHAR AS one_place FROM customer")
def half_up_text(spark, sf_dir):
    """SCL-19."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.half_up_text(F.col("c_acctbal"), 1).alias("one_place"))


@query(None)
def geodesic_lengths(spark, sf_dir):
    """SCL-9: geodesic and projected lengths of pairs, by group (tests hold the function against known distances)."""
    p = pairs(spark, sf_dir).withColumn("geodesic_m", allocate.geodesic_column("lat", "lon", "next_lat", "next_lon"))
    return rounded(p.groupBy("grp").agg((F.sum("geodesic_m") / 1000).alias("geodesic_km"), (F.sum("metres") / 1000).alias("projected_km"), F.max(F.abs(F.col("metres") - F.col("geodesic_m"))).alias("largest_difference_m")), 3)


# --- ingest and publication --------------------------------------------------------------------------------------------

_OLD = f"SELECT utc_date, sha256(CAST(utc_date AS VARCHAR)) AS sha256, 'verified' AS state, CAST(1 AS BIGINT) AS attempts FROM ({_DAY}) WHERE state <> 'failed'"
_NEW = f"SELECT utc_date, CASE WHEN day(utc_date) % 5 = 0 THEN sha256('other') ELSE sha256(CAST(utc_date AS VARCHAR)) END AS sha256 FROM ({_DAY}) WHERE state <> 'retrieved'"


def _state(spark, sf_dir):
    own = F.sha2(F.col("utc_date").cast("string"), 256)
    old = _days(spark, sf_dir).where("state <> 'failed'").select("utc_date", own.alias("sha256"), F.lit("verified").alias("state"), F.lit(1).cast("long").alias("attempts"))
    other = hashlib.sha256(b"other").hexdigest()
    new = _days(spark, sf_dir).where("state <> 'retrieved'").select("utc_date", F.when(F.dayofmonth("utc_date") % 5 == 0, other).otherwise(own).alias("sha256"))
    return old, new


@query(f"SELECT coalesce(o.utc_date, n.utc_date) AS utc_date, coalesce(o.sha256, n.sha256) AS sha256, CASE WHEN n.sha256 <> o.sha256 THEN 'conflict' ELSE 'verified' END AS state, CAST(coalesce(o.attempts, 0) + CASE WHEN n.utc_date IS NULL THEN 0 ELSE 1 END AS BIGINT) AS attempts FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.utc_date = n.utc_date")
def ingest_upsert(spark, sf_dir):
    """STA-1, STA-5."""
    return ingest.upsert(*_state(spark, sf_dir))


@query(f"SELECT coalesce(o.utc_date, f.utc_date) AS utc_date, o.sha256, CASE WHEN o.state IS NOT NULL THEN o.state ELSE 'failed' END AS state, CAST(coalesce(o.attempts, 0) + coalesce(f.n, 0) AS BIGINT) AS attempts FROM ({_OLD}) o FULL JOIN (SELECT CAST(ts AS DATE) AS utc_date, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) f ON o.utc_date = f.utc_date")
def ingest_failures(spark, sf_dir):
    """STA-2."""
    old, _ = _state(spark, sf_dir)
    return ingest.failed(old, I.events(spark, sf_dir).where("event_type = 'error'").select(F.to_date("ts").alias("utc_date")))


@query(f"SELECT n.* FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.utc_date = n.utc_date AND o.sha256 = n.sha256)")
def ingest_to_do(spark, sf_dir):
    """STA-6."""
    old, new = _state(spark, sf_dir)
    return ingest.to_do(new, old)


@query(f"WITH u AS (SELECT CASE WHEN n.sha256 <> o.sha256 THEN 'conflict' ELSE 'verified' END AS state FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.utc_date = n.utc_date) SELECT count(*) AS dates, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'conflict') AS conflict, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS absent FROM u")
def ingest_roll_up(spark, sf_dir):
    """STA-8."""
    return ingest.roll_up(ingest.upsert(*_state(spark, sf_dir)))


_R, _O = f"SELECT utc_date AS d FROM ({_DAY}) WHERE state <> 'failed'", f"SELECT utc_date AS d FROM ({_DAY}) WHERE state <> 'retrieved'"


@query(f"SELECT 'missing' AS which, count(*) AS dates FROM ({_R} EXCEPT {_O}) UNION ALL SELECT 'common', count(*) FROM ({_R} INTERSECT {_O}) UNION ALL SELECT 'unrequested', count(*) FROM ({_O} EXCEPT {_R})")
def date_sets(spark, sf_dir):
    """SET-1, SET-2, FLT-15, STA-9."""
    d = _days(spark, sf_dir)
    return ingest.date_sets(d.where("state <> 'failed'"), d.where("state <> 'retrieved'"))


@query("SELECT event_id, CASE WHEN bytes = 100 OR event_id % 7 = 0 THEN 'verified' ELSE 'unverified' END AS bytes_state FROM (SELECT event_id, 100 + event_id % 3 AS bytes FROM events)")
def byte_completeness(spark, sf_dir):
    """STA-7."""
    e = I.events(spark, sf_dir)
    return e.select("event_id", ingest.byte_state(F.lit(100), 100 + F.col("event_id") % 3, F.col("event_id") % 7 == 0).alias("bytes_state"))


@query("SELECT event_id, t <> '' AND NOT (t LIKE '%://%' OR t LIKE '/%' OR t LIKE '%\\%') AS public FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://x.example/y' WHEN 1 THEN '/root/data' WHEN 2 THEN '' WHEN 3 THEN 'C:\\data' ELSE 'Monthly mean' END AS t FROM events)")
def public_texts(spark, sf_dir):
    """PUB-1, PUB-2."""
    t = F.element_at(F.array(*map(F.lit, ("https://x.example/y", "/root/data", "", "C:\\data", "Monthly mean"))), (F.col("event_id") % 5 + 1).cast("int"))
    return I.events(spark, sf_dir).select("event_id", S.public_text(t).alias("public"))


@query(f"SELECT cell_id, CASE WHEN qualified_m2 <= 0 THEN 'none' WHEN abs(qualified_m2 - water_m2) <= 1e-12 * water_m2 THEN 'full' ELSE 'partial' END AS overlap FROM ({_AREAS})")
def display_overlap_class(spark, sf_dir):
    """PUB-10, JN-9."""
    q, w = F.col("qualified_m2"), F.col("water_m2")
    return _areas(spark, sf_dir).select("cell_id", F.when(q <= 0, "none").when(F.abs(q - w) <= 1e-12 * w, "full").otherwise("partial").alias("overlap"))


@query(None)
def geojson_features(spark, sf_dir):
    """SNK-4: the cells as GeoJSON features."""
    @F.pandas_udf("binary")
    def boxes(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.wkb_of([G.box(*b)]) for b in zip(x0, y0, x1, y1, strict=True)])

    return sinks.features(I.cells(spark, sf_dir).withColumn("geometry", boxes("cx0", "cy0", "cx1", "cy1")), "geometry", "cell_id", ["density", "vessel_km"])


@query("""SELECT l_returnflag AS slice, count(*) AS rows, count(*) FILTER (o > l_orderkey OR (o = l_orderkey AND n > l_linenumber)) AS inversions FROM (SELECT l_returnflag, l_orderkey, l_linenumber, lag(l_orderkey) OVER w AS o, lag(l_linenumber) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber DESC)) GROUP BY 1""")
def sorted_slice(spark, sf_dir):
    """STA-11: rows of each stored slice that stand before a lesser one; the lines of an order are stored backwards here."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    blocks = li.withColumn("b", F.floor(F.col("l_orderkey") / 1000))
    base = blocks.groupBy("l_returnflag", "b").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("l_returnflag").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = blocks.join(base, ["l_returnflag", "b"]).withColumn("position", F.col("before") + F.row_number().over(Window.partitionBy("l_returnflag", "b").orderBy("l_orderkey", F.desc("l_linenumber"))))
    return C.sorted_slices(placed, ["l_orderkey", "l_linenumber"], "l_returnflag")


# --- overlays with holes, balances, controls ---------------------------------------------------------------------------

_IN = "greatest(0, least({x1}, cx1) - greatest({x0}, cx0)) * greatest(0, least({y1}, cy1) - greatest({y0}, cy0))"


def _boxes(b, *holes):
    """A box's common area with a cell, less holes that lie within it, as SQL."""
    part = lambda x: _IN.format(x0=x[0], y0=x[1], x1=x[2], y1=x[3])
    return "(" + " - ".join(map(part, (b, *holes))) + ")"


#: A domain in two parts, one with a hole, and a boundary with a hole that lies across the domain's.
_D1, _D1H, _D2 = (500.0, 1500.0, 9200.0, 1e7), (2250.0, 3100.0, 6400.0, 7300.0), (10300.0, 800.0, 15100.0, 1e7)
_V, _VH = (1200.0, 2400.0, 12800.0, 9900.0), (5200.0, 5600.0, 11500.0, 8050.0)


def _and(*boxes):
    return (max(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), min(b[3] for b in boxes))


def _joint(a, v):
    """A box of the domain with the boundary: inclusion and exclusion of the boundary's hole."""
    return f"({_boxes(_and(a, _V))} - {_boxes(_and(a, _VH))})"


_Q_HOLES = f"({_boxes(_D1, _D1H)} + {_boxes(_D2)})"
_I_HOLES = f"({_joint(_D1, _V)} - {_joint(_D1H, _V)} + {_joint(_D2, _V)})"


@query(f"SELECT cell_id, 1000000.0::DOUBLE AS water_m2, round({_Q_HOLES}, 3) AS qualified_m2, round({_I_HOLES}, 3) AS inside_m2, round({_Q_HOLES} - {_I_HOLES}, 3) AS outside_m2, round(1e6 - {_Q_HOLES}, 3) AS excluded_m2 FROM ({I.CELLS_DUCK})")
def overlay_with_holes(spark, sf_dir):
    """JN-7..9, VAL-6, SCL-25: the joint overlay of cells with a domain of two parts and a boundary, both with holes."""
    ring = lambda *b: G.box(*b)[0]
    c = I.cells(spark, sf_dir).withColumn("water", F.lit(None).cast("binary"))
    out = exposure.overlay_polygons(c, [[ring(*_D1), ring(*_D1H)], [ring(*_D2)]], [[ring(*_V), ring(*_VH)]])
    return rounded(out.select("cell_id", "water_m2", "qualified_m2", "inside_m2", "outside_m2", "excluded_m2"), 3)


@query(f"SELECT cell_id, round(vessel_km * {_I_HOLES} / 1e6, 6) AS inside_km, round(vessel_km * ({_Q_HOLES} - {_I_HOLES}) / 1e6, 6) AS outside_km, round(vessel_km * (1e6 - {_Q_HOLES}) / 1e6, 6) AS excluded_km FROM ({I.CELLS_DUCK})")
def split_totals(spark, sf_dir):
    """SCL-22: a cell's total over all of its water, split by area."""
    ring = lambda *b: G.box(*b)[0]
    c = I.cells(spark, sf_dir).withColumn("water", F.lit(None).cast("binary"))
    out = exposure.overlay_polygons(c, [[ring(*_D1), ring(*_D1H)], [ring(*_D2)]], [[ring(*_V), ring(*_VH)]])
    return rounded(out.select("cell_id", *[exposure.split_total(F.col("vessel_km"), f"{k}_m2").alias(f"{k}_km") for k in ("inside", "outside", "excluded")]), 6)


#: Sources of parts: a box with a hole in its middle.
_HOLED = "(SELECT *, sx0 + 50 AS hx0, sy0 + 75 AS hy0, sx1 - 100 AS hx1, sy1 - 125 AS hy1 FROM {part})"
_HOLED_DUCK = _HOLED.format(part=_SRC.format(part="part"))
_COMMON_HOLED = f"({_IN.format(x0='sx0', y0='sy0', x1='sx1', y1='sy1')} - {_IN.format(x0='hx0', y0='hy0', x1='hx1', y1='hy1')})"


def _holed(spark, sf_dir):
    @F.pandas_udf("binary")
    def wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.wkb_of([[G.box(*b)[0], G.box(b[0] + 50, b[1] + 75, b[2] - 100, b[3] - 125)[0]]]) for b in zip(x0, y0, x1, y1, strict=True)])

    return _sources(spark, sf_dir).withColumn("geometry", wkb("sx0", "sy0", "sx1", "sy1")).select("source_id", "density", "geometry")


def _water(spark, sf_dir):
    return I.cells(spark, sf_dir).where("i % 9 >= 2").drop("density").withColumn("water", F.lit(None).cast("binary"))


@query(f"SELECT cell_id, round(sum({_COMMON_HOLED} * s.density) / 1e6, 4) AS abundance, round(sum({_COMMON_HOLED}) / 1e6, 4) AS covered_km2 FROM {_HOLED_DUCK} s JOIN (SELECT * FROM ({I.CELLS_DUCK}) WHERE i % 9 >= 2) c ON {_COMMON_HOLED} > 0 GROUP BY 1")
def density_transfer_holes(spark, sf_dir):
    """JN-5, SCL-25: densities of polygons with holes onto the cells of water."""
    return rounded(exposure.transfer_polygons(_holed(spark, sf_dir), _water(spark, sf_dir), 1000.0, 0.0, 0.0).select("cell_id", "abundance", "covered_km2"), 4)


@query(f"SELECT round(a, 4) AS source_abundance, round(a, 4) AS allocated, a > 0 AS conserved FROM (SELECT sum({_COMMON_HOLED} * s.density) / 1e6 AS a FROM {_HOLED_DUCK} s JOIN (SELECT * FROM ({I.CELLS_DUCK}) WHERE i % 9 >= 2) c ON {_COMMON_HOLED} > 0)")
def abundance_balance(spark, sf_dir):
    """VAL-5: abundance of the sources within the union of the cells of water, against what the cells got."""
    sources = _holed(spark, sf_dir)
    got = exposure.transfer_polygons(sources, _water(spark, sf_dir), 1000.0, 0.0, 0.0)
    domain = [G.box(1000.0 * (i % 16), 1000.0 * (i // 16), 1000.0 * (i % 16) + 1000, 1000.0 * (i // 16) + 1000) for i in range(16 * 13) if i % 9 >= 2]  # sources end below row 12
    return rounded(exposure.abundance_balance(sources, got, domain), 4)


@query(f"SELECT round(sum({_Q_HOLES}), 2) AS cells_m2, round(sum({_Q_HOLES}), 2) AS mask_m2, sum({_Q_HOLES}) > 0 AS conserved FROM ({I.CELLS_DUCK})")
def water_balance(spark, sf_dir):
    """VAL-7: the cells' water against the mask's area within the grid."""
    ring = lambda *b: G.box(*b)[0]
    mask = [[ring(*_D1), ring(*_D1H)], [ring(*_D2)]]
    c = I.cells(spark, sf_dir).withColumn("water", F.lit(None).cast("binary"))
    cells = exposure.overlay_polygons(c, mask, mask).select("cell_id", F.col("qualified_m2").alias("water_m2"))
    top = I.cells(spark, sf_dir).agg(F.max("cy1")).first()[0]
    return rounded(exposure.water_balance(cells, mask, (0.0, 0.0, 16000.0, top)), 2)


@query(f"SELECT m AS measure, CAST(CASE m WHEN 'water_km2' THEN n WHEN 'abundance' THEN d ELSE k END AS DOUBLE) AS fine, CAST(CASE m WHEN 'water_km2' THEN n2 WHEN 'abundance' THEN d2 ELSE k2 END AS DOUBLE) AS coarse, abs(CASE m WHEN 'water_km2' THEN n - n2 WHEN 'abundance' THEN d - d2 ELSE k - k2 END) < 1e-6 AS conserved FROM (SELECT count(*) AS n, sum(density) AS d, sum(vessel_km) AS k FROM ({I.CELLS_DUCK})), (SELECT sum(n) AS n2, sum(d) AS d2, sum(k) AS k2 FROM (SELECT count(*) AS n, sum(density) AS d, sum(vessel_km) AS k FROM ({I.CELLS_DUCK}) GROUP BY floor(cx0 / 2000), floor(cy0 / 2000))), (SELECT unnest(['water_km2', 'abundance', 'vessel_km']) AS m)")
def coarse_balance(spark, sf_dir):
    """VAL-8: totals before and after coarsening."""
    c = I.cells(spark, sf_dir).select(F.col("cx0").alias("x_min_m"), F.col("cy0").alias("y_min_m"), F.lit(1.0).alias("water_km2"), F.col("density").alias("abundance"), "vessel_km")
    return exposure.coarse_balance(c, exposure.coarsened(c, 2000))


@query(f"SELECT true AS available, round(max(product), 6) AS normaliser, abs(sum(product / t * inside_m2) / sum(product / t * qualified_m2) - sum(product * inside_m2) / sum(product * qualified_m2)) < 1e-12 AS same_share, count(*) FILTER (product >= 0.9 * t) = count(*) FILTER (product / t >= 0.9) AS memberships_equal FROM ({_INT}), (SELECT max(product) AS t FROM ({_INT})) WHERE qualified_m2 > 0")
def normalisation_control(spark, sf_dir):
    """PUB-5: scaling all intensities to a largest of 1 changes neither shares nor high cells."""
    out = exposure.normalisation_control(exposure.intensities(_areas(spark, sf_dir)))
    return out.select("available", F.round("normaliser", 6).alias("normaliser"), (F.abs("inside_share_difference") < 1e-12).alias("same_share"), "memberships_equal")


_STATIONS = "(SELECT s_suppkey AS station_id, CASE WHEN s_nationkey % 2 = 0 THEN 'shore' ELSE 'buoy' END AS kind, CAST(s_suppkey * 997 % 16000 AS DOUBLE) AS sx, CAST(s_suppkey * 613 % 12000 AS DOUBLE) AS sy FROM {supplier})"


@query(f"SELECT station_id, sx, sy FROM {_STATIONS.format(supplier='supplier')} WHERE kind = 'shore' AND sx >= 2000 AND sx <= 9000 AND sy >= 1000 AND sy <= 11000")
def stations_within(spark, sf_dir):
    """FLT-19."""
    return exposure.stations_within(spark.sql("SELECT * FROM " + _STATIONS, supplier=table(spark, sf_dir, "supplier")), "shore", (2000.0, 1000.0, 9000.0, 11000.0)).drop("kind")


_SUPPLIED = "(SELECT s_suppkey AS id, CAST(s_suppkey * 997 % 16000 AS DOUBLE) AS x0, CAST(s_suppkey * 613 % 12000 AS DOUBLE) AS y0, CAST(s_suppkey * 997 % 16000 + 600 AS DOUBLE) AS x1, CAST(s_suppkey * 613 % 12000 + 700 AS DOUBLE) AS y1 FROM {supplier})"


@query(f"WITH b AS (SELECT * FROM {_SUPPLIED.format(supplier='supplier')}) SELECT a.id AS aid, b.id AS bid, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common FROM b a JOIN b ON a.id < b.id WHERE common > 0.01")
def overlapping_polygons(spark, sf_dir):
    """JN-6: pairs of source polygons whose interiors overlap beyond the tolerance."""
    @F.pandas_udf("binary")
    def wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.wkb_of([G.box(*b)]) for b in zip(x0, y0, x1, y1, strict=True)])

    boxes = spark.sql("SELECT * FROM " + _SUPPLIED, supplier=table(spark, sf_dir, "supplier"))
    return rounded(exposure.polygon_overlaps(boxes.select(F.col("id").alias("source_id"), wkb("x0", "y0", "x1", "y1").alias("geometry")), 1000.0), 3)


@query(f"SELECT count(*) AS rows, CAST(0 AS BIGINT) + count(*) FILTER (cell_id <> printf('r%03d_c%03d', row_index, column_index)) AS id, count(*) FILTER (cx1 - cx0 <> 1000 OR cy1 - cy0 <> 1000 OR i % 50 = 3) AS bounds, count(*) FILTER (row_index < 0) AS place, count(*) FILTER (i % 40 = 7) AS repeated FROM ({I.CELLS_DUCK})")
def grid_faults(spark, sf_dir):
    """SRC-11, PUB-6: the contract of a grid whose bounds are off in one cell of fifty and one cell of forty is there twice."""
    c = I.cells(spark, sf_dir).withColumn("cx1", F.when(F.col("i") % 50 == 3, F.col("cx1") + 1).otherwise(F.col("cx1")))
    out = C.grid_faults(c.unionByName(c.where("i % 40 = 7")), 0.0, 0.0, 1000.0)
    twice = c.where("i % 40 = 7").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") % 50 == 3).alias("off"))
    return out.crossJoin(twice).select((F.col("rows") - F.col("n")).alias("rows"), "id", (F.col("bounds") - F.col("off")).alias("bounds"), "place", "repeated")


_PRODUCTION = {
    f"{c}_{g}": f"CAST(i * {m} % {r} AS DOUBLE) / 4 * {f}"
    for m, g, f in ((3, "passenger", 1), (5, "cargo", 2), (11, "tanker", 3))
    for c, r in (("sog_available_km", 16), ("sog_unavailable_km", 9), ("sog_inconsistent_km", 4))
}


def _production_sql(source: str) -> str:
    """Cells with kilometres by speed status for each group; one in seventeen has a total that is off, one in nineteen a mean
    without speeds, one in twenty-three a density of other units."""
    groups = ("passenger", "cargo", "tanker")
    inner = f"SELECT i, cell_id, 1.0 AS water_km2, {', '.join(f'{v} AS {k}' for k, v in _PRODUCTION.items())} FROM {source}"
    total = lambda c: " + ".join(f"{c}_{g}" for g in groups)
    parts = ("sog_available_km", "sog_unavailable_km", "sog_inconsistent_km")
    mid = f"SELECT *, {', '.join(f'{total(c)} AS {c}_all_commercial' for c in parts)} FROM ({inner})"
    out = ["i", "cell_id", "water_km2"]
    for g in (*groups, "all_commercial"):
        km = "(" + " + ".join(f"{c}_{g}" for c in parts) + ")"
        off = " + CASE WHEN i % 17 = 3 THEN 1 ELSE 0 END" if g == "cargo" else ""
        out += [f"{c}_{g}" for c in parts]
        out += [f"{km}{off} AS vessel_km_{g}", f"({km}{off}) * CASE WHEN i % 23 = 5 THEN 1000 ELSE 1 END AS vessel_km_per_water_km2_{g}"]
        out += [f"CASE WHEN sog_available_km_{g} > 0 OR i % 19 = 4 THEN 12.5 END AS reported_mean_{g}", f"CASE WHEN {km}{off} > 0 THEN CAST(i % 34 AS DOUBLE) END AS implied_mean_{g}"]
    return f"SELECT {', '.join(out)} FROM ({mid})"


def _faults_sql() -> str:
    parts, groups = ("sog_available_km", "sog_unavailable_km", "sog_inconsistent_km"), ("passenger", "cargo", "tanker")
    rows = []
    for g in (*groups, "all_commercial"):
        km = " + ".join(f"{c}_{g}" for c in parts)
        wrong = {
            "finite": f"vessel_km_{g} < 0",
            "categories": f"abs(vessel_km_{g} - ({km})) > 1e-6",
            "density": f"abs(vessel_km_per_water_km2_{g} - vessel_km_{g} / water_km2) > 1e-6",
            "reported_mean": f"(reported_mean_{g} IS NULL) <> (sog_available_km_{g} = 0) OR coalesce(reported_mean_{g} > 35, false)",
            "implied_mean": f"(implied_mean_{g} IS NULL) <> (vessel_km_{g} = 0) OR coalesce(implied_mean_{g} > 30, false)",
        }
        rows += [f"SELECT '{g}' AS \"group\", '{r}' AS rule, count(*) FILTER ({x}) AS cells FROM p" for r, x in wrong.items()]
    for c in ("vessel_km", *parts):
        rows.append(f"SELECT 'all_commercial', '{c} of groups', count(*) FILTER (abs({c}_all_commercial - ({' + '.join(f'{c}_{g}' for g in groups)})) > 1e-6) FROM p")
    return f"WITH p AS ({_production_sql(f'({I.CELLS_DUCK})')}) " + " UNION ALL ".join(rows)


@query(_faults_sql())
def production_faults(spark, sf_dir):
    """VAL-13, PUB-7: invariants of production cells, some of which are broken on purpose."""
    return delivery.cell_faults(spark.sql(_production_sql("{c}"), c=I.cells(spark, sf_dir)))


# --- evidence, readiness, accounting -------------------------------------------------------------------------------------


@query(
    " UNION ALL ".join(
        f"SELECT CAST({g} AS DOUBLE) AS gap, CAST({v} AS DOUBLE) AS speed, CAST({m} AS DOUBLE) AS least_length, CASE WHEN {_EXCL.format(gap=g, speed=v)} <> 'retained' THEN {_EXCL.format(gap=g, speed=v)} WHEN {m} IS NOT NULL AND NOT length_m >= {m} THEN 'below_length' ELSE 'retained' END AS outcome, count(*) AS pairs, round(sum(metres) / 1000, 4) AS km FROM ({I.PAIRS_DUCK}) GROUP BY 4"
        for g in (21600.0, 43200.0)
        for v in (15.0, 30.0)
        for m in ("NULL", 100.0)
    )
)
def rule_matrix_lengths(spark, sf_dir):
    """JN-13, AGG-22: rules with a least length."""
    out = period.rule_matrix(pairs(spark, sf_dir), (21600.0, 43200.0), (15.0, 30.0), (None, 100.0))
    return rounded(out.select("gap", "speed", "least_length", "outcome", "pairs", "km"))


_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(next_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(next_lat)) * pow(sin(radians(next_lon - lon) / 2), 2))))"
_DIFF, _RELATIVE = [-100.0, -10.0, 0.0, 10.0, 100.0], [-0.01, -0.001, 0.0, 0.001, 0.01]


def _bins(x, edges):
    low = [f"{x} < {edges[0]}", *[f"{x} >= {a} AND {x} < {b}" for a, b in zip(edges, edges[1:], strict=False)], f"{x} >= {edges[-1]}"]
    return " || ',' || ".join(f"count(*) FILTER ({w})" for w in low)


_DIFFS = f"SELECT grp, m AS measure, CASE m WHEN 'signed' THEN d WHEN 'absolute' THEN abs(d) WHEN 'signed_relative' THEN d / nullif(g, 0) ELSE abs(d / nullif(g, 0)) END AS x, g FROM (SELECT grp, metres - {_HAVERSINE} AS d, {_HAVERSINE} AS g FROM ({I.PAIRS_DUCK})), (SELECT unnest(['signed', 'absolute', 'signed_relative', 'absolute_relative']) AS m)"


def _differences(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("geodesic_m", F.expr(_HAVERSINE))
    return period.distance_differences(p, ["grp"], _DIFF, _RELATIVE)


@query(f"SELECT grp, measure, count(x) AS count, round(min(x), 4) AS minimum, round(max(x), 4) AS maximum, round(avg(x), 4) AS mean, CASE WHEN measure LIKE '%relative' THEN {_bins('x', _RELATIVE)} ELSE {_bins('x', _DIFF)} END AS bins, count(*) FILTER (g = 0) AS undefined FROM ({_DIFFS}) GROUP BY 1, 2")
def distance_differences(spark, sf_dir):
    """AGG-19: projected less spherical lengths over fixed bins, with those below the first and above the last edge."""
    out = _differences(spark, sf_dir).select("grp", "measure", "count", "minimum", "maximum", "mean", F.array_join(F.transform("bin_counts", lambda n: n.cast("string")), ",").alias("bins"), "undefined")
    return rounded(out)


@query(f"SELECT grp, CASE WHEN grp = 'cargo' THEN 2 ELSE 0 END + count(DISTINCT measure) - 4 AS faults FROM ({_DIFFS}) GROUP BY 1")
def evidence_faults(spark, sf_dir):
    """VAL-19: the same document checked, after one count of one group was changed: its bins and its pair of measures fail."""
    d = _differences(spark, sf_dir)
    spoilt = d.withColumn("count", F.when((F.col("grp") == "cargo") & (F.col("measure") == "absolute"), F.col("count") + 1).otherwise(F.col("count")))
    return period.evidence_faults(spoilt, ["grp"])


@query(f"SELECT count(*) AS dates, count(*) FILTER (s.state = 'verified') = count(*) AS ready, sha256(string_agg(CAST(c.utc_date AS VARCHAR) || ':' || coalesce(s.state, 'absent') || ':' || coalesce(s.sha256, ''), '|' ORDER BY c.utc_date)) AS identity FROM ({_CAL}) c LEFT JOIN ({_OLD}) s ON c.utc_date = s.utc_date")
def readiness(spark, sf_dir):
    """VAL-18: whether a period is complete, and the identity of its contents."""
    old, _ = _state(spark, sf_dir)
    return period.readiness(period.calendar(spark, "2024-01-01", "2024-02-29"), old)


@query(f"SELECT c.utc_date, s.sha256, coalesce(s.state, 'absent') AS state, coalesce(s.attempts, 0) AS attempts FROM ({_CAL}) c LEFT JOIN ({_OLD}) s ON c.utc_date = s.utc_date")
def ingest_skeleton(spark, sf_dir):
    """STA-4."""
    days = period.calendar(spark, "2024-01-01", "2024-02-29")
    old, _ = _state(spark, sf_dir)
    return ingest.into_skeleton(days, old.join(days, "utc_date", "left_semi")).withColumn("utc_date", F.col("utc_date").cast("string"))


ORACLES["ingest_skeleton"] = f"SELECT * REPLACE (CAST(utc_date AS VARCHAR) AS utc_date) FROM ({ORACLES['ingest_skeleton']})"


@query("SELECT CAST(d AS VARCHAR) AS utc_date, CAST(claimed AS BIGINT) AS claimed, found, CASE WHEN found IS NULL THEN 'missing' WHEN claimed IS NULL THEN 'unrequested' WHEN claimed <> found THEN 'differs' ELSE '' END AS fault FROM (SELECT coalesce(a.d, b.d) AS d, claimed, found FROM (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (event_type <> 'signup') AS claimed FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 7 <> 0) a FULL JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS found FROM events WHERE dayofweek(ts) <> 0 GROUP BY 1) b ON a.d = b.d)")
def ingest_accounting(spark, sf_dir):
    """STA-9: a manifest's sums by date against rows; some dates are missing, some unrequested, some differ."""
    e = I.events(spark, sf_dir).withColumn("utc_date", F.to_date("ts"))
    manifest = e.where(F.dayofmonth("utc_date") % 7 != 0).groupBy("utc_date").agg(F.count_if(F.col("event_type") != "signup").alias("rows"))
    return ingest.accounting(manifest, e.where(F.dayofweek("utc_date") != 1)).withColumn("utc_date", F.col("utc_date").cast("string"))


@query(f"SELECT grp, round(km, 4) AS km, round(a + u + c, 4) AS parts_km, abs(km - a - u - c) < 1e-6 AS conserved FROM (SELECT grp, sum(metres) / 1000 AS km, {', '.join(f'coalesce(sum(CASE WHEN st = {s!r} THEN metres END), 0) / 1000 AS {n}' for s, n in (('available', 'a'), ('unavailable', 'u'), ('inconsistent', 'c')))} FROM (SELECT *, {_STATUS} AS st FROM ({I.PAIRS_DUCK}) WHERE elapsed_s > 0 AND grp = next_grp) GROUP BY 1)")
def speed_balance(spark, sf_dir):
    """VAL-9: kilometres by speed status against all."""
    some = period.structural(pairs(spark, sf_dir))
    both = period.sog_means(some, ["grp"]).join(some.groupBy("grp").agg((F.sum("metres") / 1000).alias("km")), "grp")
    return rounded(period.speed_balance(both).select("grp", "km", (F.col("available_km") + F.col("unavailable_km") + F.col("inconsistent_km")).alias("parts_km"), "conserved"))


@query(f"SELECT l.grp, count(*) AS pieces, round(sum(piece_m), 3) AS metres FROM {_LINES} l WHERE l.elapsed_s <= 1800 GROUP BY 1")
def selected_pieces(spark, sf_dir):
    """JN-12, SET-3: the pieces of the segments that a rule selects, each of which has some."""
    done, _ = _box_pieces(spark, sf_dir)
    selected = _box_segments(spark, sf_dir).where("elapsed_s <= 1800").select("segment_id")
    return rounded(allocate.pieces_of(done, selected).groupBy("grp").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_m").alias("metres")), 3)


_HALF = "greatest(0, least(greatest(x0 + t0 * (x1 - x0), x0 + t1 * (x1 - x0)), w.cx0 + 500) - least(x0 + t0 * (x1 - x0), x0 + t1 * (x1 - x0))) / nullif(abs((t1 - t0) * (x1 - x0)), 0)"


@query(f"SELECT w.cell_id, count(*) AS pieces, round(sum(CASE WHEN w.i % 9 = 4 THEN piece_m * least(1, {_HALF}) ELSE piece_m END), 2) AS water_m FROM {_LINES} l JOIN (SELECT * FROM ({I.CELLS_DUCK}) WHERE i % 9 >= 2) w USING (row_index, column_index) GROUP BY 1")
def water_shares(spark, sf_dir):
    """SCL-24, JN-4: pieces in cells of which only the western half is water, shortened to it."""
    @F.pandas_udf("binary")
    def west(x0: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.wkb_of([G.box(a, b, a + 500, c)]) for a, b, c in zip(x0, y0, y1, strict=True)])

    done, _ = _box_pieces(spark, sf_dir)
    part = I.cells(spark, sf_dir).where("i % 9 = 4").select("cell_id", west("cx0", "cy0", "cy1").alias("geometry"))
    out = allocate.within_water(done.where("status = 'allocated'"), part)
    return rounded(out.groupBy("cell_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("water_m").alias("water_m")), 2)


_KINDS = ("valid", "invalid", "null", "empty", "non_finite", "invalid", "valid")


@query(f"SELECT CASE event_id % 7 {' '.join(f'WHEN {k} THEN {n!r}' for k, n in enumerate(_KINDS))} END AS defect, count(*) AS rows FROM events GROUP BY 1")
def geometry_defects(spark, sf_dir):
    """VAL-16: rows by what is wrong with their geometry: crossed edges, none, no parts, not finite, no WKB."""
    ring = G.box(0, 0, 2, 1)[0]
    made = [G.wkb_of([[ring]]), G.wkb_of([[ring[[0, 2, 1, 3, 0]] + [[0, 0], [0, 0.5], [0, 0], [0, 0], [0, 0]]]]), None, G.wkb_of([]), G.wkb_of([[ring * float("nan")]]), b"no geometry", G.wkb_of([[ring], [ring + 5]])]

    @F.pandas_udf("string")
    def defect(k: pd.Series) -> pd.Series:
        return pd.Series([G.defects(made[i]) or "valid" for i in k])

    return I.events(spark, sf_dir).select(defect((F.col("event_id") % 7).cast("int")).alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT c_nationkey AS nation, CAST(c_custkey AS VARCHAR) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1 AND c_nationkey < 5")
def bound_rows(spark, sf_dir):
    """PUB-8: the single row that a selection must match, for a few selections."""
    c = table(spark, sf_dir, "customer").where("c_nationkey < 5")
    best = c.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey")).alias("largest"))
    rows = [C.one_row(best, c_nationkey=r["c_nationkey"]) for r in best.select("c_nationkey").collect()]  # five at most
    return spark.createDataFrame([(r["c_nationkey"], str(r["largest"])) for r in rows], "nation long, largest string").select(F.col("nation").cast(c.schema["c_nationkey"].dataType).alias("nation"), "largest")


# --- written and read again ----------------------------------------------------------------------------------------------


@query(ORACLES["cleaning_removals"])
def csv_round_trip(spark, sf_dir):
    """SRC-1, SRC-3, WIN-1, VAL-1: raw rows written as CSV, read under the header contract, labelled and accounted for."""
    path = sinks.scratch(spark)
    I.raw(spark, sf_dir).write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)
    marked = cleaning.labelled(readers.raw_csv(spark, path))
    cleaning.assert_conserved(marked)
    return cleaning.removal_counts(marked)


@query(f"SELECT count(*) AS rows, count(*) FILTER (label = 'kept') AS kept FROM ({_FINAL})")
def strict_round_trip(spark, sf_dir):
    """SRC-2, SRC-7, VAL-10: the same file read strictly, and its rows counted and labelled anew from what was stored."""
    path = sinks.scratch(spark)
    I.raw(spark, sf_dir).write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)
    counted = readers.counted_csv(spark, path)
    C.require(counted, whole=~F.col("malformed"))
    kept = cleaning.labelled(readers.strict_csv(spark, path).na.fill("")).agg(F.count_if(F.col("label") == "kept").alias("kept"))
    return counted.agg(F.count(F.lit(1)).alias("rows")).crossJoin(kept)


@query(f"SELECT CAST(CAST(at AS DATE) AS VARCHAR) AS utc_date, count(*) AS rows, sum(seq) AS seqs FROM ({I.OBS_DUCK}) GROUP BY 1")
def daily_round_trip(spark, sf_dir):
    """SNK-2, SNK-6, SRT-3, SRC-4, SET-5: a folder of CSV a day, read again as one period."""
    path = sinks.scratch(spark)
    rows = I.observations(spark, sf_dir).select(F.to_date("at").cast("string").alias("utc_date"), F.col("seq").cast("string").alias("seq"), "vessel", "grp")
    sinks.daily_csv(rows, path, ["vessel", "seq"])
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("utc_date").cast("string").alias("utc_date")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("seq").cast("long")).alias("seqs"))


@query(f"SELECT count(*) AS rows, count(DISTINCT MMSI) AS vessels, epoch_us(min(at)) AS first_us, epoch_us(max(at)) AS last_us FROM ({_FINAL}) WHERE label = 'kept'")
def cleaned_round_trip(spark, sf_dir):
    """SNK-1, SRT-1, SNK-8, SRC-5, SRC-6: cleaned rows written in their order, their schema held against the contract, written once
    more and compared row by row."""
    from ..schemas import CLEANED

    path = sinks.scratch(spark)
    rows = cleaning.cleaned(cleaning.labelled(I.raw(spark, sf_dir)))
    sinks.parquet(rows, path, ["observed_at_utc", "mmsi", "latitude", "longitude", "vessel_type_code"])
    back = readers.period(spark, [path])
    readers.contract_schema(back, CLEANED)
    again = sinks.verified(back, sinks.scratch(spark))
    return again.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("mmsi").alias("vessels"), F.unix_micros(F.min("observed_at_utc")).alias("first_us"), F.unix_micros(F.max("observed_at_utc")).alias("last_us"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_date, count(*) AS rows, sum(event_id) AS ids FROM events GROUP BY 1")
def stream_round_trip(spark, sf_dir):
    """STR-2: events as a stream of files, appended by batches, twice: the second run finds nothing new."""
    source, sink, state = (sinks.scratch(spark) for _ in range(3))
    I.events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("at")).repartition(4).write.parquet(source)
    for _ in range(2):
        ingest.stream_days(spark, source, "event_id long, at timestamp", sink, state).awaitTermination()
    back = spark.read.parquet(sink)
    return back.groupBy(F.col("utc_date").cast("string").alias("utc_date")).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))
