"""The library's inputs made from the supplied tables, as SQL text that both engines read, and the oracles' shared parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import KNOTS_PER_MPS, project_sql

_TYPE = "CASE event_type WHEN 'view' THEN 70 WHEN 'click' THEN 80 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 72 ELSE 30 END"

#: Observations: one a row of events that is no error; positions are exact binary fractions within the map's extent.
OBS = f"""
    SELECT event_id AS seq, CAST(100000000 + user_id % 97 AS STRING) AS vessel, {{TS}} AS at,
           33 + CAST(event_id * 53 % 2048 AS DOUBLE) / 4096 AS lat, -119 + CAST(event_id * 31 % 2048 AS DOUBLE) / 4096 AS lon,
           {_TYPE} AS type_code, CASE WHEN {_TYPE} >= 80 THEN 'tanker' WHEN {_TYPE} >= 70 THEN 'cargo' ELSE 'passenger' END AS grp,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 240 AS DOUBLE) / 8 END AS sog, CAST(event_id % 400 AS DOUBLE) AS length_m
    FROM {{events}} WHERE event_type <> 'error' AND user_id IS NOT NULL
"""

_ONE = f"""
    SELECT CASE WHEN event_id % 29 = 0 THEN '012345678' ELSE CAST(100000000 + user_id AS STRING) END AS MMSI,
           CASE WHEN event_id % 31 = 0 THEN 'malformed' ELSE {{TEXT}} END AS BaseDateTime,
           CASE WHEN event_id % 37 = 0 THEN 'NaN' ELSE CAST(33 + CAST(event_id * 53 % 2048 AS DOUBLE) / 4096 + {{shift}} AS STRING) END AS LAT,
           CASE WHEN event_id % 23 = 0 THEN '-123.5' ELSE CAST(-119 + CAST(event_id * 31 % 2048 AS DOUBLE) / 4096 AS STRING) END AS LON,
           CASE WHEN event_id % 41 = 0 THEN '102.3' WHEN event_id % 43 = 0 THEN '-1' ELSE CAST(event_id % 30 AS STRING) END AS SOG,
           CASE WHEN event_id % 17 = 0 THEN '360' WHEN event_id % 19 = 0 THEN '400' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 12 = 0 THEN 'n/a' ELSE CAST(event_id % 359 AS STRING) END AS COG,
           CASE WHEN event_id % 13 = 0 THEN '511' WHEN event_id % 47 = 0 THEN '999' WHEN event_id % 14 = 0 THEN '' ELSE CAST(event_id % 359 AS STRING) END AS Heading,
           'NAME' AS VesselName, CAST(event_id AS STRING) AS IMO, 'CALL' AS CallSign,
           CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'abc' WHEN event_id % 61 = 0 THEN '70.5' WHEN event_id % 67 = 0 THEN '0' ELSE CAST({_TYPE} AS STRING) END AS VesselType,
           '0' AS Status, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 300 AS STRING) END AS Length, '10' AS Width, '5' AS Draft, '70' AS Cargo, 'A' AS TransceiverClass
    FROM {{events}} WHERE user_id IS NOT NULL AND {{where}}
"""


def _raw(text: str, events: str) -> str:
    parts = [("0", "true"), ("0", "event_id % 10 = 1"), ("0.25", "event_id % 10 = 2")]
    return " UNION ALL ".join(_ONE.format(TEXT=text, events=events, shift=s, where=w) for s, w in parts)


RAW_DUCK = _raw("strftime(ts, '%Y-%m-%dT%H:%M:%S')", "events")
OBS_DUCK = OBS.format(TS="ts", events="events")
_ORDER = "at, lat, lon, type_code, grp, seq"
_X, _Y = project_sql("lat", "lon")
_X2, _Y2 = project_sql("next_lat", "next_lon")
PAIRS_DUCK = f"""
    SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS metres,
           CASE WHEN elapsed_s > 0 THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / elapsed_s * {KNOTS_PER_MPS!r} END AS knots
    FROM (SELECT *, (epoch_us(next_at) - epoch_us(at)) / 1e6 AS elapsed_s, {_X} AS x0, {_Y} AS y0, {_X2} AS x1, {_Y2} AS y1, CAST(at AS DATE) AS utc_date
          FROM (SELECT *, lead(at) OVER w AS next_at, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon, lead(grp) OVER w AS next_grp, lead(sog) OVER w AS next_sog
                FROM ({OBS_DUCK}) WINDOW w AS (PARTITION BY vessel ORDER BY {_ORDER})) WHERE next_at IS NOT NULL)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS.format(TS="CAST(ts AS TIMESTAMP)", events="{events}"), events=events(spark, sf_dir))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_raw("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "{events}"), events=events(spark, sf_dir))


#: Cells of a grid of 16 columns whose rows grow with the table of customers, each with densities, traffic and areas that
#: are exact fractions. Two cells in nine are no water.
CELLS = """
    SELECT CAST(i AS BIGINT) AS i, {ID} AS cell_id, CAST({I} / 16 AS INT) AS row_index, CAST({I} % 16 AS INT) AS column_index,
           CAST(1000 * ({I} % 16) AS DOUBLE) AS cx0, CAST(1000 * CAST({I} / 16 AS INT) AS DOUBLE) AS cy0, CAST(1000 * ({I} % 16) + 1000 AS DOUBLE) AS cx1, CAST(1000 * CAST({I} / 16 AS INT) + 1000 AS DOUBLE) AS cy1,
           CAST(i * 7 % 13 AS DOUBLE) / 4 AS density, CASE WHEN i % 9 < 2 THEN 0.0 ELSE CAST(i * 5 % 31 AS DOUBLE) / 2 END AS vessel_km
    FROM {SOURCE}
"""
CELLS_DUCK = CELLS.format(ID="printf('r%03d_c%03d', i // 16, i % 16)", SOURCE="(SELECT unnest(range(192 * (1 + (SELECT count(*) FROM customer) // 1500))) AS i)", I="i").replace("i / 16", "i // 16")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(192 * (1 + spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 1500)).withColumnRenamed("id", "i")
    return spark.sql(CELLS.format(ID="format_string('r%03d_c%03d', CAST(i / 16 AS INT), CAST(i % 16 AS INT))", SOURCE="{n}", I="i"), n=n)


def micros(c: str):
    return F.unix_micros(c)
