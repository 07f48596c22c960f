"""Table schemas and fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a raw position file, in order.
RAW_COLUMNS = [
    "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "IMO", "CallSign",
    "VesselType", "Status", "Length", "Width", "Draft", "Cargo", "TransceiverClass",
]
GROUPS = ["passenger", "cargo", "tanker"]
ALL_GROUPS = "all_commercial"

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
CLEANED = T.StructType(
    [
        T.StructField("mmsi", T.StringType(), False),
        T.StructField("observed_at_utc", T.TimestampType(), False),
        T.StructField("latitude", T.DoubleType(), False),
        T.StructField("longitude", T.DoubleType(), False),
        T.StructField("sog_knots", T.DoubleType()),
        T.StructField("cog_degrees", T.DoubleType()),
        T.StructField("heading_degrees", T.DoubleType()),
        T.StructField("vessel_type_code", T.ShortType(), False),
        T.StructField("vessel_type_group", T.StringType(), False),
        T.StructField("length_m", T.DoubleType()),
    ]
)
