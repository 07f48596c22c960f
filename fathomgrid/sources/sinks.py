"""Sinks: ordered Parquet, canonical CSV, GeoJSON, atomic publication."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.contracts import canonical_json, same_rows


def parquet(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """SNK-1: ZSTD Parquet in a total order over its files."""
    (rows.orderBy(*order) if order else rows).write.option("compression", "zstd").parquet(path)


def daily_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """SNK-2, SNK-6, SRT-3: quoted CSV with the canonical header, one folder a date (column utc_date), each date sorted by
    whole rows, repeats kept. Dates are dealt to tasks by range, so a task holds few of them and none holds all."""
    dealt = rows.repartitionByRange("utc_date", *order).sortWithinPartitions("utc_date", *order)
    dealt.write.partitionBy("utc_date").option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)


def geo_parquet(rows: DataFrame, path: str, geometry: str, contract: str, crs: str, most: int = 100_000) -> None:
    """SNK-3: one GeoParquet file with its metadata, for tables of cells (their number is checked)."""
    if rows.count() > most:
        raise ValueError(f"more than {most} rows are no table of cells")
    table = rows.toArrow()
    geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"], "crs": crs}}}
    meta = {**(table.schema.metadata or {}), b"geo": canonical_json(geo).encode(), b"contract": contract.encode()}
    pq.write_table(table.replace_schema_metadata(meta), path, compression="zstd", compression_level=9, use_dictionary=False, version="2.6", row_group_size=1024)


def geo_metadata(path: str) -> dict:
    """SRC-6: the geo document and contract of a GeoParquet file's footer."""
    meta = pq.read_schema(path).metadata or {}
    return {"geo": json.loads(meta[b"geo"]), "contract": meta[b"contract"].decode()}


def features(rows: DataFrame, geometry: str, id_col: str, properties: list[str]) -> DataFrame:
    """SNK-4: one JSON feature a row, rings oriented as RFC 7946 wants, on the executors."""
    @F.pandas_udf("string")
    def coordinates(g: pd.Series) -> pd.Series:
        out = []
        for w in g:
            parts = [[r.tolist() for r in G.oriented(p)] for p in G.polygons_of(bytes(w))]
            kind = "Polygon" if len(parts) == 1 else "MultiPolygon"
            out.append(json.dumps({"type": kind, "coordinates": parts[0] if len(parts) == 1 else parts}))
        return pd.Series(out)

    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col(id_col).cast("string"), F.lit('","properties":'), props, F.lit(',"geometry":'), coordinates(geometry), F.lit("}"))
    return rows.select(F.col(id_col), text.alias("feature"))


def feature_collection(rows: DataFrame, most: int = 100_000) -> str:
    """The whole collection as text, features in order of their ids; for tables of cells, their number is checked."""
    found = rows.orderBy(rows.columns[0]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} features")
    return '{"type":"FeatureCollection","features":[' + ",".join(r["feature"] for r in found) + "]}"


def published(target: str, build: Callable[[str], None], overwrite: bool = False, marker: str = ".bundle") -> None:
    """SNK-7: build a bundle in a sibling folder, then put it in place by renaming; an old bundle is only replaced if it
    carries the marker, and comes back if the exchange fails. For folders of a POSIX file system."""
    temp, old = f"{target}.{uuid.uuid4().hex}.tmp", f"{target}.{uuid.uuid4().hex}.old"
    if os.path.exists(target) and not (overwrite and os.path.exists(os.path.join(target, marker))):
        raise FileExistsError(target)
    os.makedirs(temp)
    try:
        build(temp)
        open(os.path.join(temp, marker), "w").close()
        if os.path.exists(target):
            os.rename(target, old)
        try:
            os.rename(temp, target)
        except OSError:
            if os.path.exists(old):
                os.rename(old, target)
            raise
    finally:
        shutil.rmtree(temp, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)


def verified(rows: DataFrame, path: str) -> DataFrame:
    """SNK-8: rows written, read again and compared: names, types and metadata of columns, and the rows."""
    rows.write.parquet(path)
    again = rows.sparkSession.read.parquet(path)
    facts = lambda df: [(f.name, f.dataType.simpleString(), f.metadata) for f in df.schema.fields]
    if facts(rows) != facts(again) or not same_rows(rows, again):
        raise ValueError(f"{path} does not hold what was written")
    return again


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, in the warehouse where that is unset, and in a temporary folder
    only where all of Spark runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="fathomgrid-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
