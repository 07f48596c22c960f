"""Sources: raw CSV with a header contract, period Parquet, containers, vector layers, documents."""

from __future__ import annotations

import hashlib
import io
import json
import tomllib
import urllib.request
import zipfile
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..schemas import RAW, RAW_COLUMNS


class HeaderError(ValueError):
    """A header that is not the contract's."""


def check_header(names: Sequence[str], expected: Sequence[str] = RAW_COLUMNS) -> None:
    """SRC-3: exact names in exact order, with what is missing or unexpected."""
    if list(names) != list(expected):
        missing, extra = [c for c in expected if c not in names], [c for c in names if c not in expected]
        raise HeaderError(f"missing {missing}, unexpected {extra}" if missing or extra else "columns are in another order")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The first line's fields, read through Spark so that any store will do."""
    first = spark.read.text(path).limit(1).select(F.regexp_replace("value", "^﻿", "")).first()
    if first is None:
        raise HeaderError("the file is empty")
    return [x.strip('"') for x in first[0].rstrip("\r").split(",")]


def raw_csv(spark: SparkSession, path: str | list[str], expected: Sequence[str] = RAW_COLUMNS, multi_line: bool = False) -> DataFrame:
    """SRC-1: all columns as text, after the header contract holds for every path.

    Files are split between tasks by lines, so a line break within quotes is an error that says so; with ``multi_line`` such
    files are read whole, a file a task.
    """
    for p in [path] if isinstance(path, str) else path:
        check_header(header_of(spark, p), expected)
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if spark.read.text(path).where(quotes % 2 == 1).limit(1).count():
            raise HeaderError("a line break within quotes: read with multi_line")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in expected])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, quote='"', escape='"', multiLine=multi_line, emptyValue="", nullValue=None)


def strict_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """SRC-2: given columns, and an error for a row that does not fit."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, enforceSchema=False, quote='"', escape='"')


def counted_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """SRC-7: rows with a column ``malformed`` for those whose field count is not the header's."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path, header=True, enforceSchema=False, quote='"', escape='"')
    # a query of this column alone still has to read another one, or Spark refuses it
    never = F.coalesce(F.length(F.col(schema.fieldNames()[0])) < 0, F.lit(False))
    return rows.withColumn("malformed", F.col("_bad").isNotNull() | never).drop("_bad")


def period(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SRC-4, SET-5: many daily files as one relation, each of the same schema."""
    return spark.read.parquet(*paths)


def contract_schema(df: DataFrame, expected: T.StructType) -> None:
    """SRC-6, VAL-17: names and types in order, before any data is read."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    if have != want:
        raise ValueError(f"schema differs: {sorted(set(have) ^ set(want))}")


def zip_csv(data: bytes) -> tuple[str, bytes]:
    """SRC-8, SNK-9: the one CSV of an archive, every member read to its end so that its CRC is checked; names that leave
    the archive's folder are refused."""
    if data[:4] != b"PK\x03\x04":
        raise ValueError("not a ZIP archive")
    found: list[tuple[str, bytes]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            parts = info.filename.replace("\\", "/").split("/")
            if info.filename.startswith("/") or ".." in parts or ":" in parts[0]:
                raise ValueError(f"unsafe member name {info.filename!r}")
            body = b"" if info.is_dir() else z.read(info)
            if info.filename.lower().endswith(".csv"):
                found.append((info.filename, body))
    if len(found) != 1:
        raise ValueError(f"{len(found)} CSV members, one is needed")
    return found[0]


def zip_prefix(data: bytes) -> bytes:
    """SRC-9: what can be inflated of the first member of a cut archive, from its local header on."""
    if len(data) < 30 or data[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    method = int.from_bytes(data[8:10], "little")
    at = 30 + int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")
    return data[at:] if method == 0 else zlib.decompressobj(-15).decompress(data[at:])


def containers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8 over many files: (path, member, text lines' count, sha256, error) of each container, on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def open_all(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                digest = hashlib.sha256(c).hexdigest()
                try:
                    name, body = zip_csv(c) if c[:4] == b"PK\x03\x04" else (p.rsplit("/", 1)[-1], c)
                    rows.append((p, name, body.count(b"\n"), digest, None))
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((p, None, None, digest, str(e)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "member", "lines", "sha256", "error"])

    return files.mapInArrow(open_all, "path string, member string, lines long, sha256 string, error string")


def geojson(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """SRC-10: (feature_id, properties JSON, geometry WKB) of the polygons of FeatureCollections, each file read on an executor.
    A layer that names another reference system than ``crs``, and a feature that is no polygon, are errors."""
    files = spark.read.text(path, wholetext=True)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            for text in b.column("value").to_pylist():
                document = json.loads(text)
                named = document.get("crs", {}).get("properties", {}).get("name")
                if crs and named and crs not in named:
                    raise ValueError(f"the layer is in {named}")
                for k, f in enumerate(document["features"]):
                    g = f["geometry"]
                    parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else None
                    if parts is None:
                        raise ValueError(f"feature {k} is a {g['type']}")
                    polygons = [[np.array(r, float)[:, :2] for r in p] for p in parts]
                    rows.append((str(f.get("id", k)), json.dumps(f.get("properties") or {}, sort_keys=True), G.wkb_of(polygons)))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["feature_id", "properties", "geometry"])

    return files.mapInArrow(read, "feature_id string, properties string, geometry binary")


def fetched_geojson(url: str, sha256: str, most: int = 64 << 20, timeout: float = 30.0) -> dict:
    """SRC-15: a FeatureCollection from an address, if its bytes are those that the digest names; no more than ``most`` are read."""
    with urllib.request.urlopen(url, timeout=timeout) as r:
        body = r.read(most + 1)
    if len(body) > most:
        raise ValueError(f"more than {most} bytes at {url}")
    if hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError(f"{url} does not hold what its digest names")
    document = json.loads(body)
    if not isinstance(document, dict) or document.get("type") != "FeatureCollection" or not isinstance(document.get("features"), list):
        raise ValueError(f"{url} is no FeatureCollection")
    return document


def json_document(spark: SparkSession, path: str) -> dict:
    """SRC-12."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def toml_document(spark: SparkSession, path: str) -> dict:
    """SRC-13."""
    return tomllib.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def markdown_rows(text: str) -> list[dict[str, str]]:
    """SRC-14: the rows of the first pipe table of a text."""
    table = [line.strip().strip("|").split("|") for line in text.splitlines() if line.strip().startswith("|")]
    cells = [[c.strip() for c in row] for row in table]
    return [dict(zip(cells[0], row, strict=True)) for row in cells[2:]] if len(cells) > 2 else []
