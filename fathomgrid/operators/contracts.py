"""Validation, identities, manifests and publication checks."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """VAL-16, VAL-17, FLT-21, PUB-6, PUB-7, SRC-11: how many rows break each named rule, in one pass; null counts as broken."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])


def require(rows: DataFrame, **rules: Column) -> DataFrame:
    """rows itself, or an error that names the rules broken."""
    found = {k: v for k, v in violations(rows, **rules).first().asDict().items() if k != "rows" and v}
    if found:
        raise ValueError(f"rules broken: {found}")
    return rows


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """SNK-8, PUB-9: whether two tables hold the same rows, repeats counted."""
    return a.columns == b.columns and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def close_tables(a: DataFrame, b: DataFrame, key: str, numbers: list[str], rel: float = 1e-12, absolute: float = 1e-9) -> bool:
    """VAL-10, VAL-21: the same keys, and numbers equal within tolerance."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    bad = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    for n in numbers:
        x, y = F.col(f"a.{n}"), F.col(f"b.{n}")
        equal = F.abs(x - y) <= F.greatest(rel * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
        bad = bad | ~F.coalesce(equal, x.isNull() & y.isNull())
    return not both.where(bad).limit(1).count()


def deep_equal(a: Any, b: Any, rel: float = 1e-9, absolute: float = 1e-9, at: str = "") -> list[str]:
    """VAL-11: where two JSON-like documents differ; numbers within tolerance agree, types must match."""
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return [] if type(a) is type(b) and a == b else [at or "/"]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return [] if math.isclose(a, b, rel_tol=rel, abs_tol=absolute) else [at or "/"]
    if isinstance(a, dict) and isinstance(b, dict):
        return [f"{at}/{k}" for k in a.keys() ^ b.keys()] + [x for k in a.keys() & b.keys() for x in deep_equal(a[k], b[k], rel, absolute, f"{at}/{k}")]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for k, (p, q) in enumerate(zip(a, b, strict=True)) for x in deep_equal(p, q, rel, absolute, f"{at}/{k}")]
    return [at or "/"]


def grid_faults(cells: DataFrame, x_min: float, y_min: float, cell: float) -> DataFrame:
    """SRC-11, PUB-6: how many cells of a grid (cell_id, row_index, column_index, cx0, cy0, cx1, cy1) break each part of its
    contract: ids that follow from row and column and are unique, bounds that follow from them too, finite numbers."""
    r, c = F.col("row_index"), F.col("column_index")
    bounds = (F.col("cx0") == x_min + c * cell) & (F.col("cy0") == y_min + r * cell) & (F.col("cx1") == x_min + (c + 1) * cell) & (F.col("cy1") == y_min + (r + 1) * cell)
    counts = violations(cells, id=F.col("cell_id") == F.format_string("r%03d_c%03d", r.cast("int"), c.cast("int")), bounds=bounds, place=(r >= 0) & (c >= 0))
    twice = cells.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return counts.crossJoin(twice)  # one row each


def canonical_json(document: Any) -> str:
    """SNK-5: keys sorted, no spaces, no NaN."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def identity(prefix: str, document: Any) -> str:
    """SCL-17: an id from a document's content; leave clocks, paths and resources out of it."""
    return prefix + hashlib.sha256(canonical_json(document).encode()).hexdigest()[:24]


def result_document(summary: DataFrame, keep: list[str], **facts: Any) -> dict:
    """PUB-1, PUB-3, PUB-4: an allowlisted document of a small summary table's rows, with its content id."""
    rows = [{k: r[k] for k in keep} for r in summary.select(*keep).orderBy(*keep).limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a summary has at most 10,000 rows")
    document = {**facts, "rows": rows}
    return {**document, "id": identity("result-", document)}


def one_row(rows: DataFrame, **where: Any):
    """PUB-8: the single row that matches, or an error."""
    for k, v in where.items():
        rows = rows.where(F.col(k) == v)
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} rows match {where}, one is needed")
    return found[0]


def sorted_slices(rows: DataFrame, order: list[str], slice_col: str) -> DataFrame:
    """STA-11: (slice, rows, inversions) of stored slices, each of which should hold one value of ``slice_col`` in order. The
    row's place in its slice is the column ``position``; parts of a slice check themselves, ends meet through one row a part."""
    key = F.struct(*order)
    part = rows.withColumns({"slice": F.col(slice_col), "part": F.floor(F.col("position") / 100_000)})
    w = Window.partitionBy("slice", "part").orderBy("position")
    inner = part.withColumn("before", F.lag(key).over(w)).groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") > key).alias("within"))
    ends = part.groupBy("slice", "part").agg(F.min_by(key, "position").alias("first"), F.max_by(key, "position").alias("last"))
    edge = ends.withColumn("before", F.lag("last").over(Window.partitionBy("slice").orderBy("part"))).groupBy("slice").agg(F.count_if(F.col("before") > F.col("first")).alias("between"))
    return inner.join(edge, "slice").select("slice", "rows", (F.col("within") + F.col("between")).alias("inversions"))
