"""The grid, and the allocation of points and segments to its cells.

Cells are found by arithmetic, never by a spatial index: a point's row and column are a division, a segment is cut
where it crosses grid lines. Pieces then meet the retained cells in an equi-join on (row, column). Only cells that are
partly water need the geometry of their water, in a vectorised function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import geometry as G
from ..functions import scalars as S

# The grid's origin, shape and cell size in metres.
X_MIN, Y_MIN, CELL_M, COLUMNS, ROWS = -190_000, -670_000, 5_000, 95, 68


def grid(spark: SparkSession, columns: int = COLUMNS, rows: int = ROWS, x_min: int = X_MIN, y_min: int = Y_MIN, cell: int = CELL_M) -> DataFrame:
    """SRT-4: all nominal cells (cell_id, row_index, column_index, bounds), in row-major order of their numbers."""
    n = spark.range(rows * columns)
    r, c = (F.col("id") / columns).cast("int"), (F.col("id") % columns).cast("int")
    return n.select(
        S.cell_id(r, c).alias("cell_id"), r.alias("row_index"), c.alias("column_index"), (x_min + c * cell).alias("x_min_m"), (y_min + r * cell).alias("y_min_m"), (x_min + (c + 1) * cell).alias("x_max_m"),
        (y_min + (r + 1) * cell).alias("y_max_m"),
    )


def row_column(x: Column, y: Column, x_min: float = X_MIN, y_min: float = Y_MIN, cell: float = CELL_M) -> tuple[Column, Column]:
    return F.floor((y - y_min) / cell).cast("int"), F.floor((x - x_min) / cell).cast("int")


def point_cells(points: DataFrame, cells: DataFrame, x: str = "x", y: str = "y", x_min: float = X_MIN, y_min: float = Y_MIN, cell: float = CELL_M) -> DataFrame:
    """JN-3: points with ``status`` (one, none, ambiguous) and the cell_id of those in exactly one.

    Cells are closed boxes: a point on a grid line is looked for on both its sides, and is ambiguous if more than one
    cell covers it. ``points`` needs a column ``point_id`` that tells its rows apart.
    """
    r, c = row_column(F.col(x), F.col(y), x_min, y_min, cell)
    on_y, on_x = (F.col(y) - y_min) % cell == 0, (F.col(x) - x_min) % cell == 0
    rows = F.when(on_y, F.array(r - 1, r)).otherwise(F.array(r))
    cols = F.when(on_x, F.array(c - 1, c)).otherwise(F.array(c))
    near = points.withColumn("row_index", F.explode(rows)).withColumn("column_index", F.explode(cols))
    hits = near.join(cells.select("row_index", "column_index", "cell_id"), ["row_index", "column_index"])
    found = hits.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("cell_id"))
    out = points.join(found, "point_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.withColumn("status", F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous")).withColumn("cell_id", F.when(n == 1, F.col("cell_id"))).drop("n")


def _crossings(a: Column, b: Column, origin: float, cell: float) -> Column:
    """Parameters in (0, 1) at which a..b crosses grid lines of one axis."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    first, last = F.floor((lo - origin) / cell) + 1, F.ceil((hi - origin) / cell) - 1
    lines = F.when((a != b) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (origin + k * cell - a) / (b - a))


def pieces(segments: DataFrame, x_min: float = X_MIN, y_min: float = Y_MIN, cell: float = CELL_M) -> DataFrame:
    """JN-4, SRT-8, SCL-30: segments (segment_id, x0, y0, x1, y1, metres, elapsed_s, ...) cut at grid lines into pieces with
    piece order, length and time by share of length, row and column, and whether a piece lies along a grid line.

    The cost is rows and columns crossed, not the cells of a bounding box. A segment without length is one piece.
    """
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _crossings(F.col("x0"), F.col("x1"), x_min, cell), _crossings(F.col("y0"), F.col("y1"), y_min, cell))))
    n = F.size("cuts") - 1
    # spans are never empty; the outer form keeps the optimizer from filtering on them with a second evaluation
    spans = F.arrays_zip(F.slice("cuts", 1, n), F.slice("cuts", 2, n))
    each = segments.withColumn("cuts", cuts).select("*", F.posexplode_outer(spans).alias("piece", "span")).drop("cuts")
    t0, t1 = F.col("span")["0"], F.col("span")["1"]
    mx, my = F.col("x0") + (t0 + t1) / 2 * (F.col("x1") - F.col("x0")), F.col("y0") + (t0 + t1) / 2 * (F.col("y1") - F.col("y0"))
    r, c = row_column(mx, my, x_min, y_min, cell)
    along = ((F.col("x0") == F.col("x1")) & ((F.col("x0") - x_min) % cell == 0)) | ((F.col("y0") == F.col("y1")) & ((F.col("y0") - y_min) % cell == 0))
    return each.withColumns({"row_index": r, "column_index": c, "piece_m": F.col("metres") * (t1 - t0), "piece_s": F.col("elapsed_s") * (t1 - t0), "along_line": along, "t0": t0, "t1": t1}).drop("span")


def allocated(cut: DataFrame, cells: DataFrame) -> DataFrame:
    """Pieces with cell_id and ``status``: allocated, outside (no retained cell) or ambiguous (along a line between two
    retained cells: both cover it, so neither gets it)."""
    known = cells.select("row_index", "column_index", "cell_id")
    other = known.select(F.col("row_index").alias("r2"), F.col("column_index").alias("c2"), F.col("cell_id").alias("cell_2"))
    upright = F.col("x0") == F.col("x1")
    side = cut.withColumn("r2", F.when(F.col("along_line"), F.col("row_index") - (~upright).cast("int"))).withColumn("c2", F.when(F.col("along_line"), F.col("column_index") - upright.cast("int")))
    both = side.join(known, ["row_index", "column_index"], "left").join(other, ["r2", "c2"], "left")
    status = F.when(F.col("cell_id").isNotNull() & F.col("cell_2").isNotNull(), "ambiguous").when(F.coalesce("cell_id", "cell_2").isNull(), "outside").otherwise("allocated")
    return both.withColumn("status", status).withColumn("cell_id", F.when(status == "allocated", F.coalesce("cell_id", "cell_2"))).drop("cell_2", "r2", "c2")


def within_water(done: DataFrame, water: DataFrame) -> DataFrame:
    """Pieces of partly-water cells shortened to their share within the cell's water: (cell_id, geometry) of such cells.

    Whole-water cells never meet the function; the rest is outside.
    """

    @F.pandas_udf("double")
    def share(g: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([G.segment_share(G.polygons_of(bytes(w)), *p) for w, *p in zip(g, x0, y0, x1, y1, strict=True)])

    both = done.join(water, "cell_id", "left")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    whole = both.where("geometry is null").withColumn("share", F.lit(1.0))
    part = both.where("geometry is not null").withColumn("share", share("geometry", at("x0", "x1", "t0"), at("y0", "y1", "t0"), at("x0", "x1", "t1"), at("y0", "y1", "t1")))
    return whole.unionByName(part).withColumn("water_m", F.col("piece_m") * F.col("share")).drop("geometry")


def cell_totals(done: DataFrame, cells: DataFrame, group: str = "grp", key: str = "vessel") -> DataFrame:
    """AGG-14, AGG-15, JN-15: for every retained cell, zeros included: km and distinct vessels by group and over all
    groups; the latter's vessels are counted anew, since they are not the groups' sum."""
    kept = done.where("status = 'allocated'")
    groups = ["passenger", "cargo", "tanker"]
    wide = kept.groupBy("cell_id").agg(
        *[(F.sum(F.when(F.col(group) == g, F.col("piece_m"))) / 1000).alias(f"vessel_km_{g}") for g in groups],
        (F.sum("piece_m") / 1000).alias("vessel_km_all"),
        *[F.count_distinct(F.when(F.col(group) == g, F.col(key))).alias(f"vessels_{g}") for g in groups],
        F.count_distinct(key).alias("vessels_all"),
        F.count_distinct(key, "utc_date").alias("vessel_dates_all"),
    )
    out = cells.select("cell_id", "row_index", "column_index").join(wide, "cell_id", "left")
    return out.na.fill(0)


def balance(segments: DataFrame, done: DataFrame, group: str = "grp") -> DataFrame:
    """VAL-2, AGG-31: metres of segments, and of their pieces by status, for each group, and whether they agree
    within max(1e-6, 1e-12 of the whole)."""
    whole = segments.groupBy(group).agg(A.exact_sum(F.col("metres")).alias("parent_m"), A.exact_sum(F.col("elapsed_s")).alias("parent_s"))
    status = lambda s: F.coalesce(A.exact_sum(F.when(F.col("status") == s, F.col("piece_m"))), F.lit(0.0)).alias(f"{s}_m")
    parts = done.groupBy(group).agg(status("allocated"), status("outside"), status("ambiguous"), A.exact_sum(F.col("piece_s")).alias("pieces_s"))
    both = whole.join(parts, group)
    off = F.abs(F.col("parent_m") - F.col("allocated_m") - F.col("outside_m") - F.col("ambiguous_m"))
    off_s = F.abs(F.col("parent_s") - F.col("pieces_s"))
    within = lambda d, of: d <= F.greatest(F.lit(1e-6), 1e-12 * F.col(of))
    return both.withColumns({"conserved": within(off, "parent_m"), "time_conserved": within(off_s, "parent_s")})


def cells_reconcile(done: DataFrame, totals: DataFrame) -> DataFrame:
    """VAL-3: (cells, off): the cells' km against the metres allocated to each, and how many are off by more than
    max(1e-9 km, 1e-12 of the cell's)."""
    own = done.where("status = 'allocated'").groupBy("cell_id").agg((A.exact_sum(F.col("piece_m")) / 1000).alias("own_km"))
    both = totals.join(own, "cell_id", "full_outer")
    off = ~F.coalesce(F.abs(F.col("vessel_km_all") - F.coalesce("own_km", F.lit(0.0))) <= F.greatest(F.lit(1e-9), 1e-12 * F.col("vessel_km_all")), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(off).alias("off"))


def segment_times(segments: DataFrame, done: DataFrame) -> DataFrame:
    """VAL-4: (segments, off, total_s, pieces_s): each segment's seconds against those of its pieces, and both in all."""
    own = done.groupBy("segment_id").agg(F.sum("piece_s").alias("s"))
    both = segments.select("segment_id", "elapsed_s").join(own, "segment_id", "left")
    off = ~F.coalesce(F.abs(F.col("elapsed_s") - F.col("s")) <= F.greatest(F.lit(1e-6), 1e-12 * F.col("elapsed_s")), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("segments"), F.count_if(off).alias("off"), A.exact_sum(F.col("elapsed_s")).alias("total_s"), A.exact_sum(F.col("s")).alias("pieces_s"))


def geodesic_column(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """SCL-9 as a column."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(G.geodesic(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float), d.to_numpy(float)))

    return run(lat1, lon1, lat2, lon2)


def pieces_of(done: DataFrame, selected: DataFrame) -> DataFrame:
    """JN-12, SET-3: the pieces of selected segments; raises if a selected segment has none."""
    lacking = selected.select("segment_id").join(done.select("segment_id"), "segment_id", "left_anti").limit(1).count()
    if lacking:
        raise ValueError("a selected segment has no pieces")
    return done.join(selected.select("segment_id"), "segment_id", "left_semi")


