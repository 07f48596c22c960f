"""Overlap index: overlays, intensities, integration, thresholds, coarsening, comparisons."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates as A
from ..functions import geometry as G

PERCENTILES = (0.8, 0.9, 0.95)
METHODS = ("product", "log")


def strict_join(left: DataFrame, right: DataFrame, key: str, shared: Sequence[str], rel: float = 1e-9) -> DataFrame:
    """JN-1: one row of each side for every key, shared columns equal; anything else is an error, not a smaller result."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differ = F.lit(False)
    for c in shared:
        differ = differ | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    bad = both.agg(
        F.count_if(F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).alias("unmatched"), F.count_if(F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull() & differ).alias("different"),
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.coalesce(f"a.{key}", f"b.{key}")).alias("keys"),
    ).first()
    if bad["unmatched"] or bad["different"] or bad["rows"] != bad["keys"]:
        raise ValueError(f"not one to one: {bad.asDict()}")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select("a.*", *[F.col(f"b.{c}") for c in right.columns if c != key and c not in shared])


def box_overlap(a: str, b: str):
    """The common area of two upright boxes as columns a_x0.. and b_x0..: closed form, no geometry function."""
    side = lambda p: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{p}1"), F.col(f"{b}{p}1")) - F.greatest(F.col(f"{a}{p}0"), F.col(f"{b}{p}0")))
    return side("x") * side("y")


def transfer_boxes(sources: DataFrame, cells: DataFrame, cell: float, x_min: float = 0.0, y_min: float = 0.0) -> DataFrame:
    """JN-5: densities of upright boxes (source_id, sx0, sy0, sx1, sy1, density) onto cells by common area: (cell_id,
    abundance, covered_km2, mean density of the covered part).

    A box is exploded into the rows and columns it spans, which meet the cells in an equi-join.
    """
    span = lambda lo, hi, o: F.sequence(F.floor((F.col(lo) - o) / cell).cast("int"), (F.ceil((F.col(hi) - o) / cell) - 1).cast("int"))
    keyed = sources.where("sx1 > sx0 and sy1 > sy0").withColumn("row_index", F.explode(span("sy0", "sy1", y_min))).withColumn("column_index", F.explode(span("sx0", "sx1", x_min)))
    met = keyed.join(cells, ["row_index", "column_index"]).withColumn("common", box_overlap("s", "c"))
    sums = met.where("common > 0").groupBy("cell_id").agg((F.sum(F.col("common") * F.col("density")) / 1e6).alias("abundance"), (F.sum("common") / 1e6).alias("covered_km2"))
    return sums.withColumn("density", F.col("abundance") / F.col("covered_km2"))


def transfer_polygons(sources: DataFrame, cells: DataFrame, cell: float, x_min: float, y_min: float) -> DataFrame:
    """JN-5 for any polygons: sources (source_id, density, geometry WKB), cells with closed bounds cx0.. and their water
    as WKB or null (all of it). Candidates come from bounding boxes, areas from clipping in a vectorised function.

    Sources are copied to the cells that they span, so that side is far larger than its tables: the join is merged and nothing of
    it is broadcast, whatever sizes a plan expects.
    """

    @F.pandas_udf("x0 double, y0 double, x1 double, y1 double")
    def box_of(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(G.all_bounds([bytes(w) for w in g]), columns=["x0", "y0", "x1", "y1"])

    @F.pandas_udf("double")
    def common(g: pd.Series, water: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        boxes, whole = np.stack([x0, y0, x1, y1], 1).astype(float), water.isna().to_numpy()
        out = np.zeros(len(g))
        out[whole] = G.clipped_areas([bytes(a) for a in g[whole]], boxes[whole])
        for i in np.flatnonzero(~whole):
            out[i] = G.overlap_area(G.clip(G.polygons_of(bytes(g.iloc[i])), *boxes[i]), G.polygons_of(bytes(water.iloc[i])))
        return pd.Series(out)

    boxed = sources.withColumn("b", box_of("geometry"))
    span = lambda lo, hi, o: F.sequence(F.floor((F.col(lo) - o) / cell).cast("int"), F.floor((F.col(hi) - o) / cell).cast("int"))
    keyed = boxed.withColumn("row_index", F.explode(span("b.y0", "b.y1", y_min))).withColumn("column_index", F.explode(span("b.x0", "b.x1", x_min)))
    met = keyed.join(cells.hint("merge"), ["row_index", "column_index"]).withColumn("common", common("geometry", "water", "cx0", "cy0", "cx1", "cy1"))
    sums = met.where("common > 0").groupBy("cell_id").agg((F.sum(F.col("common") * F.col("density")) / 1e6).alias("abundance"), (F.sum("common") / 1e6).alias("covered_km2"))
    return sums.withColumn("density", F.col("abundance") / F.col("covered_km2"))


def overlaps(boxes: DataFrame, bucket: float, tolerance: float = 1.0) -> DataFrame:
    """JN-6, FLT-18: pairs of boxes (i < j) that overlap by more than a tolerance of 0 or more, through buckets of their extents;
    each pair is kept in the bucket of its common part's lower corner only. Boxes with null or NaN bounds overlap nothing.

    A bucket's boxes come by their lower sides and meet those that still reach that far, in blocks, so the work is near the
    number of pairs and memory is bounded by the boxes that one line crosses.
    """
    return _swept(boxes.select("id", "x0", "y0", "x1", "y1", F.lit(None).cast("binary").alias("geometry")), bucket, tolerance)


def _swept(shapes: DataFrame, bucket: float, tolerance: float) -> DataFrame:
    """Pairs (aid, bid, common) of shapes (id, bounds x0.., geometry WKB, or null if the bounds are all of it)."""
    low = lambda c: F.floor(F.col(c) / bucket).cast("int")
    sides = ("x0", "y0", "x1", "y1")
    known = shapes.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in sides}).dropna(subset=["id", *sides])
    keyed = known.withColumn("kx", F.explode(F.sequence(low("x0"), low("x1")))).withColumn("ky", F.explode(F.sequence(low("y0"), low("y1"))))
    keyed = keyed.withColumns({"lx": low("x0") == F.col("kx"), "ly": low("y0") == F.col("ky")})
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that few input rows are not put together: pairs are many
    lined = keyed.repartition(parts, "kx", "ky").sortWithinPartitions("kx", "ky", "y0")
    kind = shapes.schema["id"].dataType
    schema = T.StructType([T.StructField("aid", kind), T.StructField("bid", kind), T.StructField("common", T.DoubleType())])

    def run(batches):
        key, held = None, None  # the bucket at hand, and its rows that reach the line
        waiting, n = [], 0
        for batch in batches:
            kx, ky, y0 = (batch.column(c).to_numpy() for c in ("kx", "ky", "y0"))
            cuts = np.flatnonzero((kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(kx)] if len(kx) else []):
                part = batch.slice(a, b - a)
                if key != (kx[a], ky[a]):
                    key, held = (kx[a], ky[a]), None
                rows = part if held is None else pa.concat_batches([held, part])
                if rows.num_rows > 1:
                    for found in _crossed(rows, rows.num_rows - part.num_rows, tolerance):
                        waiting.append(found)
                        n += found.num_rows
                        if n >= 1 << 16:
                            yield pa.concat_batches(waiting)
                            waiting, n = [], 0
                held = rows.filter(pa.array(rows.column("y1").to_numpy() > y0[b - 1]))
        if waiting:
            yield pa.concat_batches(waiting)

    return lined.mapInArrow(run, schema)


def _crossed(rows: pa.RecordBatch, first: int, tolerance: float, cells: int = 1 << 17):
    """The pairs of a bucket's rows, by lower side, of which those from ``first`` on are new. The later of a pair has the lower side
    of the common part, so it must have it in this bucket; blocks of new rows by the rows before them hold about ``cells``."""
    ids, geometry = rows.column("id"), rows.column("geometry")
    x0, y0, x1, y1 = (rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
    lx, ly = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lx", "ly"))
    shaped = geometry.is_valid().to_numpy(zero_copy_only=False)
    parsed = functools.cache(lambda k: G.polygons_of(geometry[k].as_py()))
    bound = lambda k: (x0[k], y0[k], x1[k], y1[k])

    def shared(i: int, j: int) -> float:
        if shaped[i] and shaped[j]:
            return G.common_area(parsed(i), parsed(j))
        return G.area(G.clip(parsed(i), *bound(j)) if shaped[i] else G.clip(parsed(j), *bound(i)))

    new, at = np.flatnonzero(ly[first:]) + first, 0
    while at < len(new):
        before = np.flatnonzero(y1[: new[at]] > y0[new[at]])
        block = new[at : at + max(1, min(256, cells // (len(before) + 1)))]
        at += len(block)
        live = np.concatenate([before, np.arange(new[at - len(block)], block[-1])])
        own = block[:, None]
        common = np.minimum(x1[own], x1[live])
        common -= np.maximum(x0[own], x0[live])
        np.maximum(common, 0.0, out=common)
        common *= np.minimum(y1[own], y1[live]) - y0[own]
        ok = common > tolerance
        ok &= lx[own] | lx[live]
        ok[:, len(before) :] &= live[len(before) :] < own
        i, j = np.nonzero(ok)
        common = common[i, j]
        i, j = block[i], live[j]
        odd = np.flatnonzero(shaped[i] | shaped[j])
        if len(odd):
            common[odd] = [shared(p, q) for p, q in zip(i[odd].tolist(), j[odd].tolist(), strict=True)]
        a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
        found = pa.record_batch([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(common)], names=["aid", "bid", "common"])
        fit = pc.and_(pc.greater(found.column("common"), tolerance), pc.not_equal(a, b))
        yield found if pc.all(fit).as_py() is not False else found.filter(fit)


def overlay_boxes(cells: DataFrame, domain: tuple[float, float, float, float], boundary: tuple[float, float, float, float]) -> DataFrame:
    """JN-7: water, qualified (water and domain), inside and outside areas of upright cells; the three-way overlay is
    joint, never a product of shares."""
    lit = lambda p, b: {f"{p}x0": F.lit(float(b[0])), f"{p}y0": F.lit(float(b[1])), f"{p}x1": F.lit(float(b[2])), f"{p}y1": F.lit(float(b[3]))}
    both = (max(domain[0], boundary[0]), max(domain[1], boundary[1]), min(domain[2], boundary[2]), min(domain[3], boundary[3]))
    rows = cells.withColumns({**lit("d", domain), **lit("v", both)})
    q, i = box_overlap("c", "d"), box_overlap("c", "v")
    water = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    out = rows.withColumns({"water_m2": water, "qualified_m2": q, "inside_m2": F.least(i, q)})
    return out.withColumn("outside_m2", F.col("qualified_m2") - F.col("inside_m2")).withColumn("excluded_m2", F.col("water_m2") - F.col("qualified_m2")).drop(*[f"{p}{s}" for p in "dv" for s in ("x0", "y0", "x1", "y1")])


def overlay_polygons(cells: DataFrame, domain: list, boundary: list) -> DataFrame:
    """JN-7..9, SCL-25: the same for any water (WKB; null is the whole cell), domain and boundary, holes and several parts
    included; the two are shipped once with the function.

    VAL-6: inside and qualified areas are joint intersections, outside and excluded ones are taken independently, as areas
    of differences; a cell whose parts do not add up is an error.
    """

    @F.pandas_udf("water_m2 double, qualified_m2 double, inside_m2 double, outside_m2 double, excluded_m2 double")
    def areas(water: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        out = []
        for w, *b in zip(water, x0, y0, x1, y1, strict=True):
            own = G.polygons_of(bytes(w)) if w is not None else [G.box(*b)]
            lo_hi = G.bounds(own) if own else b
            d, v = G.clip(domain, *lo_hi), G.clip(boundary, *lo_hi)
            whole, q, i = G.area(own), G.common_area(own, d), G.common_area(own, d, v)
            o = G.slab_area([own, d, v], lambda at: at[0] and at[1] and not at[2])
            e = G.difference_area(own, d)
            off = max(abs(q - i - o), abs(whole - q - e))
            if off > max(1e-6, 1e-9 * whole):
                raise ValueError(f"areas of a cell do not add up: off by {off} m2")
            out.append((whole, q, i, o, e))
        return pd.DataFrame(out, columns=["water_m2", "qualified_m2", "inside_m2", "outside_m2", "excluded_m2"])

    return cells.withColumn("a", areas("water", "cx0", "cy0", "cx1", "cy1")).select(*cells.columns, "a.*")


def split_total(total, part: str = "inside_m2"):
    """SCL-22: what a part of a cell holds of a total that is spread over all of its water; null where there is no water. The
    total is of the full water, not of the qualified part."""
    return total * F.col(part) / F.nullif(F.col("water_m2"), F.lit(0.0))


def in_source_order(sources: DataFrame) -> DataFrame:
    """SRT-5: source polygons by lower y, lower x, upper y and upper x of their bounds, density and WKB; source_no
    grows in that order."""

    @F.pandas_udf("x0 double, y0 double, x1 double, y1 double")
    def box_of(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(G.all_bounds([bytes(w) for w in g]), columns=["x0", "y0", "x1", "y1"])

    order = ["b.y0", "b.x0", "b.y1", "b.x1", "density", "geometry"]
    ranged = sources.withColumn("b", box_of("geometry")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("source_no", F.monotonically_increasing_id()).drop("b")


def polygon_overlaps(sources: DataFrame, bucket: float, tolerance: float = 0.01) -> DataFrame:
    """JN-6 for any polygons: (aid, bid, common) of pairs (aid < bid) of sources (source_id, geometry WKB) whose interiors share
    more than ``tolerance``. Candidates come from a sweep of bounding boxes as in ``overlaps``; upright boxes have their areas in
    closed form, other polygons through clipping."""

    @F.pandas_udf("x0 double, y0 double, x1 double, y1 double, whole boolean")
    def box_of(g: pd.Series) -> pd.DataFrame:
        data = [bytes(w) for w in g]
        return pd.DataFrame(G.all_bounds(data), columns=["x0", "y0", "x1", "y1"]).assign(whole=G.are_boxes(data))

    boxed = sources.withColumn("b", box_of("geometry"))
    return _swept(boxed.select(F.col("source_id").alias("id"), "b.x0", "b.y0", "b.x1", "b.y1", F.when(~F.col("b.whole"), F.col("geometry")).alias("geometry")), bucket, tolerance)


def require_disjoint(pairs: DataFrame) -> None:
    """JN-6: an error that names the pair of sources that overlaps most, if any does."""
    worst = pairs.orderBy(F.desc("common"), "aid", "bid").limit(1).collect()
    if worst:
        raise ValueError(f"sources {worst[0]['aid']} and {worst[0]['bid']} overlap by {worst[0]['common']} m2")


def abundance_balance(sources: DataFrame, transferred: DataFrame, domain: list, absolute: float = 1e-9, rel: float = 1e-10) -> DataFrame:
    """VAL-5: (source_abundance, allocated, conserved): the sources' abundance within the unioned ``domain`` (polygons, which may
    overlap), by slabs and without the cells, against the sum over cells."""

    @F.pandas_udf("double")
    def within(g: pd.Series) -> pd.Series:
        return pd.Series(G.covered_areas([bytes(w) for w in g], domain), dtype=float)

    expected = sources.agg(A.exact_sum(F.col("density") * within("geometry") / 1e6).alias("source_abundance"))
    got = transferred.agg(A.exact_sum(F.col("abundance")).alias("allocated"))
    both = expected.crossJoin(got)  # one row each
    return both.withColumn("conserved", F.abs(F.col("allocated") - F.col("source_abundance")) <= F.greatest(F.lit(absolute), rel * F.col("source_abundance")))


def water_balance(cells: DataFrame, mask: list, bounds: tuple[float, float, float, float], absolute: float = 0.1) -> DataFrame:
    """VAL-7: (cells_m2, mask_m2, conserved): the cells' water (column water_m2) against the mask within the grid's bounds, taken
    as one union by slabs."""
    whole = G.slab_area([G.clip(mask, *bounds)], any)
    out = cells.agg(A.exact_sum(F.col("water_m2")).alias("cells_m2")).withColumn("mask_m2", F.lit(whole))
    return out.withColumn("conserved", F.abs(F.col("cells_m2") - F.col("mask_m2")) <= F.greatest(F.lit(absolute), 1e-12 * F.col("mask_m2")))


def coarse_balance(fine: DataFrame, coarse: DataFrame, columns: Sequence[str] = ("water_km2", "abundance", "vessel_km"), rel: float = 1e-12) -> DataFrame:
    """VAL-8: (measure, fine, coarse, conserved): totals of the fine and the coarse cells."""
    totals = lambda df: df.agg(*[A.exact_sum(F.col(c)).alias(c) for c in columns])
    long = lambda df, name: totals(df).select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias(name)) for c in columns])).alias("r")).select("r.*")
    both = long(fine, "fine").join(long(coarse, "coarse"), "measure")
    return both.withColumn("conserved", F.abs(F.col("fine") - F.col("coarse")) <= F.greatest(F.lit(1e-9), rel * F.abs(F.col("fine"))))


def stations_within(stations: DataFrame, kind: str, box: tuple[float, float, float, float]) -> DataFrame:
    """FLT-19: stations of a kind (columns kind, sx, sy) in a closed box."""
    return stations.where((F.col("kind") == kind) & F.col("sx").between(box[0], box[2]) & F.col("sy").between(box[1], box[3]))


def normalisation_control(cells: DataFrame, method: str = "product", shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """PUB-5: (available, normaliser, inside_share_difference, memberships_equal): dividing all intensities by their largest
    changes neither the inside share nor which cells are above any threshold; not available where that largest is 0."""
    ok = cells.where("qualified_m2 > 0")
    top = ok.agg(F.max(method).alias("top")).first()["top"]
    if not top:
        return cells.sparkSession.createDataFrame([(False, None, None, None)], "available boolean, normaliser double, inside_share_difference double, memberships_equal boolean")
    scaled = ok.withColumn(method, F.col(method) / top)
    share = lambda df: summary(df, method).select("share_inside")
    diff = share(ok).crossJoin(share(scaled).withColumnRenamed("share_inside", "s")).select((F.col("s") - F.col("share_inside")).alias("inside_share_difference"))
    high = lambda df: thresholds(df, method, shares).select("reference", "share", "cells", "high_inside_km2")
    a, b = high(ok), high(scaled).withColumnsRenamed({"cells": "cells_b", "high_inside_km2": "inside_b"})
    same = a.join(b, ["reference", "share"]).agg(F.min((F.col("cells").eqNullSafe(F.col("cells_b"))) & (F.col("high_inside_km2").eqNullSafe(F.col("inside_b")))).alias("memberships_equal"))
    return diff.crossJoin(same).select(F.lit(True).alias("available"), F.lit(float(top)).alias("normaliser"), "inside_share_difference", "memberships_equal")


def intensities(cells: DataFrame) -> DataFrame:
    """AGG-27, SCL-7: product = density x traffic per full water area, and with log1p traffic; null where nothing
    qualifies; indices relative to the largest intensity of qualified cells."""
    traffic = F.col("vessel_km") / (F.col("water_m2") / 1e6)
    ok = F.col("qualified_m2") > 0
    out = cells.withColumns({"product": F.when(ok, F.col("density") * traffic), "log": F.when(ok, F.col("density") * F.log1p(traffic))})
    top = out.agg(*[F.max(m).alias(f"max_{m}") for m in METHODS])  # one row
    both = out.crossJoin(F.broadcast(top))
    return both.withColumns({f"{m}_index": F.when(F.col(f"max_{m}") > 0, F.col(m) / F.col(f"max_{m}")).otherwise(F.when(F.col(m).isNotNull(), 0.0)) for m in METHODS}).drop(*[f"max_{m}" for m in METHODS])


def summary(cells: DataFrame, method: str = "product") -> DataFrame:
    """AGG-25: integrals over qualified, inside and outside areas, and shares, null where the whole is 0."""
    km2 = lambda c: F.col(c) / 1e6
    s = cells.where("qualified_m2 > 0").agg(
        F.sum(km2("qualified_m2")).alias("qualified_km2"),
        *[F.sum(F.col(method) * km2(f"{a}_m2")).alias(f"integrated_{a}") for a in ("qualified", "inside", "outside")],
        F.max(method).alias("maximum"),
    )
    whole = F.nullif(F.col("integrated_qualified"), F.lit(0.0))
    return s.withColumns({"share_inside": F.col("integrated_inside") / whole, "share_outside": F.col("integrated_outside") / whole})


def thresholds(cells: DataFrame, method: str = "product", shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """AGG-21, AGG-26: for all valid and for positive cells, each share's area-weighted threshold, and the areas at or
    above it. A threshold of 0 is no class of high cells: it is marked unavailable."""
    ok = cells.where("qualified_m2 > 0")
    parts = []
    for reference, population in (("all_valid", ok), ("positive_only", ok.where(F.col(method) > 0))):
        q = A.weighted_quantiles(population, method, "qualified_m2", shares).withColumn("reference", F.lit(reference))
        parts.append(q)
    table = parts[0].unionByName(parts[1])  # 2 x shares rows
    met = ok.crossJoin(F.broadcast(table)).where((F.col("threshold") > 0) & (F.col(method) >= F.col("threshold")))
    sums = met.groupBy("reference", "share").agg(*[(F.sum(f"{a}_m2") / 1e6).alias(f"high_{a}_km2") for a in ("qualified", "inside", "outside")], F.count(F.lit(1)).alias("cells"))
    out = table.join(sums, ["reference", "share"], "left")
    return out.withColumn("available", F.coalesce(F.col("high_qualified_km2") > 0, F.lit(False)))


def coarsened(cells: DataFrame, size: int = 10_000) -> DataFrame:
    """AGG-24: sums of sufficient statistics on coarser cells; density is abundance over water afterwards."""
    x, y = (F.floor(F.col(c) / size) * size for c in ("x_min_m", "y_min_m"))
    out = cells.groupBy(x.cast("long").alias("coarse_x"), y.cast("long").alias("coarse_y")).agg(F.sum("water_km2").alias("water_km2"), F.sum("abundance").alias("abundance"), F.sum("vessel_km").alias("vessel_km"), F.count(F.lit(1)).alias("fine_cells"))
    return out.withColumn("density", F.col("abundance") / F.nullif(F.col("water_km2"), F.lit(0.0)))


def outside_contributors(cells: DataFrame, method: str = "product", k: int = 10) -> DataFrame:
    """SRT-6."""
    part = cells.where("qualified_m2 > 0").select("cell_id", (F.col(method) * F.col("outside_m2") / 1e6).alias("outside_integrated")).where("outside_integrated > 0")
    return A.top_k(part, "outside_integrated", "cell_id", k)


def scaling_control(cells: DataFrame, factor: float, method: str = "product") -> DataFrame:
    """AGG-29: shares before and after multiplying traffic by a constant; a product's shares do not change."""
    a = summary(intensities(cells), method).select(F.lit("as_is").alias("run"), "share_inside", "share_outside")
    b = summary(intensities(cells.withColumn("vessel_km", F.col("vessel_km") * factor)), method).select(F.lit("scaled").alias("run"), "share_inside", "share_outside")
    return a.unionByName(b)


def pair_differences(results: DataFrame, k: int = 10) -> DataFrame:
    """JN-14, AGG-30, SRT-7: for every two candidates (name), how their cells differ: (a, b, cells, larger, smaller, newly
    positive, largest absolute difference). The self-join is on the cell."""
    a, b = results.alias("a"), results.alias("b")
    both = a.join(b, (F.col("a.cell_id") == F.col("b.cell_id")) & (F.col("a.name") < F.col("b.name")))
    d = F.col("b.value") - F.col("a.value")
    return both.groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(d > 0).alias("larger"), F.count_if(d < 0).alias("smaller"), F.count_if((F.col("a.value") == 0) & (F.col("b.value") > 0)).alias("newly_positive"), F.max(F.abs(d)).alias("largest_difference")
    )


def share_deltas(summaries: DataFrame) -> DataFrame:
    """AGG-35: differences of shares between scenarios, in share points, against the one named primary."""
    p = summaries.where("scenario = 'primary'").select(F.col("share_inside").alias("base"))
    return summaries.where("scenario <> 'primary'").crossJoin(F.broadcast(p)).select("scenario", ((F.col("share_inside") - F.col("base")) * 100).alias("points"))


def domain_cells(cells: DataFrame, stations: DataFrame, radius: float) -> DataFrame:
    """JN-8, FLT-19, AGG-34: cells whose centre lies within a radius of any station. Stations meet cells through buckets
    of the radius' size, so there is no cross product."""
    key = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    s = stations.withColumn("bx", F.explode(F.transform(near, lambda d: key("sx") + d))).withColumn("by", F.explode(F.transform(near, lambda d: key("sy") + d)))
    c = cells.withColumn("mx", (F.col("cx0") + F.col("cx1")) / 2).withColumn("my", (F.col("cy0") + F.col("cy1")) / 2)
    c = c.withColumn("bx", key("mx")).withColumn("by", key("my"))
    hit = c.join(s, ["bx", "by"]).where((F.col("mx") - F.col("sx")) ** 2 + (F.col("my") - F.col("sy")) ** 2 <= radius * radius)
    return hit.select("cell_id").distinct()
