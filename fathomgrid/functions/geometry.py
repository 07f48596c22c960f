"""Planar geometry without a geometry library: WKB, rings, clipping, areas. Vectorised where it meets rows.

A polygon is a list of rings (arrays n x 2, closed or not), the first outer, the others holes; a multipolygon is a list
of polygons. Areas and clipping against a convex box are exact up to rounding.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

Polygon = list[np.ndarray]


def wkb_of(polygons: Sequence[Polygon]) -> bytes:
    """SCL-28: ISO WKB, 2-D, little-endian: a polygon, or a multipolygon if there is not exactly one."""

    def one(p: Polygon) -> bytes:
        out = struct.pack("<BII", 1, 3, len(p))
        for ring in p:
            r = closed(ring)
            out += struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes()
        return out

    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def polygons_of(data: bytes) -> list[Polygon]:
    """SCL-28: the polygons of ISO WKB of either byte order; other geometry is refused."""

    def read(at: int) -> tuple[list[Polygon], int]:
        e = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(e + "I", data, at + 1)
        at += 5
        (n,) = struct.unpack_from(e + "I", data, at)
        at += 4
        if kind == 3:
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from(e + "I", data, at)
                rings.append(np.frombuffer(data, e + "f8", 2 * m, at + 4).reshape(-1, 2).astype(float))
                at += 4 + 16 * m
            return [rings], at
        if kind == 6:
            out = []
            for _ in range(n):
                part, at = read(at)
                out += part
            return out, at
        raise ValueError(f"WKB kind {kind} is no polygon")

    polygons, end = read(0)
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return polygons


def shapes(data: Sequence[bytes]):
    """SCL-28: WKB in classes of equal structure: (row numbers, rings), a ring being (polygon number, hole, points as rows x corners
    x 2). What ``polygons_of`` refuses is refused here too."""
    by_length: dict[int, list[int]] = {}
    for i, d in enumerate(data):
        by_length.setdefault(len(d), []).append(i)
    for size, members in by_length.items():
        rows = np.array(members)
        raw = np.frombuffer(b"".join(data[i] for i in members), np.uint8).reshape(-1, size)
        while len(rows):
            places, first = [], data[rows[0]]  # where the first row's rings are
            polygons = polygons_of(first)
            at = 0 if 3 in (first[1], first[4]) else 9
            for k, p in enumerate(polygons):
                e = first[at]
                at += 9
                for j, ring in enumerate(p):
                    places.append((k, j > 0, at + 4, len(ring), "<f8" if e == 1 else ">f8"))
                    at += 4 + 16 * len(ring)
            fixed = np.ones(size, bool)
            for _, _, a, m, _ in places:
                fixed[a : a + 16 * m] = False
            same = (raw[:, fixed] == raw[0, fixed]).all(1)
            here = raw[same]
            yield rows[same], [(k, hole, np.ascontiguousarray(here[:, a : a + 16 * m]).view(kind).astype(float).reshape(-1, m, 2)) for k, hole, a, m, kind in places]
            rows, raw = rows[~same], raw[~same]


def all_bounds(data: Sequence[bytes]) -> np.ndarray:
    """``bounds`` of many WKB geometries, rows x 4."""
    out = np.empty((len(data), 4))
    for rows, rings in shapes(data):
        outer = np.concatenate([pts for _, hole, pts in rings if not hole], 1)
        out[rows] = np.hstack([outer.min(1), outer.max(1)])
    return out


def _upright(pts: np.ndarray) -> np.ndarray:
    """Which of many rings (rows x corners x 2) are upright boxes: four corners, closed or not, each edge along another axis than
    the one before."""
    m = pts.shape[1]
    if m not in (4, 5):
        return np.zeros(len(pts), bool)
    c = pts[:, :4]
    still = c == np.roll(c, -1, 1)  # which coordinate an edge keeps
    out = (still.sum(2) == 1).all(1) & (still[:, 0] == still[:, 2]).all(1) & (still[:, 1] == still[:, 3]).all(1) & (still[:, 0] != still[:, 1]).all(1)
    return out & (pts[:, 0] == pts[:, 4]).all(1) if m == 5 else out


def are_boxes(data: Sequence[bytes]) -> np.ndarray:
    """Which of many WKB geometries are one upright box, and so equal to their bounds."""
    out = np.zeros(len(data), bool)
    for rows, rings in shapes(data):
        if len(rings) == 1:
            out[rows] = _upright(rings[0][2])
    return out


def _clipped(pts: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Areas of many rings (rows x corners x 2) within upright boxes (rows x 4): by Green's theorem each edge adds its height above the
    box's floor, held to the box, times its width within the box. That needs no corners of the clipped ring."""
    lo, hi = pts.min(1), pts.max(1)
    out = np.prod(np.maximum(0.0, np.minimum(hi, boxes[:, 2:]) - np.maximum(lo, boxes[:, :2])), axis=1)  # right for upright boxes
    rest = np.flatnonzero(~_upright(pts) & (out > 0))
    if len(rest):
        p = pts[rest] - boxes[rest, None, :2]
        w, h = (boxes[rest, 2:] - boxes[rest, :2]).T[:, :, None]
        q = np.roll(p, -1, 1)
        (px, py), (qx, qy) = np.moveaxis(p, 2, 0), np.moveaxis(q, 2, 0)
        xa, xb = np.clip(px, 0, w), np.clip(qx, 0, w)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(qx != px, (qy - py) / (qx - px), 0.0)
        ya, yb = py + (xa - px) * slope, qy + (xb - qx) * slope
        least, most = np.minimum(ya, yb), np.maximum(ya, yb)
        a, b = np.clip(least, 0, h), np.clip(most, 0, h)
        rise = np.where(most > least, most - least, 1.0)
        mean = np.where(most > least, (b - a) / rise * (a + b) / 2 + np.maximum(0.0, most - np.maximum(least, h)) / rise * h, a)
        found = np.abs(((xb - xa) * mean).sum(1))
        out[rest] = np.where(found > 1e-15 * pts.shape[1] * (w * h)[:, 0], found, 0.0)  # less is the sum's rounding
    return out


def clipped_areas(data: Sequence[bytes], boxes: np.ndarray) -> np.ndarray:
    """SCL-25: ``area(clip(polygons, *box))`` of many WKB geometries, each with its box (rows x 4)."""
    out = np.zeros(len(data))
    for rows, rings in shapes(data):
        for _, hole, pts in rings:
            found = _clipped(pts, boxes[rows])
            if not hole:
                met = found > 0
            out[rows] += np.where(met, -found, 0.0) if hole else found
    return out


def box(x0: float, y0: float, x1: float, y1: float) -> Polygon:
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]


def closed(ring: np.ndarray) -> np.ndarray:
    ring = np.asarray(ring, float)
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def signed_area(ring: np.ndarray) -> float:
    r = closed(ring)
    if len(r) < 4:
        return 0.0
    o = r - r[0]
    return float((o[:-1, 0] * o[1:, 1] - o[1:, 0] * o[:-1, 1]).sum() / 2)


def area(polygons: Sequence[Polygon]) -> float:
    """SCL-25: outer rings less holes."""
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in polygons if p)


def oriented(polygon: Polygon) -> Polygon:
    """SCL-26, SNK-4: outer ring counter-clockwise, holes clockwise (RFC 7946)."""
    return [closed(r) if (signed_area(r) > 0) == (k == 0) else closed(r)[::-1] for k, r in enumerate(polygon)]


def bounds(polygons: Sequence[Polygon]) -> tuple[float, float, float, float]:
    pts = np.concatenate([p[0] for p in polygons])
    return (*pts.min(0), *pts.max(0))


def clip_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring against an upright box, side by side (Sutherland-Hodgman); its area is right for rings of any shape."""
    pts = closed(ring)[:-1]
    for axis, at, keep_less in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        if not len(pts):
            break
        v = pts[:, axis]
        inside = v <= at if keep_less else v >= at
        nxt, nin = np.roll(pts, -1, 0), np.roll(inside, -1)
        out = []
        for p, q, a, b in zip(pts, nxt, inside, nin, strict=True):
            if a:
                out.append(p)
            if a != b:
                t = (at - p[axis]) / (q[axis] - p[axis])
                c = p + t * (q - p)
                c[axis] = at
                out.append(c)
        pts = np.array(out).reshape(-1, 2)
    return pts


def clip(polygons: Sequence[Polygon], x0: float, y0: float, x1: float, y1: float) -> list[Polygon]:
    out = []
    for p in polygons:
        lo, hi = p[0].min(0), p[0].max(0)
        if lo[0] >= x1 or hi[0] <= x0 or lo[1] >= y1 or hi[1] <= y0:
            continue
        if lo[0] >= x0 and hi[0] <= x1 and lo[1] >= y0 and hi[1] <= y1:
            out.append(p)
            continue
        rings = [clip_ring(r, x0, y0, x1, y1) for r in p]
        if len(rings[0]) >= 3:
            out.append([rings[0], *[r for r in rings[1:] if len(r) >= 3]])
    return out


def clip_convex(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """A ring against a convex, counter-clockwise ring."""
    pts = closed(ring)[:-1]
    edges = closed(convex)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if not len(pts):
            break
        d = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
        out = []
        for k in range(len(pts)):
            j = (k + 1) % len(pts)
            if d[k] >= 0:
                out.append(pts[k])
            if (d[k] >= 0) != (d[j] >= 0):
                out.append(pts[k] + d[k] / (d[k] - d[j]) * (pts[j] - pts[k]))
        pts = np.array(out).reshape(-1, 2)
    return pts


def _fans(polygons: Sequence[Polygon]) -> list[tuple[int, np.ndarray]]:
    """Signed, counter-clockwise triangles whose signed indicators add up to that of the polygons: holes and concave rings
    come out right."""
    out = []
    for p in polygons:
        for k, ring in enumerate(p):
            r = closed(ring)[:-1]
            sign = (1 if k == 0 else -1) * (1 if signed_area(ring) > 0 else -1)
            for i in range(1, len(r) - 1):
                t = np.array([r[0], r[i], r[i + 1]])
                s = signed_area(t)
                if s:
                    out.append((sign, t) if s > 0 else (-sign, t[::-1]))
    return out


def common_area(*layers: Sequence[Polygon]) -> float:
    """SCL-25, JN-7: the area common to all of several multipolygons of any shape, holes included. Signed triangles of one are
    cut by those of the next, so the intersection is joint."""
    parts = _fans(layers[0])
    for layer in layers[1:]:
        boxes = [(s, t, t.min(0), t.max(0)) for s, t in _fans(layer)]
        new = []
        for sign, ring in parts:
            lo, hi = ring.min(0), ring.max(0)
            for s, t, tlo, thi in boxes:
                if (lo < thi).all() and (tlo < hi).all():
                    c = clip_convex(ring, t)
                    if len(c) > 2:
                        new.append((sign * s, c))
        parts = new
    return sum(s * abs(signed_area(c)) for s, c in parts)


def overlap_area(a: Sequence[Polygon], b: Sequence[Polygon]) -> float:
    """SCL-25: the area common to two multipolygons."""
    return common_area(a, b)


def slab_area(layers: Sequence[Sequence[Polygon]], keep) -> float:
    """SCL-25, AGG-34: the area where ``keep`` holds of the layers that cover a place (a tuple of truth values).

    An independent way beside ``common_area``: the plane is cut into upright slabs at every corner and crossing; within a
    slab edges do not cross, so lengths along its middle times its width are exact. Polygons of one layer may overlap.
    """
    edges, owner = [], []  # owner: layer and polygon
    for k, layer in enumerate(layers):
        for j, p in enumerate(layer):
            for ring in p:
                r = closed(ring)
                edges.append(np.hstack([r[:-1], r[1:]]))
                owner += [(k, j)] * (len(r) - 1)
    if not owner:
        return 0.0
    e, owner = np.concatenate(edges), np.array(owner)
    upright = e[:, 0] == e[:, 2]
    xs = [e[:, 0], e[:, 2]]
    e, owner = e[~upright], owner[~upright]
    e = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    for i in range(len(e) - 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[i + 1 :] - base[i]) / (slope[i] - slope[i + 1 :])
        xs.append(x[np.isfinite(x) & (x > np.maximum(e[i, 0], e[i + 1 :, 0])) & (x < np.minimum(e[i, 2], e[i + 1 :, 2]))])
    cuts = np.unique(np.concatenate(xs))
    total = []
    for x0, x1 in zip(cuts[:-1], cuts[1:], strict=True):
        mid = (x0 + x1) / 2
        here = np.flatnonzero((e[:, 0] < mid) & (e[:, 2] > mid))
        y = slope[here] * (mid - e[here, 0]) + e[here, 1]
        order = np.argsort(y, kind="stable")
        inside: set[tuple[int, int]] = set()
        last = length = 0.0
        for i in order:
            if inside and keep(tuple(any(k == layer for k, _ in inside) for layer in range(len(layers)))):
                length += y[i] - last
            inside ^= {tuple(owner[here[i]])}
            last = y[i]
        total.append(length * (x1 - x0))
    return float(np.sum(total))


def covered_areas(data: Sequence[bytes], domain: Sequence[Polygon], most: int = 64) -> np.ndarray:
    """AGG-34, VAL-5: the area of each of many WKB geometries that the union of the domain's polygons covers.

    ``slab_area`` for many rows at once: rows x slabs x edges instead of loops. Rows that meet more than ``most`` edges go
    through ``slab_area`` itself.
    """
    out = np.zeros(len(data))
    if not domain:
        return out
    edges = [np.concatenate([np.hstack([closed(r)[:-1], closed(r)[1:]]) for r in p]) for p in domain]
    limits = np.array([(*e[:, :2].min(0), *e[:, :2].max(0)) for e in edges])
    width = max(map(len, edges))
    table = np.full((len(domain), min(width, most), 4), np.nan)
    for k, e in enumerate(edges):
        if len(e) <= most:
            table[k, : len(e)] = e
    sizes = np.array([len(e) for e in edges])
    for members, rings in shapes(data):
        own = [np.concatenate([pts, np.roll(pts, -1, 1)], 2) for _, _, pts in rings]
        own, polygon = np.concatenate(own, 1), np.repeat([k for k, _, _ in rings], [o.shape[1] for o in own])
        first = int(polygon.max()) + 1
        for start in range(0, len(members), 1024):
            rows, e = members[start : start + 1024], own[start : start + 1024]
            lo, hi = e[:, :, :2].min(1), e[:, :, :2].max(1)
            near = ((limits[None, :, :2] < hi[:, None]) & (limits[None, :, 2:] > lo[:, None])).all(2)
            many = near @ sizes + e.shape[1] > most
            for i in np.flatnonzero(many):
                shape = polygons_of(data[rows[i]])
                out[rows[i]] = slab_area([shape, clip([domain[k] for k in np.flatnonzero(near[i])], *bounds(shape))], all)
            for n in np.unique(near[~many].sum(1)):
                at = np.flatnonzero(~many & (near.sum(1) == n))
                if n:
                    met = table[np.nonzero(near[at])[1].reshape(-1, n)].reshape(len(at), -1, 4)
                    met = np.where(np.isnan(met), e[at, :1, [0]][:, :, None], met)  # no edge: a point
                    owner = np.concatenate([polygon, first + np.repeat(np.arange(n), table.shape[1])])
                    out[rows[at]] = _common_slabs(np.concatenate([e[at], met], 1), owner, first)
    return out


def _common_slabs(e: np.ndarray, owner: np.ndarray, first: int) -> np.ndarray:
    """The area within both layers of many rows of edges (rows x edges x 4); polygons from number ``first`` on are the second layer."""
    cuts = [e[:, :, 0], e[:, :, 2]]
    flat = (e[:, :, 0] != e[:, :, 2]).any(0)  # upright edges only cut
    e, owner = e[:, flat], owner[flat]
    e = np.where((e[:, :, 0] > e[:, :, 2])[:, :, None], e[:, :, [2, 3, 0, 1]], e)
    x0, y0, x2, y2 = np.moveaxis(e, 2, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(x0 != x2, (y2 - y0) / (x2 - x0), 0.0)
        base = y0 - slope * x0
        i, j = np.triu_indices(len(owner), 1)
        x = (base[:, j] - base[:, i]) / (slope[:, i] - slope[:, j])
        x = np.where((x > np.maximum(x0[:, i], x0[:, j])) & (x < np.minimum(x2[:, i], x2[:, j])), x, np.inf)
    cuts = np.sort(np.concatenate([*cuts, x[:, (x < np.inf).any(0)]], 1), 1)
    cuts[:, 1:][cuts[:, 1:] == cuts[:, :-1]] = np.inf
    cuts.sort(1)
    cuts = cuts[:, : int((cuts < np.inf).sum(1).max())]
    out = np.zeros(len(e))
    with np.errstate(invalid="ignore"):
        for a, b in zip(cuts.T[:-1], cuts.T[1:], strict=True):
            there = b < np.inf
            mid = np.where(there, (a + b) / 2, np.inf)[:, None]
            here = (x0 < mid) & (x2 > mid)
            y = np.where(here, slope * (np.where(here, mid, 0.0) - x0) + y0, np.inf)
            order = np.argsort(y, 1, kind="stable")
            y, whose = np.take_along_axis(y, order, 1), np.where(np.take_along_axis(here, order, 1), owner[order], -1)
            within = np.zeros((2, *y.shape), bool)
            for k in np.unique(owner):
                within[int(k >= first)] |= np.logical_xor.accumulate(whose == k, 1)
            tall = np.where((within[0] & within[1])[:, :-1], y[:, 1:] - y[:, :-1], 0.0).sum(1)
            out += np.where(there, tall * (np.where(there, b, 0.0) - np.where(there, a, 0.0)), 0.0)
    return out


def union_area(*layers: Sequence[Polygon]) -> float:
    """AGG-34: the area that any of the polygons covers."""
    return slab_area([[p for layer in layers for p in layer]], any)


def difference_area(a: Sequence[Polygon], b: Sequence[Polygon]) -> float:
    """SCL-25: the area of a outside b."""
    return slab_area([a, b], lambda at: at[0] and not at[1])


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """SCL-26: a ring without the corners that lie within ``tolerance`` of the line through their kept neighbours (Douglas and
    Peucker), cut at its corner farthest from the first; at least a triangle is kept."""
    r = closed(ring)
    far = int(np.argmax(np.hypot(*(r - r[0]).T)))
    keep = np.zeros(len(r), bool)
    keep[[0, far, len(r) - 1]] = True
    todo = [(0, far), (far, len(r) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = r[a + 1 : b] - r[a], r[b] - r[a]
        n = np.hypot(*v)
        away = np.abs(v[0] * d[:, 1] - v[1] * d[:, 0]) / n if n else np.hypot(*d.T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return r[keep] if keep.sum() > 3 else r


def crosses_itself(ring: np.ndarray) -> bool:
    """VAL-16: whether two edges of a ring meet anywhere but at the corner they share."""
    r = closed(ring)
    a, b = r[:-1], r[1:]
    turn = lambda p, q, t: (q[..., 0] - p[..., 0]) * (t[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (t[..., 0] - p[..., 0])
    within = lambda p, q, t: (np.minimum(p, q) <= t).all(-1) & (t <= np.maximum(p, q)).all(-1)
    n = len(a)
    for i in range(n):
        j = np.arange(i + 1, n)
        c, d = a[j], b[j]
        o1, o2, o3, o4 = turn(a[i], b[i], c), turn(a[i], b[i], d), turn(c, d, a[i]), turn(c, d, b[i])
        cross = (np.sign(o1) * np.sign(o2) < 0) & (np.sign(o3) * np.sign(o4) < 0)
        touch = ((o1 == 0) & within(a[i], b[i], c)) | ((o2 == 0) & within(a[i], b[i], d)) | ((o3 == 0) & within(c, d, a[i])) | ((o4 == 0) & within(c, d, b[i]))
        next_to = (j == i + 1) | ((i == 0) & (j == n - 1))
        if (cross | (touch & ~next_to)).any():
            return True
    return False


def covers(polygons: Sequence[Polygon], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """SCL-25: whether points lie in or on the polygons (closed: a point on an edge is covered)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    out = np.zeros(x.shape, bool)
    for p in polygons:
        odd, edge = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        for ring in p:
            r = closed(ring)
            for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
                if ay != by:
                    hit = (ay > y) != (by > y)
                    odd ^= hit & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        out |= odd | edge
    return out


def segment_share(polygons: Sequence[Polygon], x0: float, y0: float, x1: float, y1: float) -> float:
    """SCL-24, SCL-25: the share of a segment's length that lies within the polygons."""
    ts = [0.0, 1.0]
    dx, dy = x1 - x0, y1 - y0
    for p in polygons:
        for ring in p:
            r = closed(ring)
            e = r[1:] - r[:-1]
            den = dx * e[:, 1] - dy * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((r[:-1, 0] - x0) * e[:, 1] - (r[:-1, 1] - y0) * e[:, 0]) / den
                u = ((r[:-1, 0] - x0) * dy - (r[:-1, 1] - y0) * dx) / den
            good = (den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
            ts += list(t[good])
    ts = np.unique(ts)
    mid = (ts[1:] + ts[:-1]) / 2
    return float((np.diff(ts) * covers(polygons, x0 + mid * dx, y0 + mid * dy)).sum())


def densified(ring: np.ndarray, step: float) -> np.ndarray:
    """SCL-26, SCL-27: every edge cut into equal parts no longer than ``step``."""
    r = closed(ring)
    out = [r[:1]]
    for a, b in zip(r[:-1], r[1:], strict=True):
        n = max(1, int(np.ceil(np.hypot(*(b - a)) / step - 1e-9)))
        out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(out)


def point_buffer(x: float, y: float, radius: float, quarter: int = 16) -> Polygon:
    """SCL-26: a circle's inscribed polygon with 4 * quarter corners."""
    a = -np.arange(4 * quarter + 1) * np.pi / (2 * quarter)
    ring = np.stack([x + radius * np.cos(a), y + radius * np.sin(a)], 1)
    ring[-1] = ring[0]
    return [ring]


def defects(data: bytes | None) -> str:
    """VAL-16: what is wrong with a geometry: null, empty, non_finite, invalid or nothing."""
    if data is None:
        return "null"
    try:
        polygons = polygons_of(bytes(data))
    except (ValueError, struct.error, IndexError):
        return "invalid"
    if not polygons or not any(len(r) for p in polygons for r in p):
        return "empty"
    for p in polygons:
        for r in p:
            if not np.isfinite(r).all():
                return "non_finite"
            if len(r) < 4 or (r[0] != r[-1]).any() or signed_area(r) == 0 or crosses_itself(r):
                return "invalid"
    return ""


def geodesic(lat1, lon1, lat2, lon2, rounds: int = 30) -> np.ndarray:
    """SCL-9: WGS84 distance in metres by Vincenty's inverse formula; pairs that do not converge are NaN."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    la1, lo1, la2, lo2 = (np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - f) * np.tan(la1)), np.arctan((1 - f) * np.tan(la2))
    el = lo2 - lo1
    lam = el.copy()
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2a = 1 - sa * sa
            cm = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / c2a)
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = el + (1 - c) * f * sa * (sig + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))
            moved = np.abs(new - lam)
            lam = new
        uu = c2a * (a * a - b * b) / (b * b)
        big = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        small = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = small * ss * (cm + small / 4 * (cs * (-1 + 2 * cm * cm) - small / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
        d = b * big * (sig - ds)
    return np.where(ss == 0, 0.0, np.where(moved > 1e-11, np.nan, d))
