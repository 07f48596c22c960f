"""Scalar expressions: parsing, sentinels, classes, units, projection. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOTS_PER_MPS = 1.9438444924406046
STATUTE_MILE_M = 1609.344
NAUTICAL_MILE_M = 1852.0
NUMBER = r"\A\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def number(text: Column) -> Column:
    """FLT-1: text to double; null for anything but a plain decimal number."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def integer(text: Column) -> Column:
    """Digits only, after trimming spaces, to int; null otherwise and beyond its range."""
    return F.when(full_match(F.trim(text), "[0-9]+"), F.trim(text).try_cast("int"))


def full_match(text: Column, pattern: str) -> Column:
    """SCL-2: whether the whole text matches; null counts as no."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def strict_timestamp(text: Column) -> Column:
    """FLT-2, FLT-3: yyyy-mm-ddThh:mm:ss as UTC; null for other forms and impossible dates."""
    shape = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z"
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def utc_text(ts: Column) -> Column:
    """SCL-5: a timestamp as text in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def finite(x: Column) -> Column:
    """SCL-4: neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """FLT-4."""
    return finite(lat) & finite(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def in_extent(lat: Column, lon: Column, extent: tuple[float, float, float, float]) -> Column:
    """FLT-5: extent is (lon min, lon max, lat min, lat max), ends included."""
    return lon.between(extent[0], extent[1]) & lat.between(extent[2], extent[3])


def valid_mmsi(text: Column) -> Column:
    """FLT-6: nine digits, the first not 0."""
    return full_match(text, "[1-9][0-9]{8}")


def valid_speed(sog: Column) -> Column:
    """FLT-7: the sentinel, or finite and not negative; there is no maximum."""
    return F.coalesce((sog == 102.3) | (finite(sog) & (sog >= 0)), F.lit(False))


def type_state(text: Column, code: Column) -> Column:
    """FLT-8, FLT-9: missing, malformed, unavailable, noncommercial or commercial; ``code`` is ``integer`` of the text, null
    where it is no number."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "missing")
        .when(code == 0, "unavailable")
        .when(code.isNull() | ~code.between(1, 99), "malformed")
        .when(~code.between(60, 89), "noncommercial")
        .otherwise("commercial")
    )


def optional_measure(x: Column, sentinel: float | None, low: float, high: float | None) -> Column:
    """FLT-10, FLT-11: null for the sentinel, for what is not finite and for what lies outside low..high."""
    bad = ~finite(x) | (x < low)
    if sentinel is not None:
        bad = bad | (x == sentinel)
    if high is not None:
        bad = bad | (x > high)
    return F.when(~F.coalesce(bad, F.lit(True)), x)


def vessel_group(code: Column) -> Column:
    """FLT-12: the sixties, seventies and eighties of type codes."""
    return F.when(code.between(60, 69), "passenger").when(code.between(70, 79), "cargo").when(code.between(80, 89), "tanker")


def close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """FLT-22: whether two numbers agree within either tolerance."""
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def class_of(x: Column, breaks: Sequence[float], upper_inclusive: bool, zero_class: bool = False) -> Column:
    """FLT-20: index of the class between successive breaks, null outside; [min, max) or (min, max], the outer end of
    the last (first) class included; with zero_class, 0 is class -1 of its own."""
    out = F.when(x == 0, F.lit(-1)) if zero_class else F.when(F.lit(False), F.lit(-1))
    last = len(breaks) - 2
    for k in range(last + 1):
        low, high = breaks[k], breaks[k + 1]
        if upper_inclusive:
            inside = (x > low) & (x <= high)
        else:
            inside = (x >= low) & ((x <= high) if k == last else (x < high))
        out = out.when(inside, k)
    return out


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """AGG-19: how many edges are at or below x: bin 0 is below the first, the last at or above the last."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def cell_id(row: Column, column: Column) -> Column:
    """SCL-14."""
    return F.format_string("r%03d_c%03d", row.cast("int"), column.cast("int"))


def coarse_origin(x: Column, size: int = 10_000) -> Column:
    """SCL-15: floor to a multiple of size, below zero too."""
    return (F.floor(x / size) * size).cast("long")


def endpoint_speed(a: Column, b: Column, implied: Column, tolerance: float = 5.0) -> tuple[Column, Column]:
    """SCL-13: (status, mean): unavailable unless both ends report, inconsistent if their mean is off the implied speed."""
    mean = (F.when(a != 102.3, a) + F.when(b != 102.3, b)) / 2
    status = F.when(mean.isNull(), "unavailable").when(F.abs(mean - implied) > tolerance, "inconsistent").otherwise("available")
    return status, F.when(status == "available", mean)


def redacted(text: Column) -> Column:
    """SCL-21: mail addresses and values of secret-like parameters blanked."""
    no_mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")
    return F.regexp_replace(no_mail, r"(?i)\b(token|key|secret|password|signature)=[^&\s]+", "$1=[redacted]")


def half_up_text(x: Column, places: int) -> Column:
    """SCL-19: decimal text, halves rounded away from zero, from the number's shortest decimal form."""
    return F.round(x.cast("string").cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string")


def content_id(prefix: str, *parts: Column) -> Column:
    """SCL-17: prefix and 24 hex digits of the SHA-256 of the parts, joined unambiguously."""
    marked = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *marked), 256), 1, 24))


def public_text(text: Column, most: int = 500) -> Column:
    """PUB-2: whether text may be shown: not blank, not too long, no path, url or control character."""
    bad = text.rlike(r"[\x00-\x1f\x7f]") | text.rlike(r"(?i)\b[a-z][a-z0-9+.-]*://") | text.rlike(r"(?:^|\s)(?:/|~/|\.\.?/|[A-Za-z]:\\)") | text.contains("\\")
    return F.coalesce((F.trim(text) != "") & (F.length(text) <= most) & ~bad, F.lit(False))


def coverage_status(uncovered_m2: Column) -> Column:
    """SCL-23."""
    return F.when(uncovered_m2 <= 1e-6, "complete").when(uncovered_m2 <= 0.1, "within_tolerance").otherwise("partial")


# --- equal-area projection EPSG:3310, closed form ---------------------------------------------------------------------

# GRS80 and the parameters of the California Albers projection.
_A, _F = 6378137.0, 1 / 298.257222101
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_PHI1, _PHI2, _LON0, _FALSE_NORTH = math.radians(34.0), math.radians(40.5), -120.0, -4_000_000.0


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    s = math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - _E2 * s * s)


_N = (_m(_PHI1) ** 2 - _m(_PHI2) ** 2) / (_q(_PHI2) - _q(_PHI1))
_C = _m(_PHI1) ** 2 + _N * _q(_PHI1)
_RHO0 = _A * math.sqrt(_C) / _N


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """SCL-10: (x, y) in metres of degrees of latitude and longitude."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(_C - _N * q) / _N
    theta = _N * F.radians(lon - _LON0)
    return rho * F.sin(theta), _RHO0 - rho * F.cos(theta) + _FALSE_NORTH


def unproject(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """SCL-11: (lat, lon) of projected metres, by a fixed number of Newton-like steps for the latitude."""
    dy = _RHO0 - (y - _FALSE_NORTH)
    rho = F.sqrt(x * x + dy * dy)
    q = (_C - rho * rho * _N * _N / (_A * _A)) / _N
    lon = _LON0 + F.degrees(F.atan2(x, dy)) / _N
    def step(phi, q):
        s = F.sin(phi)
        w = 1 - _E2 * s * s
        return phi + w * w / (2 * F.cos(phi)) * (q / (1 - _E2) - s / w + F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))

    # a fold over the rounds, so that the expression does not grow with them
    phi = F.aggregate(F.array_repeat(q, rounds), F.asin(q / 2), step)
    return F.degrees(phi), lon


def project_sql(lat: str, lon: str) -> tuple[str, str]:
    """The same projection as SQL text, for an oracle in another engine."""
    s = f"sin(radians({lat}))"
    q = f"({1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) - ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s})) / {2 * _E!r}))"
    rho = f"({_A!r} * sqrt({_C!r} - {_N!r} * {q}) / {_N!r})"
    theta = f"({_N!r} * radians({lon} - ({_LON0!r})))"
    return f"({rho} * sin({theta}))", f"({_RHO0!r} - {rho} * cos({theta}) + ({_FALSE_NORTH!r}))"
