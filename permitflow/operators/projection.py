"""Coordinates from one reference system to another, as Column expressions: transverse Mercator grids by Kruger's series in
the third flattening, and seven-parameter shifts between datums. The system of a layer is chosen by its name.

Each step takes and gives arrays of points, so an intermediate value is worked out once per point. Series of four terms are
right to far below a millimetre within some twenty degrees of a grid's meridian. Heights are taken as 0.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float


# Published ellipsoids, grids and datum shifts.
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)


@dataclass(frozen=True)
class System:
    """``shift``: to WGS 84 in metres, seconds of arc (of the position vector) and parts per million. A system without a
    meridian gives longitude and latitude in degrees."""

    ellipsoid: Ellipsoid = WGS84
    meridian: float | None = None
    parallel: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    shift: tuple[float, ...] = ()


_ISRAEL = {"meridian": 35 + 12 / 60 + 16.261 / 3600, "parallel": 31 + 44 / 60 + 3.817 / 3600, "scale": 1.0000067, "east": 219529.584, "north": 626907.39}
SYSTEMS = {
    "EPSG:4326": System(),
    "EPSG:2039": System(GRS80, **_ISRAEL, shift=(-24.0024, -17.1032, -17.8444, -0.33077, -1.85269, 1.66969, 5.4248)),
    "EPSG:6991": System(GRS80, **_ISRAEL),
}


def name_of(crs: str | None) -> str | None:
    """The plain name, such as EPSG:2039, in a layer's ``crs`` member or in a text that names a system; None without one."""
    if not crs:
        return None
    text = crs.strip()
    if text.startswith("{"):
        text = (json.loads(text).get("properties") or {}).get("name") or ""
    if re.search(r"CRS:?84$", text, re.I):
        return "EPSG:4326"
    m = re.search(r"EPSG:(?:[\d.]*:)?(\d+)$", text, re.I)
    return f"EPSG:{m[1]}" if m else None


def system(name: str | None) -> System:
    """The system of that name: a grid listed here, a zone of the universal grid (EPSG:326xx or 327xx), or degrees."""
    plain = name_of(name)
    if plain is None:
        raise ValueError(f"no coordinate system in {name!r}")
    if plain in SYSTEMS:
        return SYSTEMS[plain]
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", plain)
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"unknown coordinate system {plain}")
    return System(WGS84, 6 * int(m[2]) - 183.0, 0.0, 0.9996, 500000.0, 0.0 if m[1] == "6" else 10000000.0)


@dataclass(frozen=True)
class Series:
    """Numbers of a grid: rectifying radius, the meridian's length to the origin, and the terms of the series."""

    radius: float
    start: float
    forth: tuple[float, ...]
    back: tuple[float, ...]
    latitude: tuple[float, ...]
    ecc: float


def series(s: System) -> Series:
    n = s.ellipsoid.f / (2 - s.ellipsoid.f)
    n2, n3, n4 = n**2, n**3, n**4
    # The terms of the series up to the fourth power of n.
    forth = (n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280)
    back = (n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280)
    latitude = (2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630)
    radius = s.ellipsoid.a / (1 + n) * (1 + n2 / 4 + n4 / 64 + n**6 / 256) * s.scale
    ecc = 2 * math.sqrt(n) / (1 + n)
    p = math.radians(s.parallel)
    xi = math.atan(math.sinh(math.atanh(math.sin(p)) - ecc * math.atanh(ecc * math.sin(p))))
    return Series(radius, radius * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(forth))), forth, back, latitude, ecc)


def _point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), *([] if z is None else [z.alias("z")]))


def _sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _to_grid(s: System) -> list[Step]:
    """Steps from radians (longitude, latitude) to a grid."""
    k = series(s)

    def conformal(p: Column) -> Column:
        sin = F.sin(p["y"])
        return _point(p["x"] - math.radians(s.meridian), F.sinh(F.atanh(sin) - k.ecc * F.atanh(k.ecc * sin)))

    def sphere(p: Column) -> Column:
        return _point(F.atanh(F.sin(p["x"]) / F.sqrt(1 + p["y"] * p["y"])), F.atan2(p["y"], F.cos(p["x"])))

    def plane(p: Column) -> Column:
        j = [(2 * (i + 1), c) for i, c in enumerate(k.forth)]
        east = p["x"] + _sum([c * F.cos(m * p["y"]) * F.sinh(m * p["x"]) for m, c in j])
        north = p["y"] + _sum([c * F.sin(m * p["y"]) * F.cosh(m * p["x"]) for m, c in j])
        return _point(s.east + k.radius * east, s.north - k.start + k.radius * north)

    return [conformal, sphere, plane]


def _from_grid(s: System) -> list[Step]:
    """Steps from a grid to radians."""
    k = series(s)

    def scaled(p: Column) -> Column:
        return _point((p["x"] - s.east) / k.radius, (p["y"] - s.north + k.start) / k.radius)

    def sphere(p: Column) -> Column:
        j = [(2 * (i + 1), c) for i, c in enumerate(k.back)]
        return _point(p["x"] - _sum([c * F.cos(m * p["y"]) * F.sinh(m * p["x"]) for m, c in j]), p["y"] - _sum([c * F.sin(m * p["y"]) * F.cosh(m * p["x"]) for m, c in j]))

    def conformal(p: Column) -> Column:
        return _point(F.atan2(F.sinh(p["x"]), F.cos(p["y"])), F.asin(F.sin(p["y"]) / F.cosh(p["x"])))

    def geographic(p: Column) -> Column:
        return _point(p["x"] + math.radians(s.meridian), p["y"] + _sum([c * F.sin(2 * (i + 1) * p["y"]) for i, c in enumerate(k.latitude)]))

    return [scaled, sphere, conformal, geographic]


def matrix(shift: Sequence[float]) -> tuple[list[list[float]], list[float]]:
    """Rotation with scale, and translation, of a shift to WGS 84."""
    tx, ty, tz, rx, ry, rz, ppm = shift
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    m = 1 + ppm * 1e-6
    return [[m, -rz * m, ry * m], [rz * m, m, -rx * m], [-ry * m, rx * m, m]], [tx, ty, tz]


def inverse(rows: list[list[float]], move: list[float]) -> tuple[list[list[float]], list[float]]:
    """The shift back: the inverse matrix by cofactors, and what undoes the translation."""
    (a, b, c), (d, e, f), (g, h, i) = rows
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    back = [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]
    return back, [-sum(r[j] * move[j] for j in range(3)) for r in back]


def _shifted(rows: list[list[float]], move: list[float], source: Ellipsoid, target: Ellipsoid) -> list[Step]:
    """Steps from radians on one datum to radians on another."""
    e2 = source.f * (2 - source.f)
    b = target.a * (1 - target.f)
    t2, ep2 = target.f * (2 - target.f), target.f * (2 - target.f) / (1 - target.f) ** 2

    def solid(p: Column) -> Column:
        n = source.a / F.sqrt(1 - e2 * F.sin(p["y"]) * F.sin(p["y"]))
        return _point(n * F.cos(p["y"]) * F.cos(p["x"]), n * F.cos(p["y"]) * F.sin(p["x"]), n * (1 - e2) * F.sin(p["y"]))

    def moved(p: Column) -> Column:
        return _point(*(m + r[0] * p["x"] + r[1] * p["y"] + r[2] * p["z"] for r, m in zip(rows, move, strict=True)))

    def reduced(p: Column) -> Column:
        """Longitude, distance from the axis and reduced latitude, beside the height above the equator's plane."""
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return F.struct(F.atan2(p["y"], p["x"]).alias("x"), flat.alias("flat"), p["z"].alias("z"), F.atan2(p["z"] * target.a, flat * b).alias("t"))

    def geographic(p: Column) -> Column:
        sin, cos = F.sin(p["t"]), F.cos(p["t"])
        return _point(p["x"], F.atan2(p["z"] + ep2 * b * sin * sin * sin, p["flat"] - t2 * target.a * cos * cos * cos))

    return [solid, moved, reduced, geographic]


def steps(source: System, target: System) -> list[Step]:
    """What takes a point from ``source`` to ``target``."""
    if source == target:
        return []
    out: list[Step] = [lambda p: _point(F.radians(p["x"]), F.radians(p["y"]))] if source.meridian is None else _from_grid(source)
    if (source.ellipsoid, source.shift) != (target.ellipsoid, target.shift):
        if source.shift:
            out += _shifted(*matrix(source.shift), source.ellipsoid, WGS84)
        if target.shift:
            out += _shifted(*inverse(*matrix(target.shift)), WGS84, target.ellipsoid)
    return out + ([lambda p: _point(F.degrees(p["x"]), F.degrees(p["y"]))] if target.meridian is None else _to_grid(target))


def _points(points: Column, how: list[Step]) -> Column:
    for step in how:
        points = F.transform(points, step)
    return points


def converted(x: Column | str, y: Column | str, source: str, target: str) -> Column:
    """struct(x, y) of a point in the target system."""
    return F.get(_points(F.array(_point(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)), steps(system(source), system(target))), F.lit(0))


def reproject_points(points: DataFrame, source: str, target: str) -> DataFrame:
    """``points`` with x and y in the target system; a null or a place that the grid can't show gives null or NaN."""
    p = points.withColumn("_at", converted("x", "y", source, target))
    return p.withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")


def reproject_rings(shapes: DataFrame, source: str, target: str, rings: str = "rings") -> DataFrame:
    """``shapes`` with the corners of their rings in the target system; edges stay straight between them."""
    how = steps(system(source), system(target))
    return shapes.withColumn(rings, F.transform(rings, lambda r: _points(r, how))) if how else shapes
