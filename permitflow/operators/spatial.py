"""Spatial joins without a geometry library. Shapes are ``rings``: array<array<struct<x double, y double>>>, even-odd.

Shapes are dealt to the cells that their boxes touch, so every join is an equi-join on a cell; containment and distance are
JVM expressions, overlays an Arrow function on the pairs whose boxes touch. Cells are those of a quadtree learned from the
points (of shapes: the centres of both layers' boxes, and no smaller than their middle size), unless the caller names
others. All layers of one call must be in one planar coordinate system; :mod:`projection` brings them there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from permitflow.operators.cells import Cells, Quadtree, quadtree


def _box(rings: Column) -> tuple[Column, Column, Column, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _dealt(shapes: DataFrame, rings: str, cells: Cells, margin: float = 0.0) -> DataFrame:
    """``shapes`` once per cell that its box, widened by ``margin``, touches."""
    x0, y0, x1, y1 = _box(F.col(rings))
    return shapes.withColumn("cell", F.explode(cells.over(x0 - margin, y0 - margin, x1 + margin, y1 + margin)))


def _learned(shapes: DataFrame, rings: str) -> Quadtree:
    x0, y0, x1, y1 = _box(F.col(rings))
    return quadtree(shapes, (x0 + x1) / 2, (y0 + y1) / 2, size=F.greatest(x1 - x0, y1 - y0))


def _meeting(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cells: Cells) -> DataFrame:
    """Distinct (left_key, right_key) of shapes (key, rings) whose boxes touch. Boxes are compared where shapes share a cell,
    before anything is moved for it; pairs that meet in several cells count once."""

    def dealt(shapes: DataFrame, key: str, box: str) -> DataFrame:
        low_high = F.struct(*(c.alias(n) for c, n in zip(_box(F.col("rings")), ("x0", "y0", "x1", "y1"), strict=True)))
        return _dealt(shapes.select(key, "rings"), "rings", cells).select(key, "cell", low_high.alias(box))

    both = dealt(left, left_key, "p").join(dealt(right, right_key, "q"), "cell")
    return both.filter("p.x0 <= q.x1 and q.x0 <= p.x1 and p.y0 <= q.y1 and q.y0 <= p.y1").select(left_key, right_key).distinct()


def _edges(rings: str) -> str:
    """SQL: array of struct(ax, ay, bx, by) of all closed rings."""
    return (f"flatten(transform({rings}, r -> transform(r, (p, i) -> named_struct('ax', p.x, 'ay', p.y, 'bx', "
            "r[(i + 1) % size(r)].x, 'by', r[(i + 1) % size(r)].y))))")


def inside(rings: str, x: str, y: str) -> Column:
    """Whether a point lies inside; the boundary does not count."""
    e = _edges(rings)
    cross = f"aggregate({e}, 0, (n, s) -> n + if((s.ay > {y}) <> (s.by > {y}) and {x} < (s.bx - s.ax) * ({y} - s.ay) / (s.by - s.ay) + s.ax, 1, 0))"
    on = (f"exists({e}, s -> (s.bx - s.ax) * ({y} - s.ay) = (s.by - s.ay) * ({x} - s.ax) and {x} between least(s.ax, s.bx) and greatest(s.ax, s.bx) "
          f"and {y} between least(s.ay, s.by) and greatest(s.ay, s.by))")
    return F.expr(f"{cross} % 2 = 1 and not {on}")


def within(points: DataFrame, areas: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Points (x, y, ...) with every area (rings, ...) that they lie in; overlapping areas repeat the point."""
    cells = cells or quadtree(points, F.col("x"), F.col("y"))
    p = points.withColumn("cell", cells.at(F.col("x"), F.col("y")))
    return p.join(_dealt(areas, "rings", cells), "cell").filter(inside("rings", "x", "y")).drop("cell", "rings")


def nearest(points: DataFrame, areas: DataFrame, key: str, area: str, most: float, cells: Cells | None = None) -> DataFrame:
    """(key, area, distance) of the nearest area boundary within ``most``, for points not inside. Ties: smaller area."""
    cells = cells or quadtree(points, F.col("x"), F.col("y"))
    a = _dealt(areas, "rings", cells, margin=most)
    p = points.withColumn("cell", cells.at(F.col("x"), F.col("y")))
    e = _edges("rings")
    t = "greatest(0D, least(1D, coalesce(try_divide((x - s.ax) * (s.bx - s.ax) + (y - s.ay) * (s.by - s.ay), power(s.bx - s.ax, 2) + power(s.by - s.ay, 2)), 0D)))"
    d = f"array_min(transform({e}, s -> sqrt(power(s.ax + {t} * (s.bx - s.ax) - x, 2) + power(s.ay + {t} * (s.by - s.ay) - y, 2))))"
    j = p.join(a, "cell").withColumn("distance", F.expr(d)).filter(F.col("distance") <= most)
    return j.groupBy(key).agg(F.min_by(F.struct(area, "distance"), F.struct("distance", area)).alias("b")).select(key, f"b.{area}", "b.distance")


def _segments(rings: list) -> list[tuple[float, float, float, float]]:
    out = []
    for r in rings:
        pts = [(p["x"], p["y"]) for p in r]
        out += [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True) if a != b]
    return out


def _spans(segments: list, y: float) -> list[tuple[float, float]]:
    xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for ax, ay, bx, by in segments if (ay > y) != (by > y))
    return list(zip(xs[::2], xs[1::2], strict=False))


def _meet(s: tuple, t: tuple) -> float | None:
    """Share of segment ``s`` at which it crosses ``t``, or None."""
    ax, ay, bx, by = s
    cx, cy, dx, dy = t
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if den == 0:
        return None
    u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
    v = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
    return u if 0 <= u <= 1 and 0 <= v <= 1 else None


def overlap_area(a: list, b: list) -> float:
    """Area that two even-odd shapes share. Between the heights of all corners and crossings the shared width is linear,
    so its middle value times the height is exact, for concave shapes and holes too."""
    sa, sb = _segments(a), _segments(b)
    ys = {y for s in sa + sb for y in (s[1], s[3])}
    ys |= {s[1] + u * (s[3] - s[1]) for s in sa for t in sb if (u := _meet(s, t)) is not None}
    total, at = 0.0, sorted(ys)
    for low, high in zip(at, at[1:], strict=False):
        mid = (low + high) / 2
        width = sum(max(0.0, min(r, q) - max(left, p)) for left, r in _spans(sa, mid) for p, q in _spans(sb, mid))
        total += width * (high - low)
    return total


def overlap_length(line: list, b: list) -> float:
    """Length of a line (array of points) within a shape."""
    sb = _segments(b)
    total = 0.0
    for p, q in zip(line, line[1:], strict=False):
        s = (p["x"], p["y"], q["x"], q["y"])
        cuts = sorted({0.0, 1.0, *(u for t in sb if (u := _meet(s, t)) is not None)})
        for u, v in zip(cuts, cuts[1:], strict=False):
            m = (u + v) / 2
            x, y = s[0] + m * (s[2] - s[0]), s[1] + m * (s[3] - s[1])
            if any(left < x < right for left, right in _spans(sb, y)):
                total += (v - u) * ((s[2] - s[0]) ** 2 + (s[3] - s[1]) ** 2) ** 0.5
    return total


@F.pandas_udf(DoubleType())
def shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def shared_length(line: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_length(list(x), y) for x, y in zip(line, b, strict=True)], dtype="float64")


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cells: Cells | None = None) -> DataFrame:
    """(left_key, right_key, area) of each pair of shapes with a shared area. Pairs that meet in several cells count once."""
    cells = cells or _learned(left.select("rings").unionAll(right.select("rings")), "rings")
    pairs = _meeting(left, right, left_key, right_key, cells)
    j = pairs.join(left.select(left_key, F.col("rings").alias("ra")), left_key).join(right.select(right_key, F.col("rings").alias("rb")), right_key)
    return j.withColumn("area", shared_area("ra", "rb")).filter("area > 0").select(left_key, right_key, "area")


def line_overlay(lines: DataFrame, areas: DataFrame, left_key: str, right_key: str, cells: Cells | None = None) -> DataFrame:
    """(left_key, right_key, length) of lines (``points``) within areas."""
    of = lines.select(left_key, F.array("points").alias("rings"))
    cells = cells or _learned(of.select("rings").unionAll(areas.select("rings")), "rings")
    pairs = _meeting(of, areas, left_key, right_key, cells)
    j = pairs.join(lines.select(left_key, "points"), left_key).join(areas.select(right_key, F.col("rings").alias("rb")), right_key)
    return j.withColumn("length", shared_length("points", "rb")).filter("length > 0").select(left_key, right_key, "length")
