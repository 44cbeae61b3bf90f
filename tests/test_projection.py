"""Grids and datum shifts against published worked examples, round trips, and names of systems."""

from __future__ import annotations

import pytest

from permitflow.operators import projection as P
from permitflow.sources import tables


def test_published_example(spark):
    """The worked example of a transverse Mercator grid in the public guidance note on coordinate conversions."""
    grid = P.System(P.Ellipsoid(6377563.396, 1 / 299.3249646), -2.0, 49.0, 0.9996012717, 400000.0, -100000.0)
    geo = P.System(P.Ellipsoid(6377563.396, 1 / 299.3249646))
    p = spark.createDataFrame([(0.5, 50.5)], "x double, y double").selectExpr("array(struct(x, y)) as p")
    got = p.select(P._points(p.p, P.steps(geo, grid)).alias("q")).first().q[0]
    assert (got.x, got.y) == pytest.approx((577274.99, 69740.50), abs=0.01)
    back = p.select(P._points(P._points(p.p, P.steps(geo, grid)), P.steps(grid, geo)).alias("q")).first().q[0]
    assert (back.x, back.y) == pytest.approx((0.5, 50.5), abs=1e-11)


def test_round_trips_within_a_millimetre(spark):
    p = spark.createDataFrame([(float(x), float(y)) for x in range(100_000, 300_000, 20_000) for y in range(350_000, 850_000, 50_000)] + [(None, 1.0)], "x double, y double")
    for other in ("EPSG:4326", "EPSG:6991", "EPSG:32636", "EPSG:32736"):
        q = P.reproject_points(P.reproject_points(p, "EPSG:2039", other), other, "EPSG:2039")
        for a, b in zip(p.collect(), q.collect(), strict=True):
            assert (a.x is None and b.x is None) or (b.x, b.y) == pytest.approx((a.x, a.y), abs=1e-3)


def test_origin_and_shift(spark):
    """A grid's false origin is its meridian and parallel; the old datum lies some seventy metres from WGS 84."""
    o = spark.createDataFrame([(219529.584, 626907.39)], "x double, y double")
    same = P.reproject_points(o, "EPSG:6991", "EPSG:4326").first()
    assert (same.x, same.y) == pytest.approx((35 + 12 / 60 + 16.261 / 3600, 31 + 44 / 60 + 3.817 / 3600), abs=1e-9)
    a, b = P.reproject_points(o, "EPSG:2039", "EPSG:32636").first(), P.reproject_points(o, "EPSG:6991", "EPSG:32636").first()
    assert 5 < ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 < 200
    there, back = P.matrix(P.SYSTEMS["EPSG:2039"].shift), P.inverse(*P.matrix(P.SYSTEMS["EPSG:2039"].shift))
    at = (4.4e6, 3.1e6, 3.3e6)
    moved = [m + sum(r[j] * at[j] for j in range(3)) for r, m in zip(*there, strict=True)]
    assert [m + sum(r[j] * moved[j] for j in range(3)) for r, m in zip(*back, strict=True)] == pytest.approx(at, abs=1e-8)


def test_names():
    assert P.name_of('{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::2039"}}') == P.name_of("epsg:2039") == "EPSG:2039"
    assert P.name_of("urn:ogc:def:crs:OGC:1.3:CRS84") == "EPSG:4326" and P.name_of(None) is P.name_of("") is P.name_of('{"type":"link"}') is None
    assert P.system("EPSG:32736").north == 10000000.0 and P.system("EPSG:32636").meridian == 33.0
    for bad in ("EPSG:32699", "EPSG:1", "grid", None):
        with pytest.raises(ValueError):
            P.system(bad)
    assert P.steps(P.system("EPSG:2039"), P.system("EPSG:2039")) == []


def test_layers_of_two_systems_are_refused(spark):
    two = spark.createDataFrame([("EPSG:2039",), (None,)], "crs string")
    with pytest.raises(ValueError, match="mixes"):
        tables.layer(two)
    assert tables.layer(two.filter("crs is not null"))[1] == "EPSG:2039" and tables.layer(two.filter("crs is null"), "EPSG:6991")[1] == "EPSG:6991"
