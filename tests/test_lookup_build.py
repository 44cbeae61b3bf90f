from __future__ import annotations

from permitflow.functions.arrow import direction_runs
from permitflow.operators.cells import Grid
from permitflow.plans import lookup_build

RING = "array<array<struct<x:double,y:double>>>"


def test_street_index(spark):
    sq = lambda x: [[(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)]]
    areas = spark.createDataFrame([("A", sq(0.0)), ("B", sq(10.0)), ("road", sq(20.0))], f"neighborhood string, rings {RING}")
    pts = [(i, 2.0 if h <= 4 else 12.0, 5.0, "רחוב ציון", str(h)) for i, h in enumerate([1, 2, 3, 4, 5, 6, 7])]
    pts += [(20, 3.0, 12.0, "חזן יעקב", "1"), (21, 3.0, 5.0, "חזן יעקב", ""), (30, 25.0, 5.0, "כביש", "1"), (31, 3.0, 5.0, "?", "1"), (32, 500.0, 500.0, "רחוק", "1")]
    points = spark.createDataFrame(pts, "id int, x double, y double, street string, house string")
    lines = spark.createDataFrame([("יעקב חזן", [(1.0, 1.0), (2.0, 1.0)]), ("קו", [(8.0, 5.0), (14.0, 5.0)]), ("ציון", [(0.0, 0.0), (1.0, 1.0)])], "street string, points array<struct<x:double,y:double>>")
    legacy = spark.createDataFrame([("ישן", "A"), ("קו", "A"), ("77", "A"), ("ריק", "0")], "street string, neighborhood string")
    aliases = spark.createDataFrame([("B", "BB"), ("road", "")], "alias string, canonical string")
    got = sorted((r.street_key, r.house_from, r.house_to, r.neighborhood, r.priority, r.method) for r in lookup_build.street_index(points, areas, lines, legacy, aliases, Grid(10.0, 10.0)).collect())
    assert got == sorted([
        ("ציון", 0, 4, "A", 1, "points_range"), ("ציון", 5, 99999, "BB", 1, "points_range"), ("ציון", 0, 99999, "A", 2, "points_street"), ("חזן יעקב", 0, 99999, "A", 1, "points_range"),
        ("יעקב חזן", 0, 99999, "A", 1, "points_range_wordorder"), ("קו", 0, 99999, "BB", 3, "segment_majority"), ("ישן", 0, 99999, "A", 4, "legacy_table"),
    ])


def test_direction_runs():
    assert direction_runs("שלום 12a-") == "R*4 S*1 N*2 L*1 O*1"
