"""Quadtree cells: bounded where points are dense, and no pair lost whatever the cells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from permitflow.operators import spatial
from permitflow.operators.cells import DEPTH, Grid, Quadtree, quadtree

RING = "array<array<struct<x:double,y:double>>>"


def clustered(n, seed=1):
    """Nine tenths of the points in a hundredth of the width, some at one place, some far out."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(500, 2, 9 * n // 10), rng.uniform(0, 1000, n - 9 * n // 10 - 20), np.full(20, 777.0)])
    y = np.concatenate([rng.normal(300, 2, 9 * n // 10), rng.uniform(0, 1000, n - 9 * n // 10 - 20), np.full(20, 777.0)])
    return x, y


def test_leaves_fill_the_root_and_hold_few():
    x, y = clustered(20_000)
    tree = Quadtree.learned(x, y, 50)
    n = np.bincount(tree.leaf_of(x, y), minlength=len(tree.first))
    assert n.sum() == len(x) and n.max() <= 50
    # An even grid of as many cells has most points in a few of them.
    side = int(len(tree.first) ** 0.5)
    even = np.unique(np.floor(x / 1000 * side) * side + np.floor(y / 1000 * side), return_counts=True)[1]
    assert even.max() > 20 * n.max()
    assert tree.first[0] == 0 and len(set(tree.first)) == len(tree.first) < 20_000 / 50 * 8


def test_one_place_and_none():
    tree = Quadtree.learned(np.full(1000, 3.0), np.full(1000, 4.0), 10)
    assert len(set(tree.leaf_of(np.array([3.0, 99.0]), np.array([4.0, -5.0])))) >= 1 and len(tree.first) <= 3 * DEPTH + 1
    none = Quadtree.learned(np.zeros(0), np.zeros(0))
    assert none.leaves_over(-9, -9, 9, 9) == [0] and list(none.leaf_of(np.array([5.0]), np.array([5.0]))) == [0]


def test_boxes_touch_the_leaves_of_all_points_in_them():
    x, y = clustered(3000)
    tree = Quadtree.learned(x, y, 20)
    rng = random.Random(3)
    for _ in range(300):
        a, b = rng.uniform(-100, 1100), rng.uniform(-100, 1100)
        c, d = a + rng.choice([0.0, 1.0, 30.0, 500.0]), b + rng.choice([0.0, 1.0, 30.0, 500.0])
        got = tree.leaves_over(a, b, c, d)
        px, py = np.array([rng.uniform(a, c) for _ in range(40)] + [a, c]), np.array([rng.uniform(b, d) for _ in range(40)] + [b, d])
        assert set(tree.leaf_of(px, py)) <= set(got) and got == sorted(set(got))


@pytest.fixture(scope="module")
def layers(spark):
    x, y = clustered(3000, 5)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 3.0), (-2, 5000.0, -4000.0)], "id long, x double, y double")
    rng = random.Random(9)

    def shape(k):
        a, b = (rng.gauss(500, 4), rng.gauss(300, 4)) if k % 3 else (rng.uniform(0, 1000), rng.uniform(0, 1000))
        w = rng.choice([0.7, 3.0, 60.0])
        return [[(a, b), (a + w, b + w / 3), (a + w, b + w), (a + w / 4, b + w)]]

    areas = spark.createDataFrame([(f"a{k}", shape(k)) for k in range(60)] + [("all", [[(-10.0, -10.0), (1010.0, -10.0), (1010.0, 1010.0), (-10.0, 1010.0)]])], f"area string, rings {RING}")
    return pts, areas


def test_same_pairs_by_any_cells(spark, layers):
    pts, areas = layers
    grid, tree = Grid(25.0, 25.0), quadtree(pts, F.col("x"), F.col("y"), 800, 10)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(spatial.within(pts, areas, grid).select("id", "area"))
    assert rows(spatial.within(pts, areas, tree).select("id", "area")) == rows(spatial.within(pts, areas).select("id", "area")) == want and len(want) > 3000
    some = areas.filter("area <> 'all'")
    assert rows(spatial.nearest(pts, some, "id", "area", 4.0)) == rows(spatial.nearest(pts, some, "id", "area", 4.0, grid))
    parcels = some.withColumnRenamed("area", "parcel")
    assert rows(spatial.overlay(parcels, areas, "parcel", "area", tree)) == rows(spatial.overlay(parcels, areas, "parcel", "area")) == rows(spatial.overlay(parcels, areas, "parcel", "area", grid))
    lines = some.select(F.col("area").alias("line"), F.col("rings")[0].alias("points"))
    assert rows(spatial.line_overlay(lines, some, "line", "area")) == rows(spatial.line_overlay(lines, some, "line", "area", grid))


def test_a_large_shape_over_a_sparse_layer_makes_few_rows(spark, layers):
    pts, areas = layers
    tree = quadtree(pts, F.col("x"), F.col("y"))
    whole = areas.filter("area = 'all'")
    assert spatial._dealt(whole, "rings", tree).count() <= len(tree.first) < 600 < spatial._dealt(whole, "rings", Grid(25.0, 25.0)).count()


def test_shapes_lie_in_few_cells_however_many_share_a_place(spark):
    box = "array(array(named_struct('x', {0}, 'y', {1}), named_struct('x', {0} + 15D, 'y', {1}), named_struct('x', {0} + 15D, 'y', {1} + 12D), named_struct('x', {0}, 'y', {1} + 12D)))"
    x, y = "cast(id % 130 * 17 % 130 as double)", "cast(id % 130 * 29 % 130 as double)"
    parcels = spark.range(13000).selectExpr("id as parcel", f"{box.format(x, y)} as rings")
    tree = spatial._learned(parcels, "rings")
    assert len(tree.first) >= 4 and spatial._dealt(parcels, "rings", tree).count() <= 4 * 13000
    strip = spark.range(5000).selectExpr("id as parcel", f"{box.format('id * 15D', '0D')} as rings")
    tree = spatial._learned(strip, "rings")
    assert len(tree.first) > 100 and spatial._dealt(strip, "rings", tree).count() <= 4 * 5000
    areas = strip.filter("parcel < 50").withColumnRenamed("parcel", "area")
    assert spatial.overlay(strip, areas, "parcel", "area").count() == 50


def test_boxes_go_down_together():
    r = np.random.default_rng(3)
    tree = Quadtree.learned(r.random(3000) ** 3 * 100, r.random(3000) * 40, 8)
    x0, y0 = r.random(400) * 140 - 20, r.random(400) * 60 - 10
    x1, y1 = x0 + r.random(400) * 20, y0 + r.random(400) * 20
    box, leaf = tree.leaves_of(x0, y0, x1, y1)
    px, py = r.random(20000) * 140 - 20, r.random(20000) * 60 - 10
    at = tree.leaf_of(px, py)
    for n in range(400):
        own = leaf[box == n]
        inside = (px >= x0[n]) & (px <= x1[n]) & (py >= y0[n]) & (py <= y1[n])
        assert len(set(own)) == len(own) and set(at[inside]) <= set(own)
