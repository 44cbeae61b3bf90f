"""Building the street index: point ranges, street majorities, centrelines, an old table, then names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.operators import index, ranges, spatial
from permitflow.operators.cells import Cells
from permitflow.operators.lineage import cut

WHOLE = (0, 99999)
SNAP = 25.0
COLUMNS = ["street_key", "street_display", "house_from", "house_to", "neighborhood", "priority", "method", "support", "ord"]


def place_points(points: DataFrame, areas: DataFrame, cells: Cells | None = None, snap: float = SNAP) -> DataFrame:
    """Address points (id, x, y, street, house) with their area: the one they lie in, else the nearest within ``snap``."""
    a = areas.withColumn("neighborhood", T.clean_text("neighborhood")).filter("neighborhood <> ''")
    inside = cut(spatial.within(points, a, cells))
    rest = points.join(inside.select("id").distinct(), "id", "left_anti")
    near = spatial.nearest(rest, a, "id", "neighborhood", snap, cells).select("id", "neighborhood")
    return inside.unionByName(rest.join(near, "id").select(*inside.columns))


def _row(df: DataFrame, priority: int, method: str) -> DataFrame:
    """A tier's rows; ``ord`` is built from the key, so that order does not depend on partitions."""
    d = df if "house_from" in df.columns else df.withColumns({"house_from": F.lit(WHOLE[0]), "house_to": F.lit(WHOLE[1])})
    d = d.withColumns({"priority": F.lit(priority), "method": F.lit(method), "support": F.col("support").cast("double")})
    return d.withColumn("ord", F.struct("priority", "street_key", "house_from", F.lit(0).alias("k"))).select(*COLUMNS)


def street_index(points: DataFrame, areas: DataFrame, lines: DataFrame | None, legacy: DataFrame | None, aliases: DataFrame | None, cells: Cells | None = None, min_run: int = 2, min_support: int = 1, merge_words: bool = True) -> DataFrame:
    """Index rows. ``lines``: (street, points); ``legacy``: (street, neighborhood); ``aliases``: (alias, canonical)."""
    p = place_points(points, areas, cells).withColumn("street_key", T.normalize_street("street"))
    p = cut(p.filter(~F.col("street_key").isin(T.PLACEHOLDER_STREETS)).filter("street_key <> ''").withColumn("house_no", T.house_number("house")))
    shown = p.groupBy("street_key").agg(F.min_by(T.clean_text("street"), "id").alias("street_display"))
    houses = ranges.modal(p.filter("house_no is not null"), ["street_key", "house_no"], "neighborhood", "id").select("street_key", "house_no", "neighborhood")
    first = cut(ranges.build(houses, "street_key", "house_no", "neighborhood", min_run, min_support).join(shown, "street_key"))
    one = first.groupBy("street_key").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("street_key")
    whole = ranges.modal(p, ["street_key"], "neighborhood", "id").join(one, "street_key", "left_anti").join(shown, "street_key").withColumn("support", F.col("n"))
    rows = _row(first, 1, "points_range").unionByName(_row(whole.select("street_key", "street_display", "neighborhood", "support"), 2, "points_street"))
    if lines is not None:
        named = lines.withColumn("street_key", T.normalize_street("street")).filter("street_key <> ''")
        named = cut(index.missing_tier(named, p).withColumn("id", F.xxhash64("street_key", "points")))
        parts = spatial.line_overlay(named.select("id", "points").distinct(), areas, "id", "neighborhood", cells)
        sized = named.select("id", "street_key").distinct().join(parts, "id")
        major = index.share_majority(sized, ["street_key"], "neighborhood", "length")
        names = named.groupBy("street_key").agg(F.min(T.clean_text("street")).alias("street_display"))
        rows = rows.unionByName(_row(major.join(names, "street_key"), 3, "segment_majority"))
    rows = cut(rows)
    if legacy is not None:
        old = legacy.select(T.clean_text("street").alias("street_display"), T.clean_text("neighborhood").alias("neighborhood")).withColumn("street_key", T.normalize_street("street_display"))
        old = old.filter((F.col("street_key") != "") & ~F.col("neighborhood").isin("", "0")).filter(T.usable_street("street_key"))
        old = old.groupBy("street_key").agg(F.min_by(F.struct("street_display", "neighborhood"), F.struct("street_display", "neighborhood")).alias("r")).select("street_key", "r.*", F.lit(0.0).alias("support"))
        rows = cut(rows.unionByName(_row(index.missing_tier(old, rows), 4, "legacy_table")))
    rows = rows.unionByName(index.alias_rows(rows))
    if aliases is not None:
        rows = index.rename_areas(rows, aliases)
    rows = cut(rows)
    return index.merge_word_order(rows) if merge_words else rows
