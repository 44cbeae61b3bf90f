"""Reports for whoever keeps the lookup tables and the sources: what was not placed, what the API sends, what the pages hold.

Each gives sections of a text report (title, rows, most rows shown), from the operators that the engine has for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.functions.arrow import bidi_runs
from permitflow.operators import reports, spatial
from permitflow.operators.cells import Cells
from permitflow.operators.lineage import cut

Section = tuple[str, DataFrame, int]

# The bounds of distances in the report, and the words of action that are looked for.
EDGES = [0.0, 25.0, 100.0, 500.0, 2000.0, 10000.0, 1e9]
KEYWORDS = ["כריתה", "העתקה", "שימור", "גיזום", "מסוכן", "העתק"]
SHOWN_ROWS = 6


def outside(points: DataFrame, areas: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Points (id, x, y, street) in no area, with ``distance`` to the nearest; null beyond the last bound but one. A written
    table. Each bound is looked for among what the one before left, so far shapes meet few points."""
    inside = spatial.within(points, areas, cells).select("id").distinct()
    rest = cut(points.join(inside, "id", "left_anti"))
    a, found = areas.withColumn("area", F.xxhash64("rings")).select("area", "rings"), None
    left = rest
    for most in EDGES[1:-1]:
        near = cut(spatial.nearest(left, a, "id", "area", most, cells).select("id", F.round("distance", 1).alias("distance")))
        found = near if found is None else found.unionByName(near)
        left = cut(left.join(near.select("id"), "id", "left_anti"))
        if left.isEmpty():
            break
    return cut(rest.join(found, "id", "left"))


def unmatched(points: DataFrame, areas: DataFrame, misses: DataFrame) -> list[Section]:
    """Of the points that :func:`outside` gave: how far off they are, on which streets, and where both layers lie."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    far = misses.withColumn("distance", F.coalesce("distance", F.lit(EDGES[-2])))
    bins = reports.histogram(far, "distance", EDGES).select(F.get(F.array(*(F.lit(f"{a:g} to {b:g}") for a, b in zip(EDGES, EDGES[1:], strict=False))), F.col("bin") - 1).alias("metres"), "n", "bin").orderBy("bin").drop("bin")
    corner = F.explode(F.flatten("rings")).alias("p")
    return [
        ("points", count(points), 1), ("in no area", count(misses), 1), ("metres to the nearest area", bins, len(EDGES)),
        ("streets with the most such points: n, median of metres", reports.top_medians(far, "street", "distance", 25), 25),
        ("bounds of points", reports.bounding_box(points, "x", "y"), 1), ("bounds of areas", reports.bounding_box(areas.select(corner).select("p.x", "p.y"), "x", "y"), 1),
    ]


def api_profile(rows: DataFrame) -> list[Section]:
    """Fields of API rows and of the rows nested in them, how many of these a row has, and the row with most."""
    nested = rows.select(F.explode("expandRows").alias("e")).select("e.*")
    flat = [c for c in rows.columns if c not in ("expandRows", "ord")]
    n = F.coalesce(F.size("expandRows"), F.lit(0))
    sized = rows.withColumn("n", F.when(F.col("expandRows").isNull(), 0).otherwise(n))
    most = sized.agg(F.max_by(F.to_json(F.struct(*flat, "expandRows"), {"ignoreNullFields": "false"}), F.struct("n", F.col("requestId"))).alias("row"))
    return [
        ("fields of rows", reports.profile(rows, flat).orderBy("field"), 100), ("fields of nested rows", reports.profile(nested, nested.columns).orderBy("field"), 100),
        ("nested rows of a row", sized.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy("n"), 100), ("the row with most", most, 1),
    ]


def page_scan(pages: DataFrame) -> list[Section]:
    """Of captured tables (page, row, cells): the first rows' cells as they are, turned round and by writing direction, and in
    which columns words of action stand, either way round."""
    first = pages.agg(F.min("page")).first()[0]
    top = pages.filter((F.col("page") == F.lit(first)) & (F.col("row") < SHOWN_ROWS)).select("row", F.posexplode("cells").alias("cell", "text")).filter(F.trim("text") != "")
    shown = top.select("row", "cell", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("text"), F.reverse("text").alias("reversed"), bidi_runs("text").alias("directions")).orderBy("row", "cell")
    width = pages.agg(F.max(F.size("cells"))).first()[0] or 0
    cells = {f"{i:02d}": F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(width)}
    sections = [("pages with a table, rows, columns", pages.agg(F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("columns")), 1), ("first rows", shown, 200)]
    return [*sections, ("words of action by column", reports.keyword_matrix(pages, cells, KEYWORDS).orderBy("cell", "keyword"), 500)] if cells else sections
