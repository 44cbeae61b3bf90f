"""Line dedup across sites, in DataFrame functions only.

A line's spread is the number of distinct sites (sources) it stands on. One aggregation by line hash merges a HyperLogLog
sketch of the sites; a line whose estimate is well above the threshold is boilerplate, well below it is not, and lines
near it get exact distinct counts. Boilerplate stays at its first place in the corpus (smallest doc_id, then position)
and is removed everywhere else, so no content is lost altogether.

Lines are compared without spaces, tabs and carriage returns at their ends; blank lines are never removed. Defined edge
cases: a null text stays null and has no lines; a null source is a site of its own; a null doc_id sorts after all ids as
a first place; repeated rows are occurrences like any other; an empty table gives an empty result; other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import cut, sized

MIN_SITES = 10
LG_K = 12
#: Three standard errors of the sketch, and one site at least, around the threshold count as near.
NEAR = 3 * 1.04 / (1 << LG_K) ** 0.5
EDGE = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, site, pos, h) of each line that isn't blank."""
    d = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    d = d.withColumn("line", F.btrim("line", F.lit(EDGE))).filter("line <> ''")
    return d.select("doc_id", "digest", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first): hashes of lines on ``min_sites`` sites or more, with the place that keeps the line. A written table."""
    o = _occurrences(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "pos")
    spread = cut(o.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(place).alias("first")
    ).filter(F.col("sites") >= min_sites - max(1.0, NEAR * min_sites)))
    margin = max(1.0, NEAR * min_sites)
    sure = spread.filter(F.col("sites") > min_sites + margin).select("h", "first")
    near = spread.filter(F.col("sites") <= min_sites + margin)
    # Distinct (line, site) pairs are combined map-side, so a hot line costs one row per task and site.
    pairs = o.join(near.select("h"), "h", "left_semi").select("h", "site").distinct()
    exact = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h")
    return cut(sure.unionByName(near.join(exact, "h", "left_semi").select("h", "first")))


def mark(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, digest, gone): positions of the lines to remove, for documents that lose any. A written table."""
    b = boilerplate(docs, min_sites)
    o = _occurrences(docs).select("doc_id", "digest", "pos", "h")
    # The boilerplate side is a written table: Catalyst broadcasts it if its size allows, else the join can be split by skew.
    j = o.join(b, "h")
    here = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest")) & (F.col("first.pos") == F.col("pos"))
    gone = j.filter(~here).groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone"))
    return cut(gone)


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """Each row as struct ``row``, with ``lines`` (null for a null text), and ``left``: positions that stay, or null for all."""
    m = sized(mark(docs, min_sites)).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_h"), F.col("gone").alias("_gone"))
    d = docs.select(F.struct(*docs.columns).alias("row"))
    j = d.join(m, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("row.text") == F.col("_h")), "left")
    j = j.select("row", "_gone", _lines(F.col("row.text")).alias("lines"))
    return j.withColumn("left", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("_gone"))))


def _text() -> Column:
    kept = F.array_join(F.expr("transform(left, i -> lines[i])"), "\n")
    return F.when(F.col("left").isNull(), F.col("row.text")).otherwise(kept)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with their columns; ``text`` without cross-site boilerplate and ``n_chars``, if there, to match."""
    c = _cleaned(docs, min_sites).withColumn("new", _text())
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return c.select(*(made.get(x, F.col("row").getField(x)).alias(x) for x in docs.columns))


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_md5 of the cleaned text (null text: empty) per row."""
    c = _cleaned(docs, min_sites).withColumn("new", F.coalesce(_text(), F.lit("")))
    return c.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.length("new").cast("long").alias("n_chars"), F.md5("new").alias("text_md5"),
    )
