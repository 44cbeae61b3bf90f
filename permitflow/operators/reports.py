"""Grouped digests, funnel counters, profiles and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.operators.running import running, spread

FUNNEL = ["pages", "raw_rows", "requests", "passed", "fresh"]


def digest(rows: DataFrame, group: Column, order: str, item: str) -> DataFrame:
    """(area, n, order, item): groups by descending count, then name, items in input order under each. Ordered rows, not a
    list per group: a group may be of any size, and the sort is by ranges of all three."""
    r = rows.select(group.alias("area"), order, item)
    n = r.groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return r.join(n.withColumnRenamed("area", "n_area"), F.col("area").eqNullSafe(F.col("n_area"))).select("area", "n", order, item).orderBy(F.desc("n"), "area", order)


def funnel(counters: DataFrame, stages: list[str] = FUNNEL) -> DataFrame:
    """``counters`` (source, failed, stage counts) with the first stage that is zero, and the stage that fed it."""
    names = F.array(*map(F.lit, stages))
    values = F.array(*(F.coalesce(F.col(s), F.lit(0)).cast("long") for s in stages))
    at = F.array_position(values, 0)
    first = F.when(at > 0, F.element_at(names, at.cast("int")))
    feeder = F.when(at > 1, F.element_at(names, (at - 1).cast("int")))
    return counters.select("*", first.alias("first_zero"), feeder.alias("fed_by"))


def combined(counters: DataFrame, stages: list[str] = FUNNEL) -> DataFrame:
    """Sums over the sources that did not fail."""
    return counters.filter(~F.col("failed")).agg(*(F.sum(s).alias(s) for s in stages), F.count(F.lit(1)).alias("sources"))


def period_rollup(rows: DataFrame, period: Column, measures: list[str], licence: str | None = None) -> DataFrame:
    """Sums by period, nulls as zero, with rows and distinct licences."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *(F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in measures)]
    return rows.groupBy(period.alias("period")).agg(*([F.count_distinct(licence).alias("n_licences")] if licence else []), *aggs)


def top_sums(rows: DataFrame, name: str, measure: str, n: int) -> DataFrame:
    """The ``n`` names of the largest positive sums, ties by name."""
    return rows.groupBy(name).agg(F.sum(measure).alias("total")).filter("total > 0").orderBy(F.desc("total"), name).limit(n)


def profile(df: DataFrame, columns: list[str], sample: int = 12) -> DataFrame:
    """(field, present, n_distinct, sample): one pass; presence means neither null nor empty."""
    text = {c: F.col(c).cast("string") for c in columns}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text[c].alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null and value <> ''")
    by = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    # A bounded sample per field: the smallest values, kept by rank rather than by gathering all of them.
    from pyspark.sql import Window

    low = by.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("r") <= sample)
    s = low.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return by.groupBy("field").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("n_distinct")).join(s, "field")


def keyword_matrix(rows: DataFrame, cells: dict[str, Column], keywords: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, cell, keyword, n): rows whose cell holds the keyword, forwards or backwards. One pass over the rows, one
    counter per pair; no row is multiplied."""
    by = by or []
    pairs = [(c, k) for c in cells for k in keywords]
    counts = rows.groupBy(*by).agg(*(F.count_if(cells[c].contains(k) | cells[c].contains(k[::-1])).alias(f"n{i}") for i, (c, k) in enumerate(pairs)))
    x = counts.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(k).alias("keyword"), F.col(f"n{i}").alias("n")) for i, (c, k) in enumerate(pairs)))).alias("x"))
    return x.select(*by, "x.*").filter("n > 0")


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n) of left-closed bins between ``edges``."""
    i = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + (F.col(value) >= e).cast("int"))
    return rows.select(i.alias("bin")).filter((F.col("bin") > 0) & (F.col("bin") < len(edges))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def longest(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """The one row (key, size) of the largest size; ties go to the smallest ``order``."""
    return rows.agg(F.max_by(F.struct(key, size), F.struct(size, (-F.col(order)).alias("o"))).alias("b")).select("b.*")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median) with the exact median. Equal values are counted map-side first; running counts over the distinct
    values of a key, which may lie in many partitions, then find the middle, without holding a group."""
    c = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("_key", F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))))
    c = running(spread(c, ["_key"], [value]), "_key", {"upto": F.col("c")})
    n = c.groupBy(F.col("_key").alias("n_key")).agg(F.sum("c").alias("n"))
    j = c.join(n, F.col("_key") == F.col("n_key"))
    # The places of the lower and upper middle, from 1; both lie in one row or in two.
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)
    return j.groupBy(key, "n").agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def top_medians(rows: DataFrame, key: str, value: str, most: int = 25) -> DataFrame:
    """The ``most`` largest groups with their medians, ties by name."""
    return medians(rows, key, value).orderBy(F.desc("n"), key).limit(most)


def statuses(rows: DataFrame, status: str) -> DataFrame:
    """(status, n): rows by status, null as empty, the most frequent first."""
    return rows.groupBy(F.coalesce(status, F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def pending_summary(rows: DataFrame, licence: str, request: str, trees: str) -> DataFrame:
    """(n_rows, n_requests, n_trees) of rows without a licence."""
    p = rows.filter(F.col(licence).isNull() | (F.col(licence).cast("string") == ""))
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(request).alias("n_requests"), F.coalesce(F.sum(trees), F.lit(0)).alias("n_trees"))


def weakest(rows: DataFrame, support: str, least: float, most: int, *order: str) -> DataFrame:
    """At most ``most`` rows whose support is below ``least``, weakest first: a section of the quality report."""
    return rows.filter(F.col(support) < least).orderBy(support, *order).limit(most)


def crossing(rows: DataFrame, key: str = "street_key", area: str = "neighborhood") -> DataFrame:
    """(key, n_areas) of index keys in more than one area."""
    return rows.groupBy(key).agg(F.count_distinct(area).alias("n_areas")).filter("n_areas > 1")


def bounding_box(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def dataset_counts(records: DataFrame) -> DataFrame:
    """Counts of the flat statistics dataset by source, with undated records, felled trees and the span of years."""
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("date").isNull()).alias("undated"), F.sum("fell").alias("felled"),
        F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"), F.count_distinct(F.year("date")).alias("n_years"),
    )


def stat_record(r: DataFrame, date_kind: str) -> DataFrame:
    """Flat statistics rows of merged, placed records."""
    date = F.col("published")
    return r.select(
        F.col("key").alias("id"), "source", date.alias("date"), F.lit(date_kind).alias("date_kind"), "appeal_last", "neighborhood", F.col("method").alias("geo_method"),
        "street", "house", "block", "parcel", F.col("fell_count").alias("fell"), F.col("relocate_count").alias("relocate"), F.col("preserve_count").alias("preserve"), "species", "applicant",
    )
