"""Line rows to one record per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_where(value: str, order: str, condition: str) -> Column:
    """``value`` of the first row by ``order`` that meets ``condition``; null if none does."""
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {condition})")


def merge_requests(rows: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """One row per ``key``. ``order`` is a total order: "first" means first by it.

    Counts add up; street and house come as a pair from the first row with a street; the appeal date is the latest, the
    publication date the earliest; one licensed row makes the request licensed and one row without appeal bars appeal.
    """
    pair = first_where("struct(street, house)", order, "street <> ''")
    return rows.groupBy(key).agg(
        *(F.sum(c).alias(c) for c in ("fell_count", "relocate_count", "preserve_count")),
        F.coalesce(pair, F.expr(f"min_by(struct(street, house), {order})")).alias("pair"),
        F.max("appeal_last").alias("appeal_last"),
        F.min("published").alias("published"),
        first_where("licence_id", order, "licence_id is not null and licence_id <> ''").alias("licence_id"),
        F.when(F.bool_or(F.col("stage") == "licensed"), "licensed").otherwise("pending").alias("stage"),
        F.bool_and("can_appeal").alias("can_appeal"),
        *(F.coalesce(first_where(c, order, f"{c} <> ''"), F.lit("")).alias(c) for c in ("applicant", "block", "parcel", "reason")),
        *(F.expr(f"min_by({c}, {order})").alias(c) for c in ("source", "source_id") if c in rows.columns),
    ).select(key, "pair.street", "pair.house", *(c for c in rows.columns if c not in (key, order, "street", "house", "species", "count")))


def sum_by_name(rows: DataFrame, key: str, name: str, n: str, order: str) -> DataFrame:
    """(key, species): per name sums as array<struct(name, n)>, larger first, ties by first appearance.

    The first level is combined map-side; an array holds one entry per distinct name of a request.
    """
    level = rows.filter(F.col(name).isNotNull()).groupBy(key, F.col(name).alias("name")).agg(F.sum(n).alias("n"), F.min(order).alias("first"))
    entry = F.struct((-F.col("n")).alias("rank"), "first", "name", "n")
    return level.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["name"].alias("name"), s["n"].alias("n"))).alias("species"))


def open_window(rows: DataFrame, as_of: Column | str, keep_undated: bool, date: str = "appeal_last") -> DataFrame:
    """Rows whose last day for appeal has not passed; undated ones as the source's rule says."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    still = F.col(date) >= day
    return rows.filter(still | F.col(date).isNull() if keep_undated else still)


def pending(rows: DataFrame) -> DataFrame:
    """Requests under review that ask for felling."""
    return rows.filter((F.col("stage") == "pending") & (F.col("fell_count") > 0))


def open_licences(rows: DataFrame, as_of: str) -> DataFrame:
    """Licensed requests with felling whose window is open or undated."""
    return open_window(rows.filter((F.col("stage") == "licensed") & (F.col("fell_count") > 0)), as_of, keep_undated=True)


def back_dated(published: Column, as_of: Column, days: int = 5) -> Column:
    """Whether a record first seen on ``as_of`` was published more than ``days`` before."""
    return F.datediff(as_of, published) > days
