"""Running totals per key in an order, where one key may hold any share of the rows.

Rows are range-sorted by key and order and written, so a large key lies in many partitions. Totals run within each
(key, partition), which is no larger than a partition, and the totals of a key's earlier partitions, one row each, are
added. Nothing holds the rows of a key together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitflow.operators.lineage import cut


def spread(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted by ``key`` and ``order`` (nulls first) over partitions, as a written table with two more columns:
    ``_part``, the partition, and ``_at``, which grows along the order. Rows equal in all of these are in any order."""
    by = [F.asc_nulls_first(c) for c in (*key, *order)]
    at = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut(at.withColumn("_part", F.shiftright("_at", 33).cast("int")))


def running(df: DataFrame, key: str, sums: Mapping[str, Column]) -> DataFrame:
    """``df``, rows of a :func:`spread` table, with the total of each of ``sums`` over the rows of its ``key`` up to and
    with itself. ``key`` holds no nulls."""
    part = [key, "_part"]
    here = Window.partitionBy(*part).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    local = df.withColumns({n: F.sum(c).over(here) for n, c in sums.items()})
    totals = df.groupBy(*part).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = totals.select(*part, *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    out = local.join(before, part)
    return out.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))
