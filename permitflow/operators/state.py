"""The append-only state log: folding, matching, classifying, extending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two sources' names in keys.
PDF, API = "haifa_pdf", "yeela"


def fold(log: DataFrame, key: str = "key", order: str = "line_no") -> DataFrame:
    """The last line of each key. Every line is combined map-side; no window sees a whole key."""
    cols = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("last"))
    return last.select(key, *(F.col(f"last.{c}").alias(c) for c in cols))


def legacy_source(c: Column) -> Column:
    """The source an old bare id came from: seven digits are the API's, other digits the PDF's, anything else none."""
    s = F.trim(c)
    return F.when(s.rlike(r"^[0-9]{7}$"), API).when(s.rlike(r"^[0-9]+$"), PDF)


def natural_legacy_id(source: Column, licence_id: Column, source_id: Column) -> Column:
    """The id under which the predecessor would have stored a record."""
    return F.when(source == API, licence_id).otherwise(source_id)


def match(records: DataFrame, state: DataFrame) -> DataFrame:
    """``records`` (key, source, legacy_id, ...) with ``seen``, ``seen_stage`` and ``seen_first``: by key first, else by
    an old id of the same source. Two equi-joins instead of one OR condition, which would be a nested loop."""
    by_key = state.select(F.col("key").alias("k_key"), F.col("stage").alias("k_stage"), F.col("first_seen").alias("k_first"))
    old = state.select(F.col("source").alias("l_source"), F.explode("legacy_ids").alias("l_id"), F.col("stage").alias("l_stage"), F.col("first_seen").alias("l_first"))
    old = old.groupBy("l_source", "l_id").agg(F.min_by(F.struct("l_stage", "l_first"), F.struct("l_first", "l_stage")).alias("l"))
    j = records.join(by_key, F.col("key") == F.col("k_key"), "left")
    j = j.join(old, (F.col("source") == F.col("l_source")) & (F.col("legacy_id") == F.col("l_id")), "left")
    return j.select(
        *records.columns, (F.col("k_key").isNotNull() | F.col("l_id").isNotNull()).alias("seen"),
        F.when(F.col("k_key").isNotNull(), F.col("k_stage")).otherwise(F.col("l.l_stage")).alias("seen_stage"),
        F.when(F.col("k_key").isNotNull(), F.col("k_first")).otherwise(F.col("l.l_first")).alias("seen_first"),
    )


def classify(matched: DataFrame) -> DataFrame:
    """Adds ``kind``: fresh (never seen), update (seen as pending, licensed now) or known."""
    return matched.withColumn("kind", F.when(~F.col("seen"), "fresh").when((F.col("seen_stage") == "pending") & (F.col("stage") == "licensed"), "update").otherwise("known"))


def log_lines(delivered: DataFrame, state: DataFrame, today: Column) -> DataFrame:
    """State lines for delivered records: old ids are joined with those on file, and the first day seen stays."""
    s = state.select(F.col("key").alias("s_key"), F.col("legacy_ids").alias("s_ids"), F.col("first_seen").alias("s_first"))
    j = delivered.join(s, F.col("key") == F.col("s_key"), "left")
    own = F.when(F.col("legacy_id").isNotNull(), F.array("legacy_id")).otherwise(F.array().cast("array<string>"))
    ids = F.array_sort(F.array_union(F.coalesce("s_ids", F.array().cast("array<string>")), own))
    return j.withColumns({"legacy_ids": ids, "first_seen": F.coalesce("s_first", today)}).drop("s_key", "s_ids", "s_first", "legacy_id")


def migrate(ids: DataFrame, state: DataFrame) -> DataFrame:
    """State lines for old bare ids (column ``value``) that the log does not have; nothing on a second run."""
    n = ids.select(F.trim("value").alias("id"), legacy_source(F.col("value")).alias("source")).filter("source is not null").distinct()
    have = state.select(F.col("source").alias("h_source"), F.explode("legacy_ids").alias("h_id")).distinct()
    new = n.join(have, (F.col("source") == F.col("h_source")) & (F.col("id") == F.col("h_id")), "left_anti")
    return new.select(F.concat_ws(":", "source", F.lit("legacy"), "id").alias("key"), "source", F.col("id").alias("source_id"), F.lit(None).cast("string").alias("licence_id"), F.array("id").alias("legacy_ids"), F.lit(None).cast("date").alias("first_seen"), F.lit("licensed").alias("stage"))


def unmatched(misses: DataFrame, history: DataFrame, today: Column) -> DataFrame:
    """Misses (street, house, full_text) not on file, once each; a blank street is not recorded."""
    from permitflow.functions.text import clean_text

    m = misses.select(clean_text("street").alias("street"), clean_text("house").alias("house"), clean_text("full_text").alias("full_text")).filter("street <> ''")
    m = m.groupBy("street", "house").agg(F.min("full_text").alias("full_text"))
    return m.join(history.select("street", "house").distinct(), ["street", "house"], "left_anti").select(today.alias("first_seen"), "street", "house", "full_text")
