"""Building the lookup tables: aliases, tiers, word-order variants, area majorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.operators.lineage import cut


def _jumped(state: DataFrame, rounds: int) -> DataFrame:
    """``state`` (alias, to, open) after at most ``rounds`` in which every open end jumps to its end's end, so that steps
    double. A written table; an end is open while it is an alias itself."""
    state = cut(state)
    for _ in range(rounds):
        ahead = state.filter("open")
        if ahead.isEmpty():
            break
        end = state.select(F.col("alias").alias("e_alias"), F.col("to").alias("e_to"), F.col("open").alias("e_open"))
        moved = ahead.join(end, F.col("to") == F.col("e_alias")).select("alias", F.col("e_to").alias("to"), F.col("e_open").alias("open"))
        state = cut(state.filter("not open").unionByName(moved))
    return state


def canonical(aliases: DataFrame) -> DataFrame:
    """(alias, canonical): chains followed to their end, or to the name at which they enter a cycle, by pointer doubling in
    rounds that grow with the logarithm of the longest chain. A name on a cycle stands for itself.

    ``aliases`` has one row per alias. After as many steps as there are names, whatever is still open has gone round a
    cycle, and the names it stands on are those of the cycles; cut there, the rest are chains with an end.
    """
    a = cut(aliases.select("alias", F.col("canonical").alias("to")))
    rounds = a.count().bit_length()
    names = a.select(F.col("alias").alias("k"))
    state = _jumped(a.join(names, F.col("to") == F.col("k"), "left").select("alias", "to", F.col("k").isNotNull().alias("open")), rounds)
    done = state.filter("not open").select("alias", "to")
    rest = state.filter("open")
    if not rest.isEmpty():
        cycle = cut(rest.select(F.col("to").alias("k")).distinct())
        tails = a.join(rest.select("alias"), "alias", "left_semi").join(cycle, F.col("alias") == F.col("k"), "left_anti")
        tails = tails.join(cycle, F.col("to") == F.col("k"), "left").select("alias", "to", F.col("k").isNull().alias("open"))
        done = done.unionByName(_jumped(tails, rounds).select("alias", "to")).unionByName(cycle.select(F.col("k").alias("alias"), F.col("k").alias("to")))
    return done.select("alias", F.col("to").alias("canonical"))


def rename_areas(rows: DataFrame, aliases: DataFrame, column: str = "neighborhood") -> DataFrame:
    """One hop of aliases; rows whose area is named empty are dropped."""
    a = aliases.select(F.col("alias").alias("a_alias"), F.col("canonical").alias("a_to"))
    j = rows.join(a, F.col(column) == F.col("a_alias"), "left")
    named = F.when(F.col("a_alias").isNotNull(), F.col("a_to")).otherwise(F.col(column))
    return j.withColumn(column, named).filter(F.coalesce(F.col(column), F.lit("")) != "").drop("a_alias", "a_to")


def alias_rows(rows: DataFrame) -> DataFrame:
    """Clones of index rows under the other keys of their display name: priority + 3, method + _alias. A key and range
    already there is not cloned; of several clones the one of the earliest row stays."""
    keys = T.street_keys("street_display")
    c = rows.select("*", F.posexplode(F.slice(keys, 2, 1000)).alias("k", "alias")).filter("alias <> street_key")
    c = c.join(rows.select(F.col("street_key").alias("alias"), "house_from", "house_to").distinct(), ["alias", "house_from", "house_to"], "left_anti")
    cols = [x for x in rows.columns if x not in ("street_key", "house_from", "house_to")]
    one = c.groupBy("alias", "house_from", "house_to").agg(F.min_by(F.struct(*cols), F.struct("ord", "k")).alias("r"))
    one = one.select(F.col("alias").alias("street_key"), "house_from", "house_to", "r.*")
    return one.withColumns({"priority": F.col("priority") + 3, "method": F.concat("method", F.lit("_alias"))}).select(*rows.columns)


def merge_word_order(rows: DataFrame) -> DataFrame:
    """Spellings of one word set share the answer of the best tier.

    In a set with two spellings or more, the first best-priority row's spelling keeps its best-priority rows; every
    other spelling gets clones of all best-priority rows, marked _wordorder; all else of the set is dropped.
    """
    tokens = F.array_sort(F.array_distinct(F.split("street_key", " ")))
    r = rows.withColumn("tokens", tokens)
    sets = r.filter(F.size("tokens") > 1).groupBy("tokens").agg(
        F.count_distinct("street_key").alias("spellings"), F.min("priority").alias("best"), F.min_by("street_key", F.struct("priority", "ord")).alias("kept_key"), F.collect_set("street_key").alias("keys")
    ).filter("spellings > 1")
    j = r.join(sets, "tokens", "left")
    stay = j.filter("best is null or (street_key = kept_key and priority = best)").select(*rows.columns)
    clone = j.filter("best is not null and priority = best").withColumn("other", F.explode(F.array_except("keys", F.array("kept_key"))))
    clone = clone.withColumns({"street_key": F.col("other"), "method": F.concat("method", F.lit("_wordorder"))}).select(*rows.columns)
    return stay.unionByName(clone)


def missing_tier(candidates: DataFrame, covered: DataFrame, key: str = "street_key") -> DataFrame:
    """Rows of a lower tier for keys that no higher tier has."""
    return candidates.join(covered.select(key).distinct(), key, "left_anti")


def share_majority(rows: DataFrame, keys: list[str], area: str, size: str) -> DataFrame:
    """(keys, area, support): the area of the largest summed size and its share, rounded to 3. Ties: the smaller name."""
    s = rows.groupBy(*keys, area).agg(F.sum(size).alias("size"))
    b = s.groupBy(*keys).agg(F.min_by(F.struct(area, "size"), F.struct((-F.col("size")).alias("r"), F.col(area).alias("v"))).alias("b"), F.sum("size").alias("total"))
    return b.filter("total > 0").select(*keys, F.col(f"b.{area}").alias(area), F.round(F.col("b.size") / F.col("total"), 3).alias("support"))


def block_index(overlay: DataFrame) -> DataFrame:
    """Block index rows of (block, parcel, neighborhood, area) intersections: parcels (priority 1), then blocks (2)."""
    o = overlay.withColumns({"block": T.digits("block"), "parcel": T.digits("parcel")}).filter("block <> ''")
    p = share_majority(o.filter("parcel <> ''"), ["block", "parcel"], "neighborhood", "area").withColumns({"priority": F.lit(1), "method": F.lit("parcel_area")})
    b = share_majority(o, ["block"], "neighborhood", "area").withColumns({"parcel": F.lit(""), "priority": F.lit(2), "method": F.lit("block_area_majority")})
    return p.unionByName(b)


def common_keys(left: DataFrame, right: DataFrame, key: str = "street_key") -> DataFrame:
    """Keys that both tables have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def best_overlap(overlay: DataFrame, left: str, right: str, size: str = "area") -> DataFrame:
    """(left, right, size) of the largest overlap of each left shape; ties: the smaller right key."""
    return overlay.groupBy(left).agg(F.min_by(F.struct(right, size), F.struct((-F.col(size)).alias("s"), F.col(right).alias("r"))).alias("b")).select(left, f"b.{right}", f"b.{size}")
