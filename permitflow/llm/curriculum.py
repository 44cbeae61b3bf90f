"""Mixing sources to target weights over the course of training, in DataFrame functions only.

Each source gets a target, a share of all words by its weight with a ceiling of so many times its size. A schedule says how
a source's rate rises or falls as training goes on, as a line through knots; its integral, scaled to the target, is the
source's cumulative demand. Documents stand in each source in an order by hash, one after another and again from the start
if the target asks for repeats; a document is due when the demand reaches its place, so its position is the inverse of the
demand there. All placements are range-sorted by position, which gives the order of training.

Places within a source are running totals that no source has to be held together for (:mod:`permitflow.operators.running`), however large. The
last document that a source's target reaches is taken in part, so that a source gives just its target, to a word.

Defined edge cases: a null text, like one without words, has size 0, is taken 0 times and has no placement; a null source is
a source of its own, after all others; rows that repeat a doc_id are documents of their own, and a null doc_id counts like
any; a text of any length counts whole; ties in hash and id go by size, and rows equal in all of these are alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import WORD, cut, sized
from permitflow.operators.running import running, spread

#: Weights of sources in their order, repeating, and the most often that a source is read.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Per weight: a source's rate at points of training from 0 to 1, on any scale, with lines between them. Common sources
#: come early and fade, rare ones are kept for later.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.6), (0.5, 0.8), (1.0, 0.8)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.2), (1.0, 1.2)))
_ALL = "all"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) per row. A written table."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0: by code point (the order of UTF-8 bytes), null last."""
    keyed = sources.withColumns({"_k": F.lit(_ALL), "_null": F.col("source").isNull()})
    return running(spread(keyed, ["_k"], ["_null", "source"]), "_k", {"rank": F.lit(1)}).withColumn("rank", F.col("rank") - 1)


def targets(sized_docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, target) per source. A written table.

    Words go out by weight; a source whose share passes ``most`` times its size stops there, and what is left over goes to
    the others, again by weight, until none is above. Each round is one aggregation, and a source that stopped stays so.
    """
    s = cut(_ranked(sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"))).select("source", "rank", "source_size"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0  # words per unit of weight
    stopped = -1
    while True:
        full = weight * F.lit(level) >= cap
        total, capped, n, free = s.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(full.cast("int")), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        if total is None or not free or n == stopped:
            break
        level, stopped = (total - capped) / free, n
    return cut(s.withColumn("target", F.least(cap, weight * F.lit(level))))


def _demand(schedule: Schedule) -> tuple[list[float], list[float], list[float]]:
    """Knots, rates and the integral up to each knot, scaled to end at 1."""
    t, r = [float(x) for x, _ in schedule], [float(y) for _, y in schedule]
    area = [0.0]
    for i in range(1, len(t)):
        area.append(area[-1] + (t[i] - t[i - 1]) * (r[i] + r[i - 1]) / 2)
    if t[0] != 0 or t[-1] != 1 or sorted(t) != t or min(r) < 0 or area[-1] <= 0:
        raise ValueError("a schedule runs from 0 to 1 with rates of 0 or more, not all 0")
    return t, [x / area[-1] for x in r], [x / area[-1] for x in area]


def position(share: Column, schedule: Schedule) -> Column:
    """When a source's cumulative demand reaches ``share`` of its target: the inverse of the schedule's integral."""
    t, r, area = _demand(schedule)
    out = F.lit(1.0)
    for i in reversed(range(len(t) - 1)):
        # r0 x + slope x^2 / 2 = rest, by the form of the root that stays exact as the slope goes to 0.
        slope = (r[i + 1] - r[i]) / (t[i + 1] - t[i])
        rest = F.greatest(share - area[i], F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(r[i] ** 2) + 2 * slope * rest, F.lit(0.0)))
        x = F.when(root + r[i] > 0, 2 * rest / (root + r[i])).otherwise(0.0)
        out = F.when(share < area[i + 1], t[i] + F.least(x, F.lit(t[i + 1] - t[i]))).otherwise(out)
    return out


def placed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, and ``reads``, an array with an entry for each time
    that the document is taken: epoch, words, position."""
    d = sizes(docs)
    s = sized(targets(d, weights, most))
    keyed = d.join(s, d["source"].eqNullSafe(s["source"])).select("doc_id", d["source"], "size", "rank", "source_size", "target")
    keyed = keyed.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    r = running(spread(keyed, ["rank"], ["order", "doc_id", "size"]), "rank", {"end": F.col("size")})
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * int(most))
    kind = F.col("rank") % len(schedules)

    def read(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("end") - F.col("size")
        words = F.greatest(F.least(F.col("size"), quota - begin), F.lit(0).cast("long"))
        share = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(0.0)
        when = position(share, schedules[-1])
        for i in reversed(range(len(schedules) - 1)):
            when = F.when(kind == i, position(share, schedules[i])).otherwise(when)
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), when.alias("position"))

    reads = F.filter(F.array(*(read(F.lit(e).cast("long")) for e in range(int(most)))), lambda x: x["words"] > 0)
    return r.select("doc_id", "source", "size", "source_size", "target", reads.alias("reads"))


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """Placements in the order of training, range-sorted by position: position, doc_id, source, epoch, words."""
    p = placed(docs, weights, most, schedules).select("doc_id", "source", F.explode("reads").alias("r"))
    return p.select("r.position", "doc_id", "source", "r.epoch", "r.words").orderBy("position", "source", "doc_id", "epoch")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position per row, range-sorted by first position; documents that the
    mix leaves out come last."""
    p = placed(docs)
    taken = F.aggregate("reads", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = p.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.round(F.try_element_at("reads", F.lit(1))["position"], 6).alias("first_position"))
    return out.orderBy(F.asc_nulls_last("first_position"), "doc_id")
