"""Audit of how corpus filters interact: what each removes, in every order, and what it alone would catch.

Filters fail a document or not, whatever the others do, so an order is settled by which of the filters fail. A document's
failures are one mask of bits; masks are counted per part, with the labelled documents among them, and all orders are sums
over those counters. Counters of any two sets of documents add up, so they can be kept per batch of documents.

Duplicates are found by sorting: rows are range-sorted by a fingerprint of the text and doc_id, and within a partition by
fingerprint, whole text and doc_id, so equal texts are neighbours and a text is compared with the one before it. Bounds of
partitions hold no texts, and a fingerprint with many rows, as large a group of copies has, may span partitions: each
partition also gives the texts of its last fingerprint, and the rows of a first one look there for smaller ids.

Defined edge cases: a null text is empty, equal to any other empty text; a null doc_id is never a duplicate nor makes
another text one, and has no labels; rows that repeat a doc_id are equal in rank, so none of them makes another a duplicate;
labels that repeat a doc_id count as 1 if one of them is; a null part is the empty string; a text of any length is read and
compared whole; an empty table gives no parts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import cut, small_batches

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
_SYMBOLS, _CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DUPLICATE = 1 << FILTERS.index("E")

ROWS = "doc_id long, part string, mask int, at int, fp long, digest binary"


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space only
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw.translate(None, _SYMBOLS)) < len(raw)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | symbols << 3


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their failures, E as far as the partition shows it.

    ``at`` is the partition for rows of its first fingerprint, which may go on from the partition before, and for a last
    row per text of its last fingerprint, which has no mask; both have the text's digest. Other rows have neither.
    """
    here = TaskContext.get().partitionId()
    opening = fp = text = low = None
    mask, digest = 0, b""
    texts: set[bytes] = set()  # of the fingerprint at hand, with an id: one, unless fingerprints collide
    any_row = False
    for b in batches:
        out: list[tuple] = []
        for d, part, f, t in zip(b["doc_id"].to_pylist(), b["part"].to_pylist(), b["fp"].to_pylist(), b["text"], strict=True):
            if not any_row or f != fp:
                any_row, opening = True, f if not any_row else opening
                fp, text, texts = f, None, set()
            t = t.as_py()
            if t != text:  # its predecessor
                text, low, mask, digest = t, None, failures(t), hashlib.sha256(t.encode()).digest()
            if d is not None:
                low = d if low is None else low
                texts.add(digest)
            first = f == opening
            out.append((d, part, mask | (DUPLICATE if d is not None and low < d else 0), here if first else None, f if first else None, digest if first else None))
        yield _batch(out)
    yield _batch([(None, None, None, here, fp, x) for x in sorted(texts)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "at": pa.int32(), "fp": pa.int64(), "digest": pa.binary()}
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row: bits of the filters it fails, A the lowest. A written table underlies it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"))
    small_batches(docs.sparkSession)
    by = [F.asc_nulls_first(c) for c in ("fp", "doc_id")]
    within = [F.asc_nulls_first(c) for c in ("fp", "text", "doc_id")]
    found = cut(rows.repartitionByRange(*by).sortWithinPartitions(*within).mapInArrow(_marked, ROWS))
    # A row per partition, or a few where fingerprints collide: no more than that is broadcast.
    last = found.filter("mask is null").groupBy("fp", "digest").agg(F.min("at").alias("since"))
    j = found.filter("mask is not null").join(F.broadcast(last), ["fp", "digest"], "left")
    seen = F.coalesce((F.col("since") < F.col("at")) & F.col("doc_id").isNotNull(), F.lit(False))
    return j.select("doc_id", "part", F.when(seen, F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")).alias("mask"))


def counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): additive counts of documents by the filters they fail."""
    every = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"))
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    held = marked.join(known, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    both = every.withColumns({"good": zero, "toxic": zero}).unionByName(held.withColumn("docs", zero))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))


def orders(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters alone."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        gone = 0
        for i, f in enumerate(order):
            steps.append(f"named_struct('o', '{''.join(FILTERS[x] for x in order)}', 's', {i + 1}, 'bit', {1 << f}, 'gone', {gone})")
            gone |= 1 << f
    n_orders = len(steps) // len(FILTERS)
    part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("m"))  # 32 masks at most
    row = part.select("part", "m", F.explode(F.expr(f"array({', '.join(steps)})")).alias("step"))

    def total(of: Column | str, when: Column | str) -> Column:
        return F.expr(f"aggregate(filter(m, x -> {when}), 0L, (a, x) -> a + {of})")

    fails, before = "(x.mask & step.bit) <> 0", "(x.mask & step.gone) <> 0"
    return row.select(
        "part", F.col("step.o").alias("filter_order"), F.col("step.s").alias("step"),
        total("x.docs", "(x.mask & (step.gone | step.bit)) = 0").alias("kept"),
        total("x.docs", f"{fails} and not {before}").alias("removed"),
        total("x.docs", f"{fails} and {before}").alias("redundant"),
        total("x.docs", "x.mask = step.bit").alias("unique_fails"),
        total("x.good", f"{fails} and not {before}").alias("good_lost"),
        total("x.toxic", f"{fails} and not {before}").alias("toxic_lost"),
        # Each of the filters that a document fails comes first among them in the same number of orders.
        total(f"x.docs * {n_orders} div bit_count(x.mask)", fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(cut(counters(masks(docs, part), labels)))
