"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint takes 64 majority votes of 3-word shingle hashes. Two fingerprints link at Hamming distance ``RADIUS`` or
less. The tables are bit masks built from a covering code: bit i is given a non-zero vector phi(i) of RADIUS + 1 bits,
and table v (any non-zero vector) keeps the bits with <phi(i), v> odd. At most RADIUS differing bits span at most RADIUS
dimensions, so some v is orthogonal to all of them, and in that table the pair agrees on every kept bit: no pair within
the radius is missed, whatever the data.

A bucket of many fingerprints is never compared pair by pair: its members go on to the 7 finer tables that apply the
same code to the bits which the bucket's mask leaves open. After three levels at most 6 bits are open, so a bucket holds
at most 64 fingerprints. Equal fingerprints are one node, however many documents share it.

Defined edge cases: a null text counts as empty and has fingerprint zero; rows with a null ``doc_id`` take part and get
the smallest id of their component (null if there is none); repeated rows get one result each; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitflow.llm.common import cut, drop, sized

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members up to which a bucket is compared directly; larger ones are refined, so this bounds work, not results.
BUCKET = 32
LEVELS = 3
_SLICE = 1 << 18
#: Nodes that one task puts into all covering tables: 63 rows each at radius 5, whose keys a task holds to aggregate them.
NODES = 1 << 14


def _votes(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """Set-bit counts per bit position over all shingle hashes, and the number of shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(64, np.int64), 0
    if len(words) < k:
        words = [b" ".join(words)]
        k = 1
    n = len(words) - k + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = words[at : at + _SLICE + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False)) if k > 1 else part
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total, n


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; bit b is set if it is set in more than half of the shingles' hashes."""
    votes, n = _votes((text or "").encode("utf-8", "surrogatepass").lower().split(), k)  # bytes.lower() touches A-Z only
    if not n:
        return 0
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def of_hashes(h: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of an array of 64-bit shingle hashes, each of which votes once; none: zero."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), _SLICE):
        votes += np.unpackbits(h[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def covering_masks(open_bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over ``open_bits``; any ``radius`` of the bits are all absent from some mask."""
    m = 1 << (radius + 1)
    phi = {b: 1 + i % (m - 1) for i, b in enumerate(open_bits)}
    return [sum(1 << b for b in open_bits if (phi[b] & v).bit_count() & 1) for v in range(1, m)]


def mask_tree(levels: int = LEVELS, radius: int = RADIUS) -> list[list[int]]:
    """Masks by level: child c of mask i stands at i * 7 + c of the next level and contains its parent's bits."""
    tree = [covering_masks(list(range(64)), radius)]
    for _ in range(levels - 1):
        tree.append([m | c for m in tree[-1] for c in covering_masks([b for b in range(64) if not m >> b & 1], radius)])
    return tree


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of different fingerprints within the radius. ``nodes``: distinct ``fp``, written."""
    width = (1 << (RADIUS + 1)) - 1
    found = []
    members = None
    for level, masks in enumerate(mask_tree()):
        table = F.array(*(F.lit(_signed(m)) for m in masks))
        if members is None:
            rows = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("mask"))
        else:
            rows = members.select("fp", F.explode(F.sequence(F.col("mask") * width, F.col("mask") * width + width - 1)).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.get(table, F.col("mask"))))
        # Counts are combined map-side; a join that Spark can split by skew brings them back to the members.
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        full = rows.join(counts, ["mask", "key"])
        last = level == LEVELS - 1
        full = cut(full)
        small = full if last else full.filter(F.col("n") <= BUCKET)
        group = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        near = lambda x, y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)
        pair = group.select("fps", F.explode("fps").alias("a"))
        found.append(pair.select("a", F.explode(F.expr(f"filter(fps, y -> y > a AND bit_count(y ^ a) <= {RADIUS})")).alias("b")))
        if last:
            break
        members = full.filter(F.col("n") > BUCKET)
        if members.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def meetings(nodes: DataFrame, radius: int) -> DataFrame:
    """Distinct (a, b), a < b, of the nodes that meet in a covering table of ``radius``. ``nodes``: node, fp; written.

    Any two fingerprints within the radius share a bucket, and many beyond it do. A bucket's nodes are paired with its
    smallest one only, so there are no more pairs than rows, however alike the fingerprints of a large group are: the pairs
    are for callers that compare the nodes themselves and look elsewhere for links that have no such path.
    """
    masks = covering_masks(list(range(64)), radius)
    table = F.array(*(F.lit(_signed(m)) for m in masks))
    # A file of nodes is small, but its rows in the tables are many.
    dealt = nodes.repartition(nodes.count() // NODES + 1, "node")
    rows = dealt.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask"))
    # Tables and keys in one hash: if two buckets have the same, they share a centre, which costs comparisons only.
    rows = rows.select("node", F.xxhash64("mask", F.col("fp").bitwiseAND(F.get(table, F.col("mask")))).alias("bucket"))
    centre = cut(rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket", "low"))
    return rows.join(sized(centre), "bucket").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the smallest node reachable. Alternating large and small stars.

    Every round is joins and partial aggregates on edges; a hub's edges are combined before they are shuffled, and the
    joins are of the kind that Spark splits by skew. Each round is written to the shared folder.
    """
    e = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("u")))  # u > v
    mark = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        j = large.join(low, F.col("u") == F.col("k"))
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        new = cut(small.select("v", "u").distinct())
        now = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        drop(large)
        drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable over links."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(links(nodes.select("fp")))
    of = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    # Labels need not be members (the smallest node has no edge as u), so a component is the set of one label.
    least = of.groupBy("label").agg(F.min("low").alias("component_id"))
    of = of.join(least, "label").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row."""
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, with their own columns.

    Rows without a ``doc_id`` stay only if their component has no id at all. Rows that repeat a doc_id stay together.
    """
    best = near_duplicates(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    best = sized(cut(best))
    return docs.join(best, docs["doc_id"].cast("long").eqNullSafe(F.col("_keep")), "left_semi")
