"""Near copies by SimHash, confirmed by exact Jaccard similarity of word shingles; a prefix filter finds what is left.

Two texts link if the sets of their ``SHINGLE``-word shingles have a Jaccard similarity of 4/5 or more. Equal sets are one
node, however many documents share it.

1. A node's 64-bit fingerprint takes the majority votes of its shingles' hashes. Nodes that meet in a covering table of
   radius ``REACH`` (``simhash.py``) are compared, and what links is joined into components.
2. Texts that similar may differ by more bits than tables can cover: at 4/5 by some ten of 64, and the tables double with
   each bit. The rest is therefore sought by their shingles, among nodes that lie in different components only. Put all
   shingles into any one order: of two sets that similar, each has a common shingle among its first n - ceil(4n/5) + 1, so
   sets that share none of these are no link, and no pair is missed, whatever the order. The order is by hash, with
   shingles seen in many places last, so that common passages make few candidates. A shared shingle's nodes are first
   compared with one of them, its centre; then every pair of nodes that share a shingle and are not yet in one component is
   compared, but for those whose places of the shingle leave too little behind it (positional filtering).

A pair's sizes come first, then its spreads: how many shingles lie in each part of the hashes' range, whose lesser values
add up to no less than what the sets share. Only pairs that pass both are compared by text. Shingles and sets are told apart
by 64-bit hashes.

Defined edge cases: a null text counts as empty, and empty texts are equal; a text of fewer words than a shingle has one
shingle, all of it; rows with a null ``doc_id`` take part and get the smallest id of their component (null if there is
none); repeated rows get one result each; an empty table gives an empty result; other columns are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.llm import simhash
from permitflow.llm.common import cut, drop, sized

SHINGLE = 5
#: Bits by which fingerprints that surely share a covering table may differ; 2^(REACH + 1) - 1 tables.
REACH = 5
#: Hashes that are put last in the order, the most frequent ones; the order bounds work, not results.
COMMON = 1 << 18
_SLICE = 1 << 20


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return np.zeros(0, np.int64)
    k = min(k, len(words))
    digest, seed = xxhash.xxh64_intdigest, simhash.SEED
    n = len(words) - k + 1
    return np.unique(np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[i : n + i] for i in range(k)), strict=True)), np.uint64, n).view(np.int64))


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), 1)).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate(parts)))


def _sets(k: int):
    """(node, hashes) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = [shingles(x.as_py(), k) for x in b.slice(at, 256).column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, s)), pa.int64()), _lists(s)], names=["node", "hashes"])

    return run


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of (node, hashes): hashes met more than once in a slice of rows: enough to know the common ones by."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], names=["h", "c"])

    held, size = [], 0
    for b in batches:
        held.append(b.column(1).flatten().to_numpy())
        size += len(held[-1])
        if size >= _SLICE:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def _counted(k: int):
    """Both in one worker: as two steps they would take two workers for each task, and pass all hashes between them."""
    return lambda batches: _seen(_sets(k)(batches))


def common(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of at most COMMON frequent shingles, as a quarter of the texts shows them."""
    part = docs.select("doc_id", "text").filter(F.xxhash64("text") % 4 == 0)
    c = cut(part.mapInArrow(_counted(k), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 2"))
    total, least = 0, 64
    for row in sorted(c.groupBy(F.floor(F.log2("c")).alias("p")).count().collect(), reverse=True):  # a row for each power of two
        total += row["count"]
        if total > COMMON:
            break
        least = row["p"]
    t = c.filter(F.col("c") >= F.lit(2.0**least)).toArrow()
    drop(c)
    h, n = t.column("h").to_numpy(), t.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _spread(h: np.ndarray) -> bytes:
    """How many hashes lie in each of some n / 2 equal parts of their range, as bytes; empty if a byte can't say."""
    parts = 1 << max(0, (len(h) // 2).bit_length() - 1)
    of = (h.view(np.uint64) >> np.uint64(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)
    n = np.bincount(of, minlength=parts)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def _most(x: bytes, y: bytes, n: int, m: int) -> int:
    """An upper bound of the members that sets of n and m with these spreads have in common."""
    if not x or not y:
        return min(n, m)
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = b.reshape(len(a), -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


def _prefixes(often: np.ndarray, count: np.ndarray, k: int):
    """(doc_id, node, n, fp, prefix, spread) of (doc_id, text)."""

    def prefix(h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n and len(often):
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            h = h[np.argsort(np.where(often[at] == h, count[at], 0), kind="stable")]
        return h[: n - (4 * n + 4) // 5 + 1] if n else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = [shingles(x.as_py(), k) for x in part.column(1)]
                cols = [part.column(0), pa.array(list(map(_node, s)), pa.int64()), pa.array(list(map(len, s)), pa.int32())]
                fp = np.fromiter(map(simhash.of_hashes, s), np.uint64, len(s)).view(np.int64)
                cols += [pa.array(fp), _lists(list(map(prefix, s))), pa.array(list(map(_spread, s)), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "n", "fp", "prefix", "spread"])

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of (a, b, n, x, m, y) whose spreads do not rule the link out."""
    for r in batches:
        ok = [9 * _most(x, y, n, m) >= 4 * (n + m) for n, x, m, y in zip(*(r.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield r.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _texts(k: int):
    """(node, text) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_node(shingles(x.as_py(), k)) for x in b.column(0)], pa.int64()), b.column(0)], names=["node", "text"])

    return run


def _similar(k: int):
    """(a, b) of (a, b, x, y) whose texts are similar. Rows lie by a, so its set is made once for many of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.int64)
        for r in batches:
            ok = []
            for a, x, y in zip(r.column(0).to_pylist(), r.column(2), r.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(x.as_py(), k)
                other = shingles(y.as_py(), k)
                ok.append(9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other)))
            yield r.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of 4/5 or more. A written table.

    Two bounds come before the exact comparison, since few pairs that share a shingle are similar: the sizes, and the
    spreads. Only texts of nodes that may be similar are moved, one for each.
    """
    pairs = cut(pairs.distinct())
    nodes = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    facts = rows.select("node", "n", "spread").join(sized(cut(nodes(pairs))), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("spread").alias("s"))
    facts = cut(facts)
    j = pairs.join(facts.select(F.col("node").alias("a"), "n", F.col("s").alias("x")), "a").join(facts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("s").alias("y")), "b")
    j = j.filter(9 * F.least("n", "m") >= 4 * (F.col("n") + F.col("m")))
    left = cut(j.select("a", "b", "n", "x", "m", "y").mapInArrow(_possible, "a long, b long"))
    drop(facts)
    drop(pairs)
    want = cut(nodes(left))
    # One document of each node gives the text.
    some = rows.select("node", "doc_id").join(sized(want), "node").groupBy("node").agg(F.min("doc_id").alias("some")).select("some").distinct()
    texts = docs.join(sized(cut(some)), F.col("doc_id").eqNullSafe(F.col("some")), "left_semi").select("text")
    of = texts.mapInArrow(_texts(k), "node long, text string").join(want, "node", "left_semi")
    of = cut(of.groupBy("node").agg(F.first("text").alias("text")))
    both = left.join(of.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(of.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    out = cut(both.select("a", "b", "x", "y").mapInArrow(_similar(k), "a long, b long"))
    drop(of)
    return out


def by_fingerprint(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b, of similar nodes that the covering tables bring together. A written table."""
    nodes = cut(rows.groupBy("node").agg(F.first("fp").alias("fp")))
    return _confirmed(simhash.meetings(nodes, REACH), docs, rows, k)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes in different components. ``label``: node, l; written."""
    of = lambda c: sized(label).select(F.col("node").alias(c), F.col("l").alias(f"l_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter("coalesce(l_a, a) <> coalesce(l_b, b)").select("a", "b")


def links(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b, of similar nodes, enough to join every component. ``rows``: doc_id, node, n, fp, prefix, spread; written."""
    found = by_fingerprint(docs, rows, k)
    joined = cut(simhash.components(found).withColumnRenamed("label", "l"))
    post = rows.select("node", "n", F.posexplode("prefix").alias("i", "h"))
    met = cut(post.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("c")).filter("low < high"))
    # Two places are one pair; only shingles with more go back to the postings.
    many = cut(met.filter("c > 2").select("h"))
    own = cut(post.join(sized(many), "h").distinct())
    # A shingle's centre is its node with the most shared shingles: an original has more of them in common with its copies
    # than any copy, so that one round joins them all.
    degree = own.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    centre = own.join(degree, "node").groupBy("h").agg(F.max(F.struct("d", "node")).alias("m")).select("h", F.col("m.node").alias("low"))
    live = cut(own.join(centre, "h").select("h", "node", "n", "i", "low"))
    drop(own)
    star = live.filter("node <> low").select(F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b"))
    two = met.filter("c = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    near = found.unionByName(_confirmed(_apart(two.unionByName(star), joined), docs, rows, k))
    drop(met)
    label = cut(simhash.components(near).withColumnRenamed("label", "l"))
    left = cut(live.join(sized(label), "node", "left").select("h", "node", "n", "i", "low", F.coalesce("l", "node").alias("l")))
    drop(live)
    split = left.groupBy("h").agg(F.min("l").alias("l"), F.max("l").alias("m"), F.count(F.lit(1)).alias("c")).filter("l <> m AND c > 2").select("h")
    # Each node but the centre, which was compared with all. Two sets meet at their first common shingle in the order of all
    # shingles, if at no other; from there on, either has no more left than can be in common.
    left = cut(left.join(split, "h", "left_semi").filter("node <> low"))
    other = left.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("l").alias("k"))
    rest = left.withColumnRenamed("node", "a").join(other, "h").filter("a < b AND l <> k AND 9 * least(n - i, m - j) >= 4 * (n + m)")
    return near.unionByName(_confirmed(rest.select("a", "b"), docs, rows, k))


def clusters(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) per row; component_id is the smallest doc_id reachable over links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_prefixes(*common(docs, k), k), "doc_id long, node long, n int, fp long, prefix array<long>, spread binary"))
    label = cut(simhash.components(links(docs, rows, k)).withColumnRenamed("label", "l"))
    of = rows.select("doc_id", "node").join(sized(label), "node", "left").select("doc_id", F.coalesce("l", "node").alias("l"))
    least = of.groupBy("l").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "l").select("doc_id", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The documents with the smallest doc_id of their component, with their own columns.

    Rows without a ``doc_id`` stay only if their component has no id at all. Rows that repeat a doc_id stay together.
    """
    best = sized(cut(clusters(docs, k).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()))
    return docs.join(best, docs["doc_id"].cast("long").eqNullSafe(F.col("_keep")), "left_semi")
