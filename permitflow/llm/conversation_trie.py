"""Prefix trie of conversations, without holding a conversation or a node's members in one place.

A node is a distinct sequence of first d turns. Each conversation's turns are numbered and its prefix digests summed by
:mod:`permitflow.operators.running`: a digest is four sums, over the turns so far, of 32 bits of a hash of a turn's place and its content, so
it needs no whole conversation. The smallest conversation with a prefix owns its node; whoever owns a node owns all nodes
below it on its path. So the nodes that a conversation doesn't own are its first u, and u is found by binary search: from
the highest bit down, all conversations that reach depth u + 2^bit ask at once whether the minimum of that digest is
smaller than they are. Such depths have ``bit`` as their lowest set bit, so each round joins only the digests and minima of
its own depths, and all rounds together read every digest once.

The nodes that a conversation owns form a chain, which hangs at depth u below the chain of the prefix's owner. Totals go up
the tree of chains by doubling: a chain adds what the chains 2^k above hold, so rounds grow with the logarithm of the tree's
height; then they run up within each chain, in blocks of depths.

The digest of a node's ends goes over all ids in order: ids are joined in blocks, and only the nodes with several blocks
stream through a worker, block by block.

Defined edge cases: null roles and texts are empty; rows without a conv_id belong to no conversation; a null turn comes
first; rows of the same turn follow each other by the hash of their role and text, so repeated rows are turns of their own;
texts of any length count whole; an empty table gives no nodes, else there is a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitflow.llm.common import WORD, cut, drop, sized
from permitflow.operators.running import running, spread

#: Depths of a chain, and ids of ends, that are taken together: powers of two.
DEPTHS, IDS = 12, 14
DIGEST = ["s0", "s1", "s2", "s3"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, content, words, _part, _at): each turn with its place from 1 and the hash of its role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("content"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return running(spread(rows, ["conv_id"], ["turn", "content"]), "conv_id", {"pos": F.lit(1)}).drop("turn")


def shared_starts(numbered: DataFrame, base: Callable[[Column], Column], most: Callable[[Column], Column], longest: int) -> DataFrame:
    """(conv_id, skip, head): conversations that begin with the first turns of another. ``base`` names the other and
    ``most`` how many of its turns to take, ``longest`` at most; as many of the own turns are left out (``skip``)."""
    ids = numbered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    first = numbered.filter(F.col("pos") <= longest).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "words"))).alias("first"))
    want = ids.select("conv_id", F.col("n"), base(F.col("conv_id")).alias("b"), most(F.col("conv_id")).alias("skip"))
    j = want.join(first.withColumnRenamed("conv_id", "b"), "b", "left")
    return j.select("conv_id", "n", "skip", F.coalesce(F.slice("first", 1, F.col("skip")), F.array().cast("array<struct<pos: bigint, content: binary, words: bigint>>")).alias("head"))


def _lanes(pos: Column, content: Column) -> list[Column]:
    """Four numbers of 32 bits for a turn at its place; their sums stay in range for two thousand million turns."""
    out = []
    for salt in (1, 2):
        h = F.xxhash64(pos, content, F.lit(salt))
        out += [h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)]
    return out


def prefixes(numbered: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, bit, words, digest) of each prefix of one turn or more, partitioned by ``bit``, the lowest set bit
    of the depth; and (conv_id, length) of each conversation, turnless ones included. Written tables."""
    if heads is None:
        heads = shared_starts(numbered, lambda c: c, lambda c: F.lit(0), 0)
    heads = cut(heads)
    size = F.size("head")
    lengths = heads.select("conv_id", (size + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).cast("long").alias("length"))
    # A conversation's offsets are spread over its partitions first, so that no join meets a conversation's turns as one key.
    offset = numbered.groupBy("conv_id", "_part").agg(F.lit(1)).select("conv_id", "_part").join(heads.select("conv_id", "skip", size.alias("got")), "conv_id")
    own = numbered.join(offset, ["conv_id", "_part"]).filter("pos > skip").withColumn("depth", F.col("pos") - F.col("skip") + F.col("got"))
    own = running(own.select("conv_id", "depth", "words", "_part", "_at", *(x.alias(f"l{i}") for i, x in enumerate(_lanes(F.col("depth"), F.col("content"))))), "conv_id", {f"s{i}": F.col(f"l{i}") for i in range(4)})
    start = heads.select("conv_id", F.col("head").alias("h"), F.posexplode("head").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("t.words").alias("words"), F.slice("h", 1, F.col("i") + 1).alias("h"))

    def summed(h: Column, i: int) -> Column:
        return F.aggregate(F.transform(h, lambda t: _lanes(t["pos"], t["content"])[i]), F.lit(0).cast("long"), lambda a, x: a + x)

    start = start.select("conv_id", "depth", "words", *(summed(F.col("h"), i).alias(f"s{i}") for i in range(4)))
    whole = heads.filter(size > 0).select("conv_id", *(summed(F.col("head"), i).alias(f"h{i}") for i in range(4)))
    parts = offset.filter("got > 0").select("conv_id", "_part").join(whole, "conv_id")
    own = own.join(parts, ["conv_id", "_part"], "left").select("conv_id", "depth", "words", *((F.col(f"s{i}") + F.coalesce(f"h{i}", F.lit(0))).alias(f"s{i}") for i in range(4)))
    every = own.unionByName(start)
    bit = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1)
    return cut(every.withColumn("bit", bit), "bit"), cut(lengths)


def owners(prefix: DataFrame) -> DataFrame:
    """(depth, bit, digest, owner, n_convs, words) of each node but the root. A written table; a prefix that many
    conversations share is combined before it is shuffled."""
    return cut(prefix.groupBy("depth", "bit", *DIGEST).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")), "bit")


def unowned(prefix: DataFrame, minima: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, length, u): how many of its first nodes each conversation doesn't own. A written table."""
    longest = lengths.agg(F.max("length")).first()[0] or 0
    state = cut(lengths.withColumn("u", F.lit(0).cast("long")))
    for bit in reversed(range(int(longest).bit_length())):
        asked = state.withColumn("depth", F.col("u") + F.lit(1 << bit))
        # Only digests of this round's depths; a digest and its owner together are a key of their own, met by one probe.
        mine = minima.filter(F.col("bit") == bit).select("depth", *DIGEST, F.col("owner").alias("conv_id"), F.lit(True).alias("own"))
        here = prefix.filter(F.col("bit") == bit).select("conv_id", "depth", *DIGEST)
        found = asked.filter("depth <= length").join(here, ["conv_id", "depth"]).join(mine, ["conv_id", "depth", *DIGEST], "left")
        beyond = found.filter("own is null").select("conv_id", F.col("depth").alias("past"))
        after = cut(state.join(beyond, "conv_id", "left").select("conv_id", "length", F.coalesce("past", "u").alias("u")))
        drop(state)
        state = after
    return state


def chains(prefix: DataFrame, minima: DataFrame, state: DataFrame, root: int) -> DataFrame:
    """(conv_id, length, u, up): each conversation with the owner of its last node that isn't its own; null for the root's.
    A written table."""
    at = state.filter("u > 0").join(prefix.select("conv_id", F.col("depth").alias("u"), *DIGEST), ["conv_id", "u"])
    up = at.join(minima.select(F.col("depth").alias("u"), *DIGEST, F.col("owner").alias("up")), ["u", *DIGEST]).select("conv_id", "length", "u", "up")
    top = state.filter("u = 0").select("conv_id", "length", "u", F.when(F.col("conv_id") != root, F.lit(root)).alias("up"))
    return cut(up.unionByName(top))


def climbed(own: DataFrame, root: int) -> DataFrame:
    """(conv_id, saved, leaves) of each chain and all below it. ``own``: conv_id, up, saved, leaves. A written table.

    After k rounds a chain holds the chains less than 2^k below it, and ``up`` is the chain 2^k above.
    """
    state = cut(own)
    while not state.filter("up is not null").isEmpty():
        add = state.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        # What hangs below the root's chain has nothing above that; leaving it out leaves no key that most rows share.
        higher = state.filter(F.col("up").isNotNull() & (F.col("up") != root)).select("conv_id", "up").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("over")), "up").select("conv_id", "over")
        new = state.drop("up").join(add, "conv_id", "left").join(higher, "conv_id", "left")
        after = cut(new.select("conv_id", F.col("over").alias("up"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
        drop(state)
        state = after
    return state.drop("up")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes whose blocks of ids come in order."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for b in batches:
        for c, d, ids in zip(b["conv_id"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if (c, d) != node:
                if node:
                    yield row()
                node, digest = (c, d), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node:
        yield row()


def ends(chained: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of each node where conversations end, by its owner."""
    at = chained.select(F.when((F.col("u") < F.col("length")) | F.col("up").isNull(), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("id"))
    block = at.groupBy("conv_id", "depth", F.shiftright("id", IDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))
    block = cut(block)
    many = block.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id", "depth")
    many = sized(cut(many))
    one = block.join(many, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    more = block.join(many, ["conv_id", "depth"]).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return one.unionByName(more.select("conv_id", "depth", "ids").mapInArrow(_streamed, "conv_id long, depth long, ends_sha256 string"))


def tree(prefix: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    root, n = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    minima = owners(prefix)
    chained = chains(prefix, minima, unowned(prefix, minima, lengths), root if n else 0)
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words")
    nodes = nodes.unionByName(lengths.agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.lit(0).cast("long").alias("words")).filter("conv_id is not null"))
    zero = {c: F.lit(0).cast("long") for c in ("n_convs", "words", "is_node", "next", "hung")}
    marks = ["conv_id", "depth", *zero, "parent"]
    no = F.lit(None).cast("long")
    # Chains that own no node hang nowhere: their conversations end on others' nodes.
    hang = chained.filter("u < length and up is not null")
    rows = nodes.withColumns({"is_node": F.lit(1).cast("long"), "next": zero["next"], "hung": zero["hung"], "parent": no}).select(*marks)
    below = nodes.select("conv_id", (F.col("depth") - 1).alias("depth")).withColumns(zero | {"next": F.lit(1).cast("long"), "parent": no}).select(*marks)
    hung = hang.select(F.col("up").alias("conv_id"), F.col("u").alias("depth")).withColumns(zero | {"hung": F.lit(1).cast("long"), "parent": no}).select(*marks)
    tops = hang.select("conv_id", (F.col("u") + 1).alias("depth"), F.col("up").alias("parent")).withColumns(zero).select(*marks)
    known = rows.unionByName(below).unionByName(hung).unionByName(tops).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in zero), F.max("parent").alias("parent")).filter("is_node > 0")
    saved = (F.col("n_convs") - 1) * F.col("words")
    known = cut(known.select("conv_id", "depth", "n_convs", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), (F.col("next") + F.col("hung")).alias("n_children"), saved.alias("saved"), (F.col("next") + F.col("hung") == 0).cast("long").alias("leaves")))
    own = known.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    totals = climbed(own.join(chained.select("conv_id", "up"), "conv_id"), root if n else 0)
    # What hangs at a node counts there; then totals run up the chain: within blocks of depths, and over whole blocks below.
    at = hang.select("conv_id", "up", "u").join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("u").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    block = F.shiftright("depth", DEPTHS)
    full = known.join(at, ["conv_id", "depth"], "left").withColumns({"block": block, "saved": F.col("saved") + F.coalesce("hung_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))}).drop("hung_saved", "hung_leaves")
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    below = full.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).select("conv_id", "block", F.coalesce(F.sum("s").over(lower), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(lower), F.lit(0)).alias("l"))
    run = full.withColumns({"saved_tokens": F.sum("saved").over(up), "n_leaves": F.sum("leaves").over(up)}).join(below, ["conv_id", "block"])
    out = run.join(ends(chained), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("l")).alias("n_leaves"), (F.col("saved_tokens") + F.col("s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def trie(conversations: DataFrame, base: Callable[[Column], Column] | None = None, most: Callable[[Column], Column] | None = None, longest: int = 0) -> DataFrame:
    """The nodes of the trie. With ``base`` and ``most``, functions of a conv_id, each conversation first gets up to
    ``longest`` turns of another in place of its own first ones."""
    numbered = cut(turns(conversations))
    return tree(*prefixes(numbered, base and shared_starts(numbered, base, most, longest)))
