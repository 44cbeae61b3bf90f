"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; every K consecutive words hash to a gram. Of each window of W = SPAN - K + 1 grams the smallest hash
is kept (the leftmost of equals), so any span of SPAN shared words holds a gram that both sides kept at the same place.
Kept grams of documents and items are joined; a hit names an item and a diagonal (the document position minus the item
position), along which the match is extended word by word. Words inside a run of SPAN equal words are hit. Items of
fewer than SPAN words are one window each: all document grams of just those lengths are looked up instead.

The benchmark side is broadcast only if its written files are small; otherwise both sides are shuffled, in a join that
Spark can split by skew. Words are hashed to find candidates and compared as words to confirm them.

Defined edge cases: a null text has no words; an item without words is ignored; several rows of one item_id count as one
item, each with windows of its own text, a null item_id counts as an item whose id prints as the empty string; rows with null or repeated doc_id are judged
each by its own text; empty tables give no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import cut, lower_ascii, sized

#: What lies between words, once A-Z are lower-cased: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
K = 5


def words(text: Column) -> Column:
    """Lower-cased words of a text; none if it is null. Split, at a tenth of the time that extracting every match takes."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BETWEEN), ""), F.array().cast("array<string>"))


def _grams(w: str, k: int) -> str:
    """SQL: the hashes of all k consecutive words of the array column ``w``, which has at least k."""
    return f"transform(sequence(1, size({w}) - {k - 1}), i -> xxhash64({k}, slice({w}, i, {k})))"


def _winnowed(w: str, g: str) -> str:
    """SQL: structs (pos, h) of the grams that winnowing keeps, positions from 0."""
    size = SPAN - K + 1
    part = f"slice({g}, j, {size})"
    kept = f"array_distinct(transform(sequence(1, size({g}) - {size - 1}), j -> int(j + array_position({part}, array_min({part})) - 2)))"
    none = "cast(array() as array<struct<pos:int,h:bigint>>)"
    return f"if(size({w}) >= {SPAN}, transform({kept}, p -> named_struct('pos', p, 'h', {g}[p])), {none})"


def _short(w: str, n: int) -> str:
    """SQL: structs (pos, h) of all runs of n words."""
    none = "cast(array() as array<struct<pos:int,h:bigint>>)"
    return f"if(size({w}) >= {n}, transform({_grams(w, n)}, (h, p) -> named_struct('pos', p, 'h', h)), {none})"


def item_texts(items: DataFrame) -> DataFrame:
    """(item, text_key, item_words): the distinct texts of items; rows that share an item_id are told apart by a hash."""
    i = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("item_words"))
    return i.filter(F.size("item_words") > 0).select("item", F.xxhash64("item_words").alias("text_key"), "item_words").distinct()


def item_prints(texts: DataFrame) -> DataFrame:
    """(item, text_key, n_item, ipos, h): the fingerprints of items, one row per kept gram."""
    i = texts.withColumnRenamed("item_words", "w").withColumn("n_item", F.size("w"))
    long = i.filter(F.col("n_item") >= SPAN).withColumn("g", F.expr(_grams("w", K)))
    long = long.select("item", "text_key", "n_item", F.explode(F.expr(_winnowed("w", "g"))).alias("f")).select("item", "text_key", "n_item", F.col("f.pos").alias("ipos"), "f.h")
    short = i.filter(F.col("n_item") < SPAN).select("item", "text_key", "n_item", F.lit(0).alias("ipos"), F.xxhash64("n_item", "w").alias("h"))
    return long.unionByName(short)


def _key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("digest")]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])


def scan(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has doc_id, digest, n_words for each document row; hits one row per doc_id, digest with
    n_hit and items (sorted strings). Both are written tables or read from them."""
    texts = cut(item_texts(items))
    prints = cut(item_prints(texts))
    # Item lengths below SPAN: nine values at most.
    lengths = sorted(r[0] for r in prints.filter(F.col("n_item") < SPAN).select("n_item").distinct().collect())

    d = docs.select(*_key(docs), words(docs["text"]).alias("w"))
    d = d.withColumn("g", F.expr(f"if(size(w) >= {SPAN}, {_grams('w', K)}, cast(array() as array<bigint>))"))
    arrays = [_winnowed("w", "g"), *(_short("w", n) for n in lengths)]
    own = "array(named_struct('pos', -1, 'h', xxhash64(doc_id, digest)))"  # each row's own entry, which carries n_words
    d = d.select("doc_id", "digest", F.size("w").alias("n_words"), F.explode(F.expr(f"concat({own}, {', '.join(arrays)})")).alias("f"))
    d = d.select("doc_id", "digest", "n_words", "f.pos", "f.h")
    j = d.join(sized(prints), "h", "left")
    j = j.filter("pos = -1 or item is not null")
    found = cut(j.select("doc_id", "digest", "n_words", "pos", F.when(F.col("pos") >= 0, F.col("item")).alias("item"), "text_key", "n_item", (F.col("pos") - F.col("ipos")).alias("diag")))
    # The row's own entry could only meet an item by a 64-bit collision; one per row is kept in any case.
    rows = found.filter("pos = -1 and item is null").select("doc_id", "digest", "n_words")
    lines = cut(found.filter("pos >= 0").groupBy("doc_id", "digest", "item", "text_key", "n_item", "diag").agg(F.lit(1).alias("one")))
    return rows, _extend(docs, lines, texts)


def _extend(docs: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Extends candidate diagonals to runs of equal words and gathers them per document."""
    per_doc = lines.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("item", "text_key", "n_item", "diag")).alias("lines"))
    per_doc = cut(per_doc)
    d = docs.select(*_key(docs), "text")
    other = sized(per_doc).select(F.col("doc_id").alias("c_doc"), F.col("digest").alias("c_digest"), "lines")
    on = d["doc_id"].eqNullSafe(F.col("c_doc")) & (d["digest"] == F.col("c_digest"))
    d = d.join(other, on).select("doc_id", "digest", words(F.col("text")).alias("w"), "lines")
    # The stretch of the document that lies beside the item: first is its offset in the item.
    cuts = """transform(lines, l -> named_struct('item', l.item, 'text_key', l.text_key, 'diag', l.diag, 'first', greatest(0, -l.diag),
        'part', slice(w, greatest(0, l.diag) + 1, greatest(0, least(size(w) - l.diag, l.n_item) - greatest(0, -l.diag)))))"""
    d = d.select("doc_id", "digest", F.explode(F.expr(cuts)).alias("c")).select("doc_id", "digest", "c.*")
    j = d.join(sized(texts), ["item", "text_key"])
    j = j.withColumn("span", F.least(F.size("item_words"), F.lit(SPAN)))
    j = j.withColumn("same", F.expr("transform(part, (x, i) -> x = item_words[first + i])"))
    j = j.withColumn("starts", F.expr("if(size(same) < span, cast(array() as array<int>), filter(sequence(0, size(same) - span), s -> not array_contains(slice(same, s + 1, span), false)))"))
    j = j.filter(F.size("starts") > 0)
    j = j.withColumn("at", F.expr("array_distinct(flatten(transform(starts, s -> sequence(diag + first + s, diag + first + s + span - 1))))"))
    j = cut(j.select("doc_id", "digest", "item", "at"))
    # Words and items are made distinct by partial aggregates before they are counted or gathered per document.
    n_hit = j.select("doc_id", "digest", F.explode("at").alias("p")).distinct().groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_hit"))
    got = j.select("doc_id", "digest", "item").distinct().groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    g = got.select(F.col("doc_id").alias("g_doc"), F.col("digest").alias("g_digest"), "items")
    on = n_hit["doc_id"].eqNullSafe(F.col("g_doc")) & (n_hit["digest"] == F.col("g_digest"))
    return n_hit.join(g, on).select("doc_id", "digest", "n_hit", "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated per document row."""
    rows, hits = scan(docs, items)
    h = cut(hits).select(F.col("doc_id").alias("h_doc"), F.col("digest").alias("h_digest"), "n_hit", "items")
    j = rows.join(h, rows["doc_id"].eqNullSafe(F.col("h_doc")) & (rows["digest"] == F.col("h_digest")), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n(F.col("n_hit")).alias("n_hit"), n(F.size("items")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest of :func:`contamination`."""
    c = contamination(docs, items)
    return c.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark span, with their own columns."""
    _, hits = scan(docs, items)
    h = cut(hits.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_h")))
    return docs.join(h, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left_anti")
