"""Quality rules: per-language, per-source adaptive thresholds from mergeable quantile sketches.

Each document is measured once. The measures of every (lang, source) group go into KLL sketches, which merge into those
of languages and of the corpus. A group's quartiles are drawn towards its language's, and those towards the corpus's, by
PULL documents' weight, so a small group borrows and a large one speaks for itself. Fences come from these quartiles,
replace fixed cutoffs, and are joined back to the documents.

A fence stands SPREADS spreads beyond a quartile. A spread is the distance of the quartiles, or what chance alone makes of a
count if that is more: every measure is a count by a size, and a text of the group's median size, or of its own if that is
less, differs from the quartile's count by the root of that count, and by one event at least. So most documents may lack a
thing altogether without a fixed cutoff for the rest, and a short text may hold one or two.

Defined edge cases: a null text has no words and fails the base rule like an empty one; null ``lang`` or ``source``
form a group of their own; repeated rows are measured and judged each by itself; an empty table gives an empty result;
extra columns never enter, since only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitflow.llm.common import cut

SYMBOLS = re.compile(r"[#*$%&|<>]")

#: measure -> (side, size, events in a row). A measure is a count by a size; words of repeated windows come six at a time.
MEASURES = {
    "mean_word": ("both", "n_words", 1),
    "symbol_ratio": ("high", "word_chars", 1),
    "dup_line_ratio": ("high", "n_lines", 1),
    "repeat_ratio": ("high", "n_words", 6),
}
#: What is drawn from each group's sketches: name -> (column, share of documents below).
DRAWN = {f"{k}_{c}": (c, p) for c in MEASURES for k, p in (("q1", 0.25), ("q3", 0.75))} | {f"mid_{c}": (c, 0.5) for c in ("n_words", "word_chars", "n_lines")}
SPREADS = 6.0
#: Documents that the wider group's quartile counts for when it is averaged with a group's own.
PULL = 10
SKETCH_K = 800

METRICS_SCHEMA = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, n_lines long"
)


#: Words from which on windows are compared as numbers in arrays, which hold a long text in little memory.
_LONG = 2000


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if len(words) >= _LONG:
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = np.unique(of[:-1] * len(number) + of[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(number) + of[2:]
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[place] > 1
        hit = np.zeros(len(words), bool)
        for i in range(3):
            hit[i : n + i] |= again
        return int(hit.sum())
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word) of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    # bytes.split() parts at exactly the six ASCII white-space bytes.
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    n_chars = len(text) - len(re.findall(r"[\x20\x09-\x0D]", text)) if n else 0
    n_symbols = len(SYMBOLS.findall(text))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    n_dup = len(lines) - len(set(lines))
    n_repeat = _repeated(words) if n >= 4 else 0
    return n, n_chars, n_symbols, n_dup, n_repeat, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        carried = b.column(3)
        texts = carried.field("text") if pa.types.is_struct(carried.type) else carried
        rows = [measure(x.as_py()) for x in texts]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kept = [carried] if carried is not texts else []
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols), *kept],
            names=[*(x.strip().split()[0] for x in METRICS_SCHEMA.split(",")), *["row"] * len(kept)],
        )


def metrics(docs: DataFrame, carry: str = "") -> DataFrame:
    """One row of base measures per document. The text is not carried on, unless in the struct column ``carry``."""
    keys = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string")]
    src = docs.select(*keys, F.col(carry or "text"))
    schema = T._parse_datatype_string(METRICS_SCHEMA)
    if carry:
        schema = T.StructType([*schema, T.StructField("row", docs.schema[carry].dataType)])
    m = src.mapInArrow(_measured, schema)
    n = F.greatest(F.col("n_words"), F.lit(1))
    return m.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    })


def thresholds(m: DataFrame) -> DataFrame:
    """One row per (lang, source) with the columns of DRAWN. The number of groups is that of the sources times languages.

    Sketches are built once per group and merged upwards, so the corpus is aggregated once.
    """
    names = sorted({c for c, _ in DRAWN.values()})
    base = m.filter(~F.col("base_failed"))
    by_group = base.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias(c) for c in names)
    )
    by_group = cut(by_group)
    merged = [F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(f"l_{c}") for c in names]
    by_lang = by_group.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("l_n"), *merged)
    q = lambda c, p: F.kll_sketch_get_quantile_double(c, F.lit(p))
    # The whole corpus's quantiles: one row of eleven numbers.
    whole = by_group.agg(F.sum("n").alias("n"), *merged).filter("n > 0")
    whole = whole.select(*(q(F.col(f"l_{c}"), p).alias(k) for k, (c, p) in DRAWN.items())).first()

    def drawn(k: str, c: str, p: float) -> Column:
        to = F.lit(whole[k] if whole else None).cast("double")
        to = (F.col("l_n") * q(F.col(f"l_{c}"), p) + PULL * to) / (F.col("l_n") + PULL)
        return (F.col("n") * q(F.col(c), p) + PULL * to) / (F.col("n") + PULL)

    g = by_group.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    return g.select("lang", "source", *(drawn(k, c, p).alias(k) for k, (c, p) in DRAWN.items()))


def fences(c: str) -> tuple[Column | None, Column]:
    """Lowest and highest value of measure ``c`` for a document joined with its group's thresholds."""
    side, size, lump = MEASURES[c]
    n = F.greatest(F.least(F.col(size).cast("double"), F.col(f"mid_{size}")), F.lit(1.0))
    by_chance = lump * F.sqrt(F.col(f"q3_{c}") * n / lump + 1) / n
    reach = SPREADS * F.greatest(F.col(f"q3_{c}") - F.col(f"q1_{c}"), by_chance)
    return F.col(f"q1_{c}") - reach if side == "both" else None, F.col(f"q3_{c}") + reach


def judge(m: DataFrame, drawn: DataFrame) -> DataFrame:
    """Adds ``kept`` to measured rows: false where the base rule failed or a measure lies beyond its fence.

    ``drawn`` is a written table of one row per group, so Catalyst knows its size: it broadcasts a small one by itself
    and shuffles a large one.
    """
    f = drawn.withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source")
    # Null-safe equality is an equi-join key in Spark.
    j = m.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    ok = ~F.col("base_failed")
    for c in MEASURES:
        low, high = fences(c)
        ok = ok & F.coalesce(F.col(c) <= high, F.lit(True))
        if low is not None:
            ok = ok & F.coalesce(F.col(c) >= low, F.lit(True))
    return j.withColumn("kept", ok).drop("f_lang", "f_source", *DRAWN)


def quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict per document row."""
    m = cut(metrics(docs))
    return judge(m, cut(thresholds(m)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns and nothing else.

    The first pass gathers the sketches; the second measures again in the pass that filters, which costs less than
    shuffling every text to meet its verdict. The input row travels as one struct, so its column names cannot clash.
    """
    drawn = cut(thresholds(metrics(docs)))
    m = metrics(docs.select("doc_id", "lang", "source", "text", F.struct(*docs.columns).alias("row")), carry="row")
    return judge(m, drawn).filter("kept").select("row.*")
