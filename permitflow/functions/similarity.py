"""Weighted similarity of names: the best of whole, partial and word-order-free comparisons, on a scale of 0 to 100.

All measures rest on the longest common subsequence (LCS), found bit-parallel: a row of the usual table is the bits of one
number. The share of two texts is 200 * LCS / (both lengths). A partial share is the best one of the shorter text with any
stretch of the longer, no longer than itself. Word-sorted shares compare the words in order of the alphabet; word-set
shares compare what two sets of words have in common with either whole set, and the two remainders.

The weighted score is the largest of the whole share and, with weight 0.95, the sorted and set shares, where lengths differ
by less than half; else of the whole share and, weighing 0.9 or 0.6, the partial ones.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the score and the ratios of lengths at which they change.
WORDS_WEIGHT, PARTIAL_WEIGHT, FAR_WEIGHT = 0.95, 0.9, 0.6
PARTIAL_FROM, FAR_FROM = 1.5, 8.0


def _places(text: str) -> dict[str, int]:
    """Per character, the bits of the places where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence of ``a``, whose ``places`` may be given, and ``b``."""
    places = _places(a) if places is None else places
    full = (1 << len(a)) - 1
    # A zero bit is a step up of the table's row, so the row's last value is the number of zeros.
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def share(a: str, b: str) -> float:
    """200 * LCS / (both lengths); 100 for two empty texts."""
    n = len(a) + len(b)
    return 200 * common(a, b) / n if n else 100.0


def partial(a: str, b: str, least: float = 0.0) -> float:
    """The best share of the shorter text with a stretch of the longer, at either end also shorter ones; 0 where one text is
    empty or nothing reaches ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if len(a) == len(b):
        return max(_stretches(a, b, least), _stretches(b, a, least))
    return _stretches(a, b, least)


def _stretches(a: str, b: str, least: float) -> float:
    m, n, places = len(a), len(b), _places(a)
    best = 0.0
    spans = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
    for i, j in spans:
        # A stretch that ends in a strange character is no better than the one before it; nor is one at the end that starts so.
        if b[i if i > n - m else j - 1] not in places:
            continue
        if 200 * min(m, j - i) <= best * (m + j - i):
            continue
        best = max(best, 200 * common(a, b[i:j], places) / (m + j - i))
        if best == 100:
            break
    return best if best >= least else 0.0


def word_sorted(a: str, b: str) -> float:
    return share(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def word_set(a: str, b: str) -> float:
    """100 where one set of words holds the other; 0 where a text has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    rest = [" ".join(sorted(s)) for s in (x - y, y - x)]
    joint = len(both) + bool(both)
    lengths = [joint + len(r) for r in rest]
    apart = len(rest[0]) + len(rest[1]) - 2 * common(*rest)
    out = [100 * (1 - apart / sum(lengths))]
    if both:
        out += [100 * (1 - (1 + len(r)) / (len(both) + n)) for r, n in zip(rest, lengths, strict=True)]
    return max(out)


def partial_words(a: str, b: str) -> float:
    """100 where a word is common; else the partial share of the sorted words or of the sets of words."""
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    best = partial(" ".join(sorted(x)), " ".join(sorted(y)))
    if len(set(x)) < len(x) or len(set(y)) < len(y):
        best = max(best, partial(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))
    return best


def weighted(a: str, b: str, least: float = 0.0) -> float:
    """The weighted score; 0 for an empty text, or for a score below ``least``, which saves work."""
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    best = share(a, b)
    if ratio < PARTIAL_FROM:
        best = max(best, WORDS_WEIGHT * max(word_sorted(a, b), word_set(a, b)))
    else:
        weight = PARTIAL_WEIGHT if ratio <= FAR_FROM else FAR_WEIGHT
        if 100 * weight >= least:
            best = max(best, weight * partial(a, b, least / weight))
        if 100 * weight * WORDS_WEIGHT >= least:
            best = max(best, weight * WORDS_WEIGHT * partial_words(a, b))
    return best if best >= least else 0.0


def _udf(f: Callable[[str, str], float]) -> Callable[[Column | str, Column | str], Column]:
    """``f`` by Arrow batches; pairs that repeat in a batch are scored once, a null is an empty text."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score


def similarity(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Column of weighted scores, 0 where below ``least``."""
    return _udf(lambda x, y: weighted(x, y, least))(a, b)


def measure(f: Callable[[str, str], float], a: Column | str, b: Column | str) -> Column:
    """Column of one of the measures: share, partial, word_sorted, word_set, partial_words."""
    return _udf(f)(a, b)
