"""Weighted similarity against tables of the longest common subsequence, and the names that it brings together."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from permitflow.functions import similarity as S
from permitflow.operators import resolver


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    both = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(200 * lcs(x, y[max(0, i) : i + len(x)]) / (len(x) + len(y[max(0, i) : i + len(x)])) for x, y in both for i in range(1 - len(x), len(y)))


def test_subsequences_and_stretches():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, n))) for n in (9, 14))
        assert S.common(a, b) == lcs(a, b)
        assert S.partial(a, b) == pytest.approx(partial(a, b))
        w = S.weighted(a, b)
        assert all(S.weighted(a, b, least) == (w if w >= least else 0) for least in (50, 88))
    long = "".join(rng.choices("abcdefg", k=200))
    assert S.common(long, long[::2]) == 100 and S.partial(long[40:90], long) == 100


def test_known_scores():
    assert S.share("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert S.partial("this is a test", "this is a test!") == 100
    assert S.word_sorted("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert S.share("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.9, abs=0.02)
    assert S.word_sorted("fuzzy was a bear", "fuzzy fuzzy was a bear") == pytest.approx(84.2, abs=0.02)
    assert S.word_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    # A name within a longer one scores 90, whichever it is; one far longer doesn't.
    assert S.weighted("יעקב", "רחוב יעקב כהן") == S.weighted("כאהן", "כאהן יעקב") == pytest.approx(90)
    assert S.weighted("ab", "x" * 20 + " ab") == pytest.approx(60)
    assert S.weighted("", "a") == S.weighted("a", "") == 0 and S.weighted("same name", "name same") == 95


def test_no_similar_pair_is_missed(spark):
    """All pairs of made-up names at or above the threshold meet, whatever brings them together."""
    rng = random.Random(7)
    words = ["north", "south", "hill", "mill", "road", "a", "bb", "of", "saint", "stone", "stones", "river", "aa", "aaaa", "éclair", "old", "Z"]
    made = {" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 4]))) for _ in range(130)}
    for name in list(made)[:90]:
        i = rng.randrange(len(name))
        made |= {name[:i] + name[i + 1 :], name[:i] + rng.choice("xyz ") + name[i:], " ".join(rng.sample(name.split(), len(name.split()))), name[i : i + rng.randint(1, 30)]}
    made |= {"a" * 12, "a" * 11 + "b", "the long winding road to the north of the old stone mill", "long winding road to the norht of the old", "x"}
    made = sorted({" ".join(n.split()) for n in made} - {""})
    q = spark.createDataFrame([(n,) for n in made], "q string")
    got = {(r["q"], r["street_key"]): r["score"] for r in resolver.similar(q, q.withColumnRenamed("q", "street_key"), 88.0).collect()}
    want = {(a, b): S.weighted(a, b) for a in made for b in made if S.weighted(a, b) >= 88}
    assert set(want) == set(got) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert len(want) > 2 * len(made)
    with pytest.raises(ValueError):
        resolver.similar(q, q, 80.0)


def test_fuzzy_declines_and_takes(spark):
    index = spark.createDataFrame([("cohen", "A"), ("cohen jacob", "A"), ("mill road", "B"), ("hill road", "C"), ("jacob street", "D"), ("jacob square", "E")], "street_key string, neighborhood string")
    index = index.withColumns({"house_from": F.lit(0), "house_to": F.lit(99999), "priority": F.lit(2), "ord": F.monotonically_increasing_id()})
    q = spark.createDataFrame([(1, "road mill"), (2, "jacob"), (3, "cohens"), (4, "zzz"), (5, None)], "rid long, street string").withColumn("number", F.lit(3))
    got = {r["rid"]: (r["neighborhood"], round(r["confidence"], 4), r["method"]) for r in resolver.fuzzy(q, index).collect()}
    # "jacob" is within names of three areas: a guess, so it is declined.
    assert set(got) == {1, 3} and got[1] == ("B", 0.95, "fuzzy_street_level_p2") and got[3][0] == "A"
