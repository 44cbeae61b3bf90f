"""Mixing by curriculum against a brute-force form: targets, words taken, and the order of training."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from permitflow.llm import curriculum
from permitflow.llm.queries import op13_mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def brute(docs):
    """(doc_id, size, source_size, target, taken) per document."""
    rows = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in docs]
    size = defaultdict(int)
    for _, n, s in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w >= 3 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        rest -= sum(3 * size[s] for s in over)
        free -= over
    out = []
    for s in names:
        mine = sorted((hashlib.md5(str("" if d is None else d).encode()).hexdigest(), d is not None, d or 0, n) for d, n, x in rows if x == s)
        left, taken = int(target[s] + 0.5), [0] * len(mine)
        for _ in range(3):
            for i, (*_, n) in enumerate(mine):
                got = min(n, left)
                taken[i] += got
                left -= got
        out += [(d if has else None, n, size[s], target[s], k) for (_, has, d, n), k in zip(mine, taken, strict=True)]
    return out


def same(df, want):
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect()), key=str)
    want = sorted(want, key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(op13_mixing(spark, SF), brute(docs))


@pytest.fixture(scope="module")
def odd():
    """A source with most rows, one of a single long text, tiny ones whose ceilings hold, a null one, and empty texts."""
    docs = [(i, "w " * (i % 9), "big") for i in range(400)] + [(1000, "long " * 5000, "a"), (1001, "x", "tiny"), (1002, "x y", "tiny2"), (1003, None, "none"), (1004, "", None), (1005, "a b c", None)]
    return docs + [(None, "p q", "big"), (None, "p q", "big"), (7, "p q r", "big"), (7, "p q r", "big"), (1006, "é ü", "Z"), (1007, "é ü", "\U0001f600"), (1008, "v", "￿")]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, 1, "y") for r in odd], f"{SCHEMA}, size int, rank string").repartition(5)
    same(curriculum.mix(df), brute(odd))


def test_placements(spark, odd):
    """The order of training: sorted by position, a source's words to its target, rates as the schedule says."""
    df = spark.createDataFrame(odd, SCHEMA).repartition(5)
    rows = curriculum.curriculum(df).collect()
    at = [r["position"] for r in rows]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    words = defaultdict(int)
    for r in rows:
        words[r["source"]] += r["words"]
    want = {}
    for (d, t, s), b in zip(odd, odd, strict=True):
        want.setdefault(s, 0)
    target = {s: x[3] for s in want for x in brute(odd) if x[2] == sum(len((t or "").split()) for _, t, z in odd if z == s)}
    assert {s: n for s, n in words.items()} == {s: int(x + 0.5) for s, x in target.items() if x}
    # "big" has an early schedule or a late one: half its words fall before or after the middle as its integral says.
    names = sorted({s for _, _, s in odd}, key=lambda s: (s is None, (s or "").encode()))
    sched = curriculum.SCHEDULES[names.index("big") % 3]
    first = sum(r["words"] for r in rows if r["source"] == "big" and r["position"] < 0.5)
    t, rates, area = curriculum._demand(sched)
    half = sum((min(b, 0.5) - a) * (x + (x + (y - x) * (min(b, 0.5) - a) / (b - a))) / 2 for a, b, x, y in zip(t, t[1:], rates, rates[1:], strict=False) if a < 0.5)
    assert first / words["big"] == pytest.approx(half, abs=0.02)


def test_position_inverts_the_integral(spark):
    for sched in (*curriculum.SCHEDULES, ((0, 0), (0.25, 4), (0.5, 0), (0.75, 0), (1, 2))):
        t, r, area = curriculum._demand(sched)

        def demand(x, t=t, r=r, area=area):
            i = max(k for k in range(len(t) - 1) if t[k] <= x)
            slope = (r[i + 1] - r[i]) / (t[i + 1] - t[i])
            return area[i] + r[i] * (x - t[i]) + slope * (x - t[i]) ** 2 / 2

        got = spark.range(0, 100).selectExpr("id / 100D as s").withColumn("x", curriculum.position(F.col("s"), sched)).collect()
        assert [demand(row["x"]) for row in got] == pytest.approx([row["s"] for row in got], abs=1e-9)
    with pytest.raises(ValueError):
        curriculum._demand(((0, 1), (0.5, 1)))


def test_reruns_and_empty(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA)
    assert sorted(curriculum.mix(df.repartition(3)).collect(), key=str) == sorted(curriculum.mix(df.repartition(8)).collect(), key=str)
    assert curriculum.mix(df.limit(0)).collect() == [] and curriculum.curriculum(df.filter("doc_id = 1003")).collect() == []
