"""The filter audit against a brute-force form, with copies that span partitions."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from permitflow.llm import filter_audit
from permitflow.llm.queries import op12_filter_audit

SF = "/root/testdata/sf0.001"
COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_masks(docs):
    out = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in docs)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), e]
        out.append((d, lang or "", "".join(f for f, x in zip("ABCDE", fails, strict=True) if x)))
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    m = brute_masks(docs)
    rows = {}
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in m}:
            for i, f in enumerate(order):
                rows[part, "".join(order), i + 1] = Counter(kept=0)
        for d, part, fails in m:
            first = next((i for i, f in enumerate(order) if f in fails), 9)
            for i, f in enumerate(order):
                r = rows[part, "".join(order), i + 1]
                r["kept"] += i < first
                r["removed"] += i == first
                r["redundant"] += f in fails and i > first
                r["unique"] += fails == f
                r["good"] += i == first and d in good
                r["toxic"] += i == first and d in toxic
    shap = Counter()
    for (part, order, step), r in rows.items():
        shap[part, order[step - 1]] += r["removed"]
    return sorted((*k, r["kept"], r["removed"], r["redundant"], r["unique"], r["good"], r["toxic"], shap[k[0], k[1][k[2] - 1]]) for k, r in rows.items())


def rows_of(df):
    assert df.columns == COLS
    return sorted(map(tuple, df.collect()))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert rows_of(op12_filter_audit(spark, SF)) == brute(docs, labels)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    long = " ".join(f"W{i % 500}" for i in range(50_000))
    docs = [(None, "", "en"), (None, "same", "en"), (3, None, None), (3, None, "en"), (4, "", ""), (5, long, "de"), (5, long, "de"), (6, long, "de"), (0, "same", None), (1, "same", "fr"), (2, "éÉ A#  x", "fr")]
    docs += [(10 + i, "copy of one text", "en") for i in range(300)] + [(1000 + i, " ".join(rng.choices("ab cd EF g# h".split(), k=rng.choice([2, 120]))), "en") for i in range(40)]
    rng.shuffle(docs)
    labels = [(10, 1, 1), (10, 0, 0), (11, None, 1), (None, 1, 1), (3, 1, None), (9999, 1, 1), (1001, 1, 0)]
    return docs, labels


@pytest.mark.parametrize("parts", ["1", "9", "64"])
def test_odd_rows_and_copies_over_partitions(spark, odd, parts):
    docs, labels = odd
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, mask int, fp string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted((r["doc_id"], r["part"], "".join(f for i, f in enumerate("ABCDE") if r["mask"] >> i & 1)) for r in filter_audit.masks(d).collect() if r["doc_id"] is not None)
        assert got == sorted(x for x in brute_masks(docs) if x[0] is not None)
        got = rows_of(filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
        assert got == brute(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_texts_with_one_fingerprint_are_compared_whole():
    """Rows of a partition whose two texts share a fingerprint; the partition's first fingerprint is looked up elsewhere."""
    import pyarrow as pa

    class Here:
        def partitionId(self):
            return 4

    rows = [(1, "a", 7, "x"), (2, "a", 7, "x"), (1, "a", 7, "y"), (5, "a", 7, "y"), (1, "a", 9, "z")]
    b = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "part", "fp", "text"])
    old, filter_audit.TaskContext = filter_audit.TaskContext, type("T", (), {"get": staticmethod(Here)})
    try:
        out = [r for x in filter_audit._marked(iter([b.slice(0, 2), b.slice(2)])) for r in x.to_pylist()]
    finally:
        filter_audit.TaskContext = old
    marked = [r["mask"] >> 4 for r in out if r["mask"] is not None]
    assert marked == [0, 1, 0, 1, 0] and [r["at"] for r in out] == [4, 4, 4, 4, None, 4] and out[-1]["fp"] == 9


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert rows_of(filter_audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == []


def test_counters_add_up(spark, odd):
    """Counters of two batches without copies of each other's texts are those of both together."""
    docs, labels = odd
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    halves = [[x for x in docs if x[2] == "de"], [x for x in docs if x[2] != "de"]]
    made = [filter_audit.counters(filter_audit.masks(spark.createDataFrame(h, "doc_id long, text string, lang string")), lab) for h in halves]
    both = made[0].unionByName(made[1])
    assert rows_of(filter_audit.orders(both)) == brute(docs, labels)
