from __future__ import annotations

import random

import corpus_pipeline
from permitflow.llm import near_copies, simhash
from permitflow.llm.common import cut
from tests.llm import brute


def shingle_set(text, k=5):
    w = brute.SPACE.findall((text or "").translate(brute.LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def kept(rows):
    """Ids that stay, by comparing every pair. rows: (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    groups = {}
    for (d, _), v in zip(rows, label, strict=True):
        groups.setdefault(v, []).append(d)
    return {min((d for d in g if d is not None), default=None) for g in groups.values()}


def test_stage_against_pairwise_jaccard(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = ["", None, "One two", "one TWO", "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o p"]
    for g in range(40):
        base = [word() for _ in range(r.randrange(8, 120))]
        if g % 3 == 0:
            base += passage
        for _ in range(r.randrange(1, 8)):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - r.randrange(0, 8)]))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows.append((None, texts[10]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)


def test_stage_on_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert got == kept([(x["doc_id"], x["text"]) for x in docs.collect()])


def test_stage_on_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out = corpus_pipeline.simhash_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 0


def test_fingerprints_within_reach_meet(spark):
    r = random.Random(3)
    rows, want = [], set()
    for i in range(0, 400, 2):
        fp = r.getrandbits(64)
        other = fp
        for b in r.sample(range(64), r.randrange(0, near_copies.REACH + 1)):
            other ^= 1 << b
        rows += [(i, simhash._signed(fp)), (i + 1, simhash._signed(other))]
        want.add((i, i + 1))
    nodes = spark.createDataFrame(rows, "node long, fp long")
    got = {tuple(x) for x in simhash.meetings(cut(nodes), near_copies.REACH).collect()}
    assert want <= got and all(a < b for a, b in got)


def test_near_copies_are_found_by_fingerprint(spark):
    """Each text has one copy with a word changed; those within reach are found before any shingle is looked up."""
    r = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(100, 600))]
        copy = list(base)
        copy[r.randrange(len(copy))] = "other"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = cut(docs.mapInArrow(near_copies._prefixes(*near_copies.common(docs, 5), 5), "doc_id long, node long, n int, fp long, prefix array<long>, spread binary"))
    of = {x["doc_id"]: x for x in rows.collect()}
    want = set()
    for i in range(0, len(texts), 2):
        a, b = of[i], of[i + 1]
        x, y = shingle_set(texts[i]), shingle_set(texts[i + 1])
        if (a["fp"] ^ b["fp"]).bit_count() <= near_copies.REACH and 5 * len(x & y) >= 4 * len(x | y):
            want.add((min(a["node"], b["node"]), max(a["node"], b["node"])))
    got = {tuple(x) for x in near_copies.by_fingerprint(docs, rows, 5).collect()}
    alike = {tuple(sorted((of[i]["node"], of[i + 1]["node"]))) for i in range(0, len(texts), 2)}
    assert len(want) >= 20 and want <= got <= alike
    assert all(simhash.of_hashes(near_copies.shingles(t)) % (1 << 64) == of[i]["fp"] % (1 << 64) for i, t in enumerate(texts))


def test_tables_are_filled_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODES", 100)
    nodes = cut(spark.range(1000).coalesce(1).selectExpr("id as node", "xxhash64(id div 2) as fp"))
    plan = simhash.meetings(nodes, near_copies.REACH)
    assert {(r["a"], r["b"]) for r in plan.collect()} >= {(2 * i, 2 * i + 1) for i in range(500)}
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()


def test_common_shingles_are_counted_in_one_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four five six {i}") for i in range(400)], "doc_id long, text string")
    plans, own = [], near_copies.cut
    monkeypatch.setattr(near_copies, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1])
    h, n = near_copies.common(docs, 5)
    assert len(h) == 2 and min(n) > 64 and plans[0].count("MapInArrow") == 1
