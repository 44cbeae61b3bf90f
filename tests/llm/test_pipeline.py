from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_near_copies import kept as near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, frames[-1], SF).write.parquet(out)
        frames.append(spark.read.parquet(out))
    data = [f.collect() for f in frames]
    assert all(f.columns == columns for f in frames[:-1])
    base = {r["doc_id"] for r in data[0] if not brute.quality(r["text"])[-1]}
    kept = {r["doc_id"] for r in data[1]}
    assert kept <= base and len(kept) >= 0.9 * len(base)
    want = brute.line_dedup([(r["doc_id"], r["text"], r["source"]) for r in data[1]])
    assert {r["doc_id"]: r["text"] for r in data[2]} == {r["doc_id"]: t for r, t in zip(data[1], want, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in data[2])
    assert {r["doc_id"] for r in data[3]} == near([(r["doc_id"], r["text"]) for r in data[2]])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = brute.decontaminate([r["text"] for r in data[3]], items)
    assert {r["doc_id"] for r in data[4]} == {r["doc_id"] for r, b in zip(data[3], bad, strict=True) if not b[4]}
    assert {r["doc_id"] for r in data[5]} == {r["doc_id"] for r in data[4]}
