"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; all
but the last return the columns of ``documents``. :func:`run` writes each result as Parquet in the shared folder and
reads it back as the next stage's input, so a lost executor never costs more than the stage at hand.

Defined edge cases: a null or empty text has no words and fails the base rule, so it goes in the first stage, as do texts
below fifty words; a null ``lang`` or ``source`` is a group, and a site, of its own; a row without a ``doc_id`` stays in the
near-duplicate stage only if its group has no id at all, and rows that repeat a doc_id stay together there; a text of any
length is processed whole; empty tables give empty results; extra columns pass through all stages but the last, whatever
their names. A line that is cut may leave a text of fewer words, or none: it is kept, since each stage judges its own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from permitflow.llm import decontam, line_dedup, near_copies, packing, quality
from permitflow.llm.common import cut, table
from permitflow.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond their group's fences go."""
    return quality.filter_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts, but for their first place."""
    return line_dedup.dedup_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest doc_id: SimHash of five-word shingles, confirmed by
    Jaccard 0.8 or more; links between fingerprints too far apart are found by shingles."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark span go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Quantile sketches, fingerprints and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
