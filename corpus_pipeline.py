"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's input.

Stages: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is replaced in the texts, and the sources are mixed.  All but the
last return the columns of documents; the last adds n_tokens, copy, block and slot.  No stage drops
other documents, and with the budget of the last stage every document is used once at least.

Documents with a null or empty text are neither toxic, copies, contaminated nor redacted, so they go
through to the end.  Rows without an id are no copies of anything; of rows that share an id, each is
judged by its own text, and one of each near-duplicate group stays.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, decontaminate, mixing, near_dedup, pii, queries, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the chain of classifiers rejects go."""
    return toxicity.keep_clean(docs, queries.toxicity_chain(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays."""
    return near_dedup.without_copies(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go."""
    return decontaminate.without_hits(docs, common.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", clean), ("near_dedup", distinct), ("decontamination", unseen), ("pii", private), ("mixing", mixed)]

#: a learned classifier decides the first stage, so SQL can't express the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of the folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
