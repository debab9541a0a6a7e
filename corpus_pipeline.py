"""A corpus pipeline: quality filter, exact and near dedup, decontamination, tokens.

Each stage takes all documents that the one before kept. Between stages the
documents are written to the shared folder and read back, so a lost executor
costs the tasks it ran and no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import exact_dedup, quality, queries, simhash, winnow
from axiomata.llm.common import free_name, written
from axiomata.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of those that are here."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = free_name(docs, "score")
    scored = quality.with_score(docs, machine, keep=tuple(docs.columns), score=score)
    return scored.filter(F.col(score) >= 0.5).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then the one of least id."""
    return exact_dedup.distinct_kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by four fifths of their five-word shingles the document of least id."""
    return simhash.distinct_kept(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and digests of its ids and of what they decode to."""
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The classifier and the similarity of shingles have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
