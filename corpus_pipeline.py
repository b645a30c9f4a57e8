"""A training corpus from raw documents, stage by stage.

Quality rules with risk-controlled thresholds drop bad documents, near-duplicate groups keep one
document, personal data get surrogates, sources are mixed to their target weights (documents are
left out or repeated), and what remains is packed into token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, near_dup, packing, quality_rules, surrogates
from sparkloom.llm.common import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; rows as they were."""
    return quality_rules.good_documents(spark, docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8), the one of the smallest doc_id."""
    return near_dup.one_of_each(spark, docs.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data, and n_chars of the new texts."""
    out = surrogates.replace(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: left out, once or twice."""
    return mixing.repeated(spark, docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document at its place in a sequence of at most 4096 tokens."""
    return packing.pack_documents(spark, docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", dedup),
    ("surrogates for personal data", private),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Random trees and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
        if last is not None:
            work.drop(last)
        last = docs
    return docs
