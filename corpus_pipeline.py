"""The corpus pipeline: documents through quality rules, near-duplicate
removal, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of documents; the last adds size,
shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptsearch.llm import decontamination, mixing, near_dups, quality_rules, sharding
from conceptsearch.llm.tables import materialise, table
from conceptsearch.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dups.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed, _ = sharding.place(docs)
    return placed


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The near-duplicate, mixing and sampling stages can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k + 1}")
    return docs
