"""From raw documents to a training mix: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each stage's rows as Parquet to the cluster's shared
folder and reads them back for the next one, so a lost executor costs one
stage at most.

1. quality rules: lines that fail go, documents that fail go
2. line dedup: lines found in several documents stay in the first only
3. near dedup: one document of each group of near duplicates stays
4. decontamination: documents that hold a benchmark item go
5. source mix: how many words of each document the training mix takes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import stored, table
from kinweave.llm.decontam import drop_leaked
from kinweave.llm.linededup import keep_lines
from kinweave.llm.mixing import mixed_documents
from kinweave.llm.neardup import keep_one
from kinweave.llm.quality import keep_good
from kinweave.sources.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near dedup has no statement in SQL; the stages are tested one by one and together against brute force.
ORACLE_SQL = None
