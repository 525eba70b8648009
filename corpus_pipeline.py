"""Corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. A part of ``palimpsest.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import mix, packing, pii, quality, simhash
from palimpsest.staging import cut, drop, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mix", source_mix), ("packing", best_fit)]
#: Fingerprints and components have no short SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. A stage's own tables, and its predecessor's rows, are deleted once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            new = keep(cut(stage(spark, docs, sf_dir), name))
        drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
