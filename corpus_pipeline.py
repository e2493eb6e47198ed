"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, personal data, packing.

Each stage reads what the one before it wrote and hands on whole rows. Rows are judged or changed where
they lie, so columns keep their names and values, further ones too.

Cases: null and empty texts fail the quality rules (fewer than 50 words). Rows with equal ids are judged one by one in the first two
stages; the third keeps one row of a group: the one with the smallest id, of several such rows the
smallest by all columns. Rows of a group without any id count as one group per fingerprint. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import packing, pii, quality_rules, simhash, toxicity
from ledgerlens.llm.frames import documents
from ledgerlens.session import stage
from ledgerlens.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.passing(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The classifier and the field are fitted models: no SQL says the same. The stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
