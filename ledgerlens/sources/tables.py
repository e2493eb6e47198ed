"""Parquet tables of a database folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The tables of the test database.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Make every table of the folder a temporary view, so that SQL text can name it."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
