"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "ledgerlens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors see.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset, a session on one
    machine takes a temporary folder; any other session is refused, as its executors would not see
    each other's files. Whoever owns the folder clears it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or machine_folder(spark.conf.get("spark.master", ""))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def machine_folder(master: str) -> str:
    """A temporary folder for a session whose tasks all run in this process."""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="ledgerlens-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Frames with several consumers are computed once, their lineage ends here, and losing an
    executor loses nothing.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
