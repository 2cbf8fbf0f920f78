"""Intermediates in the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set as the context's checkpoint directory.

    With neither there is no folder that all executors see, so nothing is made up: an error says what to set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known.get()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder; nothing is made yet."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Written once and read back: cuts lineage and outlives lost executors."""
    to = shared_folder(df.sparkSession, what)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
