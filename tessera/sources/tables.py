"""Intermediate tables in the folder that driver and executors share.

What a job reads more than once is written there: files survive lost executors and end the lineage, and Spark then knows
their sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one temporary folder in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return (folder if ":" in folder else "file://" + folder).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for each call."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back with the same schema."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
