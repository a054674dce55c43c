"""The folder that all executors share, for tables and checkpoints of intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and rereads it, for what several later steps read."""
    at = new_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/moments-{kind}-{uuid.uuid4().hex}"
