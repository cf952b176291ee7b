"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or in local mode a folder of our own where it is unset (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="answerscore-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once however often it is used, and lost
    executors cost nothing that was written."""
    path = f"{shared_folder(df.sparkSession)}/answerscore/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
