"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on a local master, where one machine has everything, a temporary folder is
    made and set if there is none; elsewhere that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="deltaloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows and their partitions as they are now, in the shared folder: what is read again is the same."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
