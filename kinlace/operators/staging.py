"""Tables in the folder that all executors share: where a lineage ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only a session without executors of its own may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kinlace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """The frame, written to the shared folder and read from there."""
    path = os.path.join(shared_folder(df.sparkSession), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
