"""Tables cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir; a local session without it makes one of its own, any other raises."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pairwell-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: later plans start from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
