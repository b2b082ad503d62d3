"""Cutting the lineage of iterative jobs, and names for tables in the shared folder."""

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without one, only jobs in one process (tests) get a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new name for tables in the shared folder."""
    return f"{_shared(spark)}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """As checkpoint, as a table, whose size Spark knows."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Have the driver collect what the rounds of a loop leave: shuffle files go only when their handles are collected, which a driver with room to spare puts off."""
    gc.collect()  # frames of our own that are in cycles hold theirs
    spark._jvm.System.gc()
