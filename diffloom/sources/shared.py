"""Tables of a run, written once to the folder that all executors share and read by every later step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="diffloom-")
        sc.setCheckpointDir(top)
    path = f"{top}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # goes with the session's JVM
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written and read back: later steps read files that outlive any executor instead of working it out again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
