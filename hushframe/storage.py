"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is set a run on one machine gets a temporary one; others are refused, as their machines would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hushframe-"))
    return context.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back; the table outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
