"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only under a local master (tests), where there is no other machine and
    it may be unset, a folder of this one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        swept(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def swept(spark: SparkSession, path: str) -> None:
    """The path goes when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table: worked out once, however often they are used, and read by the columns that a use needs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scoring-{uuid.uuid4().hex}"
    df.write.parquet(path)
    swept(spark, path)
    return spark.read.schema(df.schema).parquet(path)
