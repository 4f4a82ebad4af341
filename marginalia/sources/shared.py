"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where that is unset, a temporary folder in local mode, which
    is one machine; on a cluster an error, since executors would not see each other's files."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return there or f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt over all cores by key.  A file of one row group, however many rows it has, is read by one task, which
    would also do all that follows row by row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several parts of a plan read is made once, and a lost executor
    starts again from there.  Parts that ask for one value of the columns ``by`` read its files only.  The files go when
    the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
