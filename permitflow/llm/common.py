"""Shared helpers of the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality, near-duplicate and pipeline contracts: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# The ASCII alphabets, for lower-casing A-Z and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as Spark reads it; any store that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only in a session of one machine may the setting be absent; then a folder below the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_lineage").rstrip("/")


#: Rows of a batch that goes to a Python worker. Whole texts may be long, and a batch is held several times over.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From here on, batches of BATCH_ROWS at most go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that no later stage depends on a live executor. With ``by``,
    a column of few values, a folder for each: a filter on it reads nothing else.

    Parquet is compressed and columnar, unlike an RDD checkpoint. The files go when the JVM ends, or earlier through
    :func:`drop`. Adaptive execution lowers the number of files of small shuffled results.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/permitflow-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._permitflow_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a frame that :func:`cut` returned; its rows must not be read again."""
    path = getattr(df, "_permitflow_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII text takes the JVM's fast path; others are translated letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Bytes of a written table up to which it may be broadcast. Compressed columns grow some five times in memory.
BROADCAST_BYTES = 8 << 20


def sized(written: DataFrame) -> DataFrame:
    """A table that :func:`cut` returned, marked for broadcast if its files are within BROADCAST_BYTES. Beyond that it is
    left to a shuffled join, which Spark can split by skew."""
    size = int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(written) if size <= BROADCAST_BYTES else written
