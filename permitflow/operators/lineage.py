"""Cutting long plans at written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back: what follows neither recomputes it nor
    depends on a live executor. Only in a session of one machine may the setting be absent; then the warehouse folder
    serves. The files go when the JVM ends."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = named or spark.conf.get("spark.sql.warehouse.dir") + "/_lineage"
    path = f"{base.rstrip('/')}/permits-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Size of the files of a table that :func:`cut` returned."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
