"""Line rows as a stream: each micro-batch is matched with the state log and extends it.

The reference form is a batch job; this is the same operators under ``foreachBatch``. A batch's state lines go to a
folder named by the batch id and are overwritten on replay, so a batch that runs twice is recorded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from permitflow.operators import state
from permitflow.plans.daily import requests

LOG = "key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string, batch long"


def _log(df: DataFrame, path: str, before: int) -> DataFrame:
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path).filter(F.col("batch") < before)


def extend(batch: DataFrame, batch_id: int, path: str, today: str) -> None:
    """Records new or changed in this batch, as state lines of this batch."""
    log = state.fold(_log(batch, path, batch_id), order="batch").drop("batch")
    r = requests(batch)
    r = r.withColumn("legacy_id", state.natural_legacy_id(F.col("source"), F.col("licence_id"), F.col("source_id")))
    new = state.classify(state.match(r, log)).filter("kind <> 'known'")
    lines = state.log_lines(new.select("key", "source", "source_id", "licence_id", "legacy_id", "stage"), log, F.lit(today).cast("date"))
    out = lines.select("key", "source", "source_id", "licence_id", "legacy_ids", "first_seen", "stage")
    out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start(lines: DataFrame, path: str, checkpoint: str, today: str) -> StreamingQuery:
    """Runs over what is there and stops."""
    return lines.writeStream.foreachBatch(lambda b, i: extend(b, i, path, today)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
