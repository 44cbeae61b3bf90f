"""Keyed streaming state against the batch form, over replays and restarts."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from permitflow.operators import state
from permitflow.streaming import incremental, keyed

LINE = "key string, source string, source_id string, licence_id string, stage string, ord struct<b: int, i: int>"


def made(rng, batch, n):
    """Line rows of one batch: API requests under review that are licensed later, repeated ones, and PDF requests, some of
    them known by an old id only."""
    out = []
    for i in range(n):
        r = rng.randrange(40)
        if rng.random() < 0.5:
            licensed = batch > 0 and r % 3 != 0 or r % 5 == 0
            out.append((f"{state.API}:{r}", state.API, str(r), f"90000{r // 2:02d}" if licensed else None, "licensed" if licensed else "pending", (batch, i)))
        else:
            out.append((f"{state.PDF}:{r}", state.PDF, str(r), None, "licensed", (batch, i)))
    return out


OLD = [(f"{state.PDF}:legacy:3", state.PDF, "3", None, ["3"], None, "licensed", 0), (f"{state.API}:legacy:9000004", state.API, "9000004", None, ["9000004"], None, "licensed", 0), (f"{state.API}:7", state.API, "7", None, [], dt.date(2025, 5, 5), "pending", 0)]
LOG = "key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string, line_no int"


def by_batches(spark, batches, days):
    """The log by the batch operators, one batch after the other."""
    log = spark.createDataFrame(OLD, LOG)
    for i, (rows, day) in enumerate(zip(batches, days, strict=True)):
        lines = spark.createDataFrame(rows, LINE)
        r = lines.groupBy("key").agg(F.first("source").alias("source"), F.first("source_id").alias("source_id"), F.min_by("licence_id", F.when(F.col("licence_id").isNotNull(), F.col("ord"))).alias("licence_id"), F.when(F.bool_or(F.col("stage") == "licensed"), "licensed").otherwise("pending").alias("stage"))
        r = r.withColumn("legacy_id", state.natural_legacy_id(F.col("source"), F.col("licence_id"), F.col("source_id")))
        now = state.fold(log).drop("line_no")
        new = state.classify(state.match(r, now)).filter("kind <> 'known'")
        out = state.log_lines(new.select("key", "source", "source_id", "licence_id", "legacy_id", "stage"), now, F.lit(day).cast("date"))
        log = spark.createDataFrame(log.collect() + [(*x, i + 1) for x in out.select("key", "source", "source_id", "licence_id", "legacy_ids", "first_seen", "stage").collect()], LOG)
    return sorted((tuple(x) for x in log.filter("line_no > 0").drop("line_no").collect()), key=str)


def test_same_log_as_the_batch_form(spark, tmp_path):
    """Batches come one by one, over restarts; the log of before and the batches that were read are gone meanwhile."""
    rng = random.Random(11)
    batches = [made(rng, b, 60) for b in range(4)]
    days = ["2026-01-01", "2026-01-01", "2026-01-02", "2026-01-02"]
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    old = spark.createDataFrame(OLD, LOG)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    got = []
    for day in ("2026-01-01", "2026-01-02"):
        for b in range(4):
            if days[b] == day:
                spark.createDataFrame(batches[b], LINE).coalesce(1).write.parquet(f"{src}/{b}")
        keyed.start(stream, out, cp, day, old).awaitTermination()
        got += map(tuple, spark.read.schema(keyed.LINES).parquet(out).drop("batch").collect())
        shutil.rmtree(out)  # state lines of before are not read again
    assert sorted(got, key=str) == by_batches(spark, batches, days)
    assert len({x[0] for x in got}) < len(got)  # some were logged twice: under review, then licensed


def test_a_failed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    rows = made(random.Random(2), 0, 30)
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(LINE).parquet(src)
    lines = keyed.changes(stream, "2026-01-01")

    def fail(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
        raise RuntimeError("lost after the write")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STORE)
    with pytest.raises(Exception, match="lost after the write"):
        lines.writeStream.foreachBatch(fail).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    keyed.start(stream, out, cp, "2026-01-01").awaitTermination()
    keys = [r["key"] for r in spark.read.parquet(out).collect()]
    assert sorted(keys) == sorted({r[0] for r in rows})
    keyed.start(stream, out, cp, "2026-01-01").awaitTermination()  # nothing new
    assert spark.read.parquet(out).count() == len(keys)


def test_first_step_and_foreach_batch_agree(spark, tmp_path):
    rows = [(*r[:5], r[5]) for r in made(random.Random(4), 1, 50)]
    df = spark.createDataFrame(rows, LINE)
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    keyed.start(spark.readStream.schema(LINE).parquet(src), str(tmp_path / "a"), str(tmp_path / "cp"), "2026-01-01").awaitTermination()
    assert incremental.LOG.startswith("key string")
    a = {r["key"]: (r["stage"], tuple(r["legacy_ids"])) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert set(a) == {r[0] for r in rows} and all(s == "licensed" or k.startswith(state.API) for k, (s, _) in a.items())
