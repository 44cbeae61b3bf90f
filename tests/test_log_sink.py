"""The state log's commit protocol, and the API as a stream: nothing lost, nothing doubled, whatever is interrupted."""

from __future__ import annotations

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from permitflow.operators import state
from permitflow.sources import log_sink, permits, tables

COLS = "key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string"


def lines(spark, keys, stage="licensed"):
    return spark.createDataFrame([(k, "a", k, None, [k], None, stage) for k in keys], COLS)


def test_runs_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "log")
    log_sink.publish(lines(spark, ["1", "2"], "pending").repartition(3), path)
    log_sink.publish(lines(spark, ["2"]), path)
    log_sink.publish(lines(spark, []), path)  # no lines, no run
    log, bad = tables.read_state(spark, path)
    assert bad == 0 and sorted(os.listdir(path)) == ["_staging", "run=1", "run=2"] and os.listdir(f"{path}/_staging") == []
    assert {r["key"]: (r["stage"], r["run"]) for r in state.fold(log).select("key", "stage", "run").collect()} == {"1": ("pending", 1), "2": ("licensed", 2)}
    assert tables.next_run(log) == 3


def test_follows_a_log_of_before(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "old.jsonl").write_text('{"key":"1","source":"a","stage":"pending","run":7}\n{"key":"9","source":"a","stage":"pending"}\n')
    log, _ = tables.read_state(spark, str(path))
    log_sink.publish(lines(spark, ["1"]), str(path), tables.next_run(log) - 1)
    log, _ = tables.read_state(spark, str(path))
    assert (path / "run=8").is_dir() and state.fold(log).filter("key = '1'").first()["stage"] == "licensed" and log.count() == 3


def test_a_killed_run_leaves_no_line(spark, tmp_path):
    path = str(tmp_path / "log")
    log_sink.publish(lines(spark, ["1"]), path)

    @F.udf("string")
    def broken(key):
        if key == "5":
            raise RuntimeError("killed")
        return key

    with pytest.raises(Exception, match="killed"):
        log_sink.publish(lines(spark, list("23456789")).repartition(4).withColumn("key", broken("key")), path)
    # Tasks that were done when the process died leave staged files behind.
    writer = log_sink.StateLogWriter(path, 0)
    os.makedirs(writer.staging)
    with open(f"{writer.staging}/part-00000-0.json", "w") as f:
        f.write('{"key":"lost"}\n')
    log, bad = tables.read_state(spark, path)
    assert [r["key"] for r in log.collect()] == ["1"] and bad == 0
    log_sink.publish(lines(spark, ["2"]), path)
    assert {r["key"] for r in tables.read_state(spark, path)[0].collect()} == {"1", "2"}


def test_writers_at_once_take_different_ordinals(spark, tmp_path):
    path = str(tmp_path / "log")
    os.makedirs(path)
    writers = [log_sink.StateLogWriter(path, 0) for _ in range(8)]
    gate = threading.Barrier(8)

    def go(i):
        w = writers[i]
        os.makedirs(w.staging)
        with open(f"{w.staging}/f.json", "w") as f:
            f.write(json.dumps({"key": str(i), "source": "a", "stage": "licensed"}) + "\n")
        gate.wait()
        w.commit([log_sink.Staged("f.json"), log_sink.Staged(None), None])

    threads = [threading.Thread(target=go, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log, _ = tables.read_state(spark, path)
    assert {r["key"] for r in log.collect()} == {str(i) for i in range(8)}
    assert sorted(r["run"] for r in log.select("run").collect()) == list(range(1, 9))


def test_an_overtaken_attempt_does_not_count(tmp_path):
    w = log_sink.StateLogWriter(str(tmp_path), 4)
    os.makedirs(w.staging)
    for name in ("part-0-1.json", "part-0-2.json"):
        with open(f"{w.staging}/{name}", "w") as f:
            f.write("{}\n")
    w.commit([log_sink.Staged("part-0-2.json")])
    assert os.listdir(tmp_path / "run=5") == ["part-0-2.json"]
    w.abort([])


def test_stores_without_one_step_renames_are_refused():
    assert log_sink.local_path("file:///a/b") == log_sink.local_path("file:/a/b") == "/a/b"
    with pytest.raises(ValueError):
        log_sink.local_path("s3://bucket/log")


@pytest.fixture()
def growing():
    """An API whose list grows: (url, rows, with a total or not)."""
    rows, about = [], {"count": True}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            size = asked["pageSize"]
            part = rows[(asked["page"] - 1) * size : asked["page"] * size]
            pages = {"totalPages": max(1, -(-len(rows) // size))} | ({"totalCount": len(rows)} if about["count"] else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"result": [{"requestId": r} for r in part], "pagination": pages}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", rows, about
    server.shutdown()


@pytest.mark.parametrize("count", [True, False])
def test_an_interrupted_pull_goes_on(spark, tmp_path, growing, count):
    url, rows, about = growing
    about["count"] = count
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    fail = {"now": False}

    def write(batch, i):
        batch.select("requestId").write.mode("overwrite").parquet(f"{out}/batch={i}")
        if fail["now"]:
            raise RuntimeError("interrupted")

    def pull():
        q = permits.stream_api(spark, url, 4, delay=0, page_size=4).writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    rows += range(10)  # two pages and a half
    pull()
    rows += range(10, 13)
    fail["now"] = True
    with pytest.raises(Exception, match="interrupted"):
        pull()
    fail["now"] = False
    rows += range(13, 17)
    pull()
    pull()
    assert sorted(r["requestId"] for r in spark.read.parquet(out).collect()) == list(range(17))
