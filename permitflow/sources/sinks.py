"""Where results go: state lines, index files, reports, statistics, messages."""

from __future__ import annotations

import html
import json
import logging
from collections.abc import Callable
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.operators.render import LIMIT, split_message

log = logging.getLogger(__name__)


class NotDelivered(RuntimeError):
    """A chunk was not accepted; ``sent`` chunks before it were."""

    def __init__(self, why: str, sent: int, total: int) -> None:
        super().__init__(f"{why} (sent {sent} of {total})")
        self.sent, self.total = sent, total


def append_state(lines: DataFrame, path: str, run: int) -> None:
    """One JSON line per record, nulls left in. ``run`` orders appends: of two lines of a key, the later run's holds."""
    lines.withColumn("run", F.lit(run).cast("long")).write.mode("append").option("ignoreNullFields", "false").json(path)


def append_unmatched(rows: DataFrame, path: str) -> None:
    """Adds addresses to be curated to the CSV files at ``path``; no file if there are none."""
    rows = rows.coalesce(1)
    if not rows.isEmpty():
        rows.write.mode("append").csv(path, header=True, escape='"')


def write_index(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file in ``order``, behind a byte-order mark for spreadsheets; an index is a lookup table of bounded size."""
    marked = rows.orderBy(*order).coalesce(1)
    marked.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    """Records as JSON lines, Unicode as it is."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def inline_json(records: list[dict], page: str, marker: str) -> str:
    """``page`` with the records in place of ``marker``, safe inside a script element."""
    return page.replace(marker, json.dumps(records, ensure_ascii=False, separators=(",", ":"), default=str).replace("</", "<\\/"))


def _framed(lines: DataFrame, first: str, last: str, path: str) -> None:
    """One text file: ``first``, the lines (column ``value``) with commas between them, ``last``."""
    numbered = lines.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("i"), "value")
    low = numbered.agg(F.min("i")).first()[0]
    body = numbered.withColumn("value", F.when(F.col("i") == F.lit(low), F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    frame = lines.sparkSession.createDataFrame([(0, 0, first), (2, 0, last)], "part int, i long, value string")
    body.unionByName(frame).coalesce(1).sortWithinPartitions("part", "i").select("value").write.mode("overwrite").text(path)


def write_geojson(points: DataFrame, path: str, x: str, y: str) -> None:
    """One feature collection of points with the other columns as properties, in one file, as readers of the format ask."""
    rest = [c for c in points.columns if c not in (x, y)]
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    _framed(points.select(F.to_json(f).alias("value")), '{"type":"FeatureCollection","features":[', "]}", path)


def write_capture(rows: DataFrame, path: str) -> None:
    """Raw rows as one JSON list, as :func:`permitflow.sources.permits.read_api` reads it; nulls are left in."""
    cols = [c for c in rows.columns if c != "ord"]
    _framed(rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")), "[", "]", path)


def write_dataset(records: DataFrame, path: str, generated: str) -> None:
    """The statistics dataset: ``path``/records as JSON lines, and ``path``/header with the day and the counts by source."""
    from permitflow.operators.reports import dataset_counts

    write_json(records, f"{path}/records")
    counts = dataset_counts(records)
    head = counts.agg(F.sum("records").alias("records"), F.sum("undated").alias("undated"), F.sum("felled").alias("fell_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "records")))).alias("by_source"))
    write_json(head.select(F.lit(generated).alias("generated"), F.struct("records", "undated", "by_source", "fell_total").alias("counts")), f"{path}/header")


def qa_report(sections: list[tuple[str, DataFrame, int]]) -> str:
    """Text of ranked sections, each with its own limit; a report's cap is part of its format."""
    out = []
    for title, rows, most in sections:
        out.append(f"== {title} ==")
        out += ["  ".join(str(v) for v in r) for r in rows.limit(most).collect()]
    return "\n".join(out) + "\n"


def deliver(text: str, post: Callable[[str], tuple[int, dict]], limit: int = LIMIT) -> int:
    """Posts a message in chunks; each must come back with status 200 and ``ok``. Returns their number."""
    parts = split_message(text, limit)
    for i, part in enumerate(parts):
        try:
            status, body = post(part)
        except OSError as e:
            raise NotDelivered(str(e), i, len(parts)) from e
        if status != 200 or not body.get("ok"):
            raise NotDelivered(f"HTTP {status}: {body.get('description', 'not ok')}", i, len(parts))
    return len(parts)


def notify_operator(text: str, post: Callable[[str], tuple[int, dict]]) -> bool:
    """Tells the operator; escaped, and never an exception."""
    try:
        deliver(html.escape(text), post)
        return True
    except Exception as e:
        log.warning("operator not told: %s", e)
        return False


def show_messages(texts: list[str], limit: int = LIMIT) -> str:
    """A dry run's output: each message with its length and number of chunks."""
    return "\n".join(f"--- {len(t)} characters, {len(split_message(t, limit))} chunk(s)\n{t}" for t in texts)


def backup(spark: SparkSession, path: str, to: str, stamp: str, keep: int = 30) -> bool:
    """Copies the state folder to ``to``/``stamp``, checks its size, and keeps the newest ``keep`` copies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    src, dst = P(path), P(f"{to}/{stamp}")
    fs = src.getFileSystem(conf)
    out = dst.getFileSystem(conf)
    out.mkdirs(P(to))
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, out, dst, False, conf)
    same = fs.getContentSummary(src).getLength() == out.getContentSummary(dst).getLength()
    names = sorted(s.getPath().getName() for s in out.listStatus(P(to)))
    for old in names[:-keep]:
        out.delete(P(f"{to}/{old}"), True)
    return same


def setup_log(path: str, level: str = "INFO") -> logging.Handler:
    """A rotating file: 2 MB, seven old ones."""
    h = RotatingFileHandler(path, maxBytes=2_000_000, backupCount=7, encoding="utf-8")
    h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("permitflow")
    root.setLevel(level)
    root.addHandler(h)
    return h
