"""The daily run: collect, classify, place, render, deliver, persist."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.operators import merge, render, reports, resolver, state
from permitflow.operators.lineage import cut
from permitflow.sources import log_sink, sinks, tables

log_ = logging.getLogger(__name__)

Post = Callable[[str], tuple[int, dict]]
COUNTERS = "source string, failed boolean, pages long, raw_rows long, requests long, passed long, fresh long"


@dataclass
class Lookups:
    """Dimension tables of the resolver."""

    streets: DataFrame
    landmarks: DataFrame
    blocks: DataFrame


@dataclass
class Collected:
    """What the sources gave: reportable requests, those under review, what went wrong, and a counter row per source."""

    found: DataFrame | None = None
    pending: DataFrame | None = None
    errors: list[str] = field(default_factory=list)
    counters: list[tuple] = field(default_factory=list)


def requests(lines: DataFrame) -> DataFrame:
    """Merged requests with their species."""
    m = merge.merge_requests(lines)
    species = merge.sum_by_name(lines, "key", "species", "fell_count", "ord")
    return m.join(species, "key", "left")


def _reportable(source: str, r: DataFrame, as_of: str) -> DataFrame:
    """The PDF's requests by date alone, the API's licensed ones with felling."""
    return merge.open_window(r, as_of, keep_undated=False) if source == state.PDF else merge.open_licences(r, as_of)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def open_requests(pdf: DataFrame | None, api: DataFrame | None, as_of: str) -> DataFrame:
    """Requests of either source that can be reported. A source that was skipped is None; one must be there."""
    parts = [_reportable(s, requests(lines), as_of) for s, lines in ((state.PDF, pdf), (state.API, api)) if lines is not None]
    if not parts:
        raise ValueError("both sources are absent")
    return _union(parts)


def collect(sources: dict[str, Callable[[], DataFrame]], as_of: str) -> Collected:
    """Reads each source by itself: one that fails is noted and loses nothing of the others. A source that is left out
    was skipped."""
    got = Collected()
    found, pending = [], []
    for name, read in sources.items():
        try:
            lines = cut(read())
            r = cut(requests(lines))
            own = _reportable(name, r, as_of)
            first = lines.schema["ord"].dataType.names[0]
            n = lines.agg(F.count_distinct(f"ord.{first}").alias("pages"), F.count(F.lit(1)).alias("rows")).first()
            got.counters.append((name, False, n["pages"], n["rows"], r.count(), own.count(), 0))
        except Exception as e:  # whatever it was, the operator hears of it
            log_.exception("source %s failed", name)
            got.errors.append(f"{name}: {e}")
            got.counters.append((name, True, 0, 0, 0, 0, 0))
            continue
        found.append(own)
        if name == state.API:
            pending.append(merge.pending(r))
    got.found, got.pending = _union(found), _union(pending)
    return got


def new_records(found: DataFrame, log: DataFrame) -> DataFrame:
    """Fresh records and updates; what is known goes before any placing is done."""
    legacy = state.natural_legacy_id(F.col("source"), F.col("licence_id"), F.col("source_id"))
    return state.classify(state.match(found.withColumn("legacy_id", legacy), state.fold(log))).filter("kind <> 'known'")


def new_pending(pending: DataFrame, log: DataFrame) -> DataFrame:
    """Requests under review that the log does not know."""
    return new_records(pending, log).filter("kind = 'fresh'").withColumn("kind", F.lit("pending"))


def place(records: DataFrame, look: Lookups) -> DataFrame:
    """Records with an area."""
    r = records.withColumn("rid", F.col("key")).withColumn("full_text", F.concat_ws(" ", "street", "house", "reason"))
    return resolver.resolve(r, look.streets, look.landmarks, look.blocks).drop("full_text")


def late(placed: DataFrame, today: str) -> DataFrame:
    """Fresh records that were published well before they were first seen. Updates are never late."""
    return placed.filter((F.col("kind") == "fresh") & F.coalesce(merge.back_dated(F.col("published"), F.lit(today).cast("date")), F.lit(False)))


def messages(placed: DataFrame, today: str, footer: str = "") -> list[tuple[str, DataFrame | None]]:
    """(text, records to persist once it is delivered) of each message that has any records, in order: the digest of all
    fresh ones, the updates, an alert that names the late ones again, those under review, and the footer after a digest
    or updates."""
    day = F.lit(today).cast("date")
    p = placed.withColumn("ord", F.col("key"))
    kinds = {k: p.filter(F.col("kind") == k) for k in ("fresh", "update", "pending")}
    plan = [(kinds["fresh"], render.main_message, True), (kinds["update"], render.update_message, True), (late(p, today), render.backdated_message, False), (kinds["pending"], render.pending_message, True)]
    out = [(build(rows, day).first()["text"], rows if kept else None) for rows, build, kept in plan if not rows.isEmpty()]
    if footer and not p.filter("kind in ('fresh', 'update')").isEmpty():
        out.append((footer, None))
    return out


def counted(spark: SparkSession, got: Collected, placed: DataFrame) -> DataFrame:
    """The funnel of this run: a counter row per source with its new records, and the first stage that came to nothing."""
    fresh = {r["source"]: r["n"] for r in placed.filter("kind = 'fresh'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    return reports.funnel(spark.createDataFrame([(*c[:-1], fresh.get(c[0], 0)) for c in got.counters], COUNTERS))


def tell(funnel: DataFrame) -> list[str]:
    """The funnel in words, a line per source and one for those that did not fail together."""
    out = []
    for r in funnel.orderBy("source").collect():  # a row per source
        stages = ", ".join(f"{s} {r[s]}" for s in reports.FUNNEL)
        out.append(f"{r['source']}: failed" if r["failed"] else f"{r['source']}: {stages}" + (f"; nothing left at {r['first_zero']}, fed by {r['fed_by']}" if r["first_zero"] else ""))
    t = reports.combined(funnel).first()
    return [*out, f"all {t['sources']} sources: " + ", ".join(f"{s} {t[s] or 0}" for s in reports.FUNNEL)]


def misses(placed: DataFrame, history: DataFrame, today: str) -> DataFrame:
    """Addresses that could not be placed, to be curated."""
    m = placed.filter(F.col("method") == "unknown").select("street", "house", T.address("street", "house").alias("full_text"))
    return state.unmatched(m, history, F.lit(today).cast("date"))


def run(
    got: Collected, log: DataFrame, look: Lookups, today: str, post: Post | None, state_path: str, footer: str = "",
    report_pending: bool = False, notify: Callable[[str], object] | None = None, unmatched_path: str | None = None,
) -> int:
    """Delivers each message, then persists its records; a failure leaves what was not delivered unrecorded, so the next
    run reports it again, and is raised after the operator was told. ``post`` None is a dry run: nothing is sent or
    written. Returns the number of messages."""
    tell_operator = notify if notify and post else (lambda _: None)
    if got.found is None:
        why = "no source gave anything:\n" + "\n".join(got.errors)
        tell_operator(why)
        raise RuntimeError(why)
    todo = new_records(got.found, log)
    if report_pending and got.pending is not None:
        todo = todo.unionByName(new_pending(got.pending, log))
    placed = cut(place(todo, look))
    for line in tell(counted(log.sparkSession, got, placed)) if got.counters else []:
        log_.info(line)
    outbound = messages(placed, today, footer)
    if post is None:
        print(sinks.show_messages([t for t, _ in outbound]))
        return len(outbound)
    if unmatched_path:
        sinks.append_unmatched(misses(placed, tables.read_unmatched(log.sparkSession, unmatched_path), today), unmatched_path)
    current, after = cut(state.fold(log)), tables.next_run(log) - 1
    for text, rows in outbound:
        try:
            sinks.deliver(text, post)
        except sinks.NotDelivered as e:
            tell_operator(f"not delivered: {e}")
            raise
        if rows is not None:
            content = F.struct("street", "house", "neighborhood", "fell_count", "published", "appeal_last").alias("content")
            lines = state.log_lines(rows.select("key", "source", "source_id", "licence_id", "legacy_id", "stage", content), current, F.lit(today).cast("date"))
            log_sink.publish(lines, state_path, after)
    if got.errors:
        tell_operator("the run is over, with data missing:\n" + "\n".join(got.errors))
    return len(outbound)
