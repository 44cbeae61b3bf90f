"""Command line.

python -m permitflow run --today 2026-01-31 [--pdf pages.json] [--api rows.json | --api-url URL --city N] --streets streets.csv
    --blocks blocks.csv --landmarks landmarks.csv [--aliases aliases.csv] --state state/ [--old-ids ids.txt]
    [--unmatched unmatched/] [--footer-table URL] [--dry-run]
python -m permitflow migrate --state state/ --old-ids ids.txt
python -m permitflow stats --today 2026-01-31 [--pdf ...] [--api ...] --streets ... --blocks ... --landmarks ... --out dataset/
python -m permitflow capture --api-url URL --city N --out rows/
python -m permitflow api-report --api rows.json --year 2026
python -m permitflow street-index --points points.csv --areas areas.geojson --out index/ [--lines lines.geojson] [--legacy old.csv]
    [--aliases aliases.csv] [--report report.txt]
python -m permitflow block-index --parcels parcels.geojson --areas areas.geojson --out index/ [--report report.txt]
python -m permitflow diag-unmatched --points points.csv --areas areas.geojson --out misses/
python -m permitflow diag-api (--api rows.json | --api-url URL --city N)
python -m permitflow diag-pages --pdf pages.json

``run`` also takes --backups, a folder for copies of the state, and --log, a rotating file; the index commands take the
coordinate systems of their layers (--points-crs, --areas-crs, --lines-crs, --parcels-crs) and --cell for an even grid.
"""

from __future__ import annotations

import argparse
import datetime
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.operators import index, projection, render, reports, spatial, state
from permitflow.operators.cells import Cells, Grid
from permitflow.operators.lineage import cut
from permitflow.plans import daily, diagnose, lookup_build, stats
from permitflow.sources import api, log_sink, permits, sinks, tables

log = logging.getLogger("permitflow")


def _poster(settings: tables.Settings, chat: str) -> daily.Post:
    import json

    url = f"https://api.telegram.org/bot{settings.token}/sendMessage"

    def post(text: str) -> tuple[int, dict]:
        return 200, json.loads(api.http_post(url, {"chat_id": chat, "text": text, "parse_mode": "HTML", "disable_web_page_preview": True}))

    return post


def _notifier(settings: tables.Settings) -> Callable[[str], object]:
    """Tells the operator; never in the public channel, so without a chat of the operator's own it only logs."""
    if not settings.token or settings.operator_chat in ("", settings.chat):
        return lambda text: log.error("no chat of the operator's own; not told: %s", text)
    post = _poster(settings, settings.operator_chat)
    return lambda text: sinks.notify_operator(text, post)


def _exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _sources(spark: SparkSession, o: argparse.Namespace) -> dict[str, Callable[[], DataFrame]]:
    """Readers of the sources that were named; the others are skipped. Nothing is read yet."""
    out: dict[str, Callable[[], DataFrame]] = {}
    if o.pdf:
        out[state.PDF] = lambda: permits.decode_pages(permits.read_pages(spark, o.pdf))
    if o.api:
        out[state.API] = lambda: permits.decode_api(permits.read_api(spark, o.api))
    elif getattr(o, "api_url", None):
        out[state.API] = lambda: permits.decode_api(permits.fetch_api(spark, o.api_url, o.city, page_size=o.page_size, max_pages=o.max_pages))
    return out


def _lookups(spark: SparkSession, o: argparse.Namespace) -> daily.Lookups:
    aliases = tables.read_aliases(spark, o.aliases) if o.aliases else None
    return daily.Lookups(tables.read_streets(spark, o.streets, aliases), tables.read_landmarks(spark, o.landmarks, aliases), tables.read_blocks(spark, o.blocks, aliases))


def _state(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], tables.STATE + ", line_no struct<run:bigint>")
    lines, bad = tables.read_state(spark, path)
    if bad:
        log.warning("%d state lines could not be read", bad)
    return lines


def _backup(spark: SparkSession, o: argparse.Namespace) -> None:
    """A copy of the state before the run; a failure is told in the log and stops nothing."""
    if not o.backups or not _exists(spark, o.state):
        return
    try:
        stamp = datetime.datetime.now().strftime("%Y-%m-%d_%H%M%S")
        if not sinks.backup(spark, o.state, o.backups, stamp):
            raise RuntimeError("the copy differs in size")
        log.info("state backed up: %s", stamp)
    except Exception as e:  # a missed copy can be made up for, a missed run can't
        log.error("no backup of the state: %s", e)


def run(spark: SparkSession, o: argparse.Namespace) -> int:
    if o.log:
        sinks.setup_log(o.log)
    _backup(spark, o)
    settings = tables.load_settings(require=not o.dry_run)
    notify = (lambda _: None) if o.dry_run else _notifier(settings)
    if not _exists(spark, o.state) and _exists(spark, o.old_ids):
        # An empty log beside the predecessor's ids would make everything ever sent look new.
        why = f"{o.state} does not exist but {o.old_ids} does; migrate first"
        notify(why)
        if not o.dry_run:
            log.error(why)
            return 1
        log.warning("%s; the dry run goes on, with everything looking new", why)
    lines = _state(spark, o.state)
    got = daily.collect(_sources(spark, o), o.today)
    footer = render.FOOTER.format(table=o.footer_table) if o.footer_table else ""
    try:
        n = daily.run(got, lines, _lookups(spark, o), o.today, None if o.dry_run else _poster(settings, settings.chat), o.state, footer, settings.report_pending, notify, o.unmatched)
    except (sinks.NotDelivered, RuntimeError) as e:
        log.error("%s", e)
        return 1
    print(f"{n} message(s)")
    return 0


def migrate(spark: SparkSession, o: argparse.Namespace) -> int:
    lines = _state(spark, o.state)
    new = cut(state.migrate(tables.read_ids(spark, o.old_ids), state.fold(lines)))
    if not new.isEmpty():
        log_sink.publish(new, o.state, tables.next_run(lines) - 1)
    print(f"{new.count()} record(s) added")
    return 0


def make_stats(spark: SparkSession, o: argparse.Namespace) -> int:
    read = _sources(spark, o)
    if not read:
        raise SystemExit("no source was named")
    rows = {name: f() for name, f in read.items()}
    sinks.write_dataset(cut(stats.dataset(rows.get(state.PDF), rows.get(state.API), _lookups(spark, o))), o.out, o.today)
    return 0


def capture(spark: SparkSession, o: argparse.Namespace) -> int:
    sinks.write_capture(permits.fetch_api(spark, o.api_url, o.city, page_size=o.page_size, max_pages=o.max_pages), o.out)
    return 0


def api_report(spark: SparkSession, o: argparse.Namespace) -> int:
    rows = cut(permits.read_api(spark, o.api))
    issued = rows.filter("licenseId is not null")
    year = issued.filter(F.col("approvedDate").startswith(str(o.year)))
    if year.isEmpty():
        raise SystemExit(f"no licences approved in {o.year}")
    measures = ["unproot", "copying", "conservation"]
    by_year = reports.period_rollup(issued.filter("approvedDate <> ''"), F.substring("approvedDate", 1, 4), ["unproot"]).select("period", "unproot").orderBy("period")
    sections = [
        (f"approved licences of {o.year}", reports.period_rollup(year, F.substring("approvedDate", 1, 4), measures, "licenseId"), 1),
        ("felling by month", reports.period_rollup(year, F.substring("approvedDate", 6, 2), ["unproot"]).select("period", "unproot").orderBy("period"), 12),
        ("top species felled", reports.top_sums(year.withColumn("name", F.coalesce(F.nullif("treeName", F.lit("")), F.lit("unknown"))).filter("unproot > 0"), "name", "unproot", 15), 15),
        ("by status", reports.statuses(year, "licenseStatusDesc"), 100),
        ("felling by year", by_year, 100),
        ("pending: rows, requests, trees", reports.pending_summary(rows, "licenseId", "requestId", "unproot"), 1),
    ]
    print(sinks.qa_report(sections))
    return 0


def _areas(spark: SparkSession, path: str, name: str, crs: str | None, target: str) -> DataFrame:
    """Areas of a layer in the system of the layer that they are joined with."""
    a, own = tables.layer(tables.read_geojson(spark, path, f"`{name}`:string"), crs)
    a = projection.reproject_rings(a.filter("kind in ('Polygon', 'MultiPolygon')"), own, target)
    return a.select(T.clean_text(name).alias("neighborhood"), "rings")


def _cells(o: argparse.Namespace) -> Cells | None:
    """An even grid if its size is named, else cells are learned."""
    return Grid(o.cell, o.cell) if o.cell else None


def _points(spark: SparkSession, path: str) -> DataFrame:
    """Address points: id, x, y, street, house."""
    head = spark.read.csv(path, header=True).columns
    pick = lambda guesses: tables.guess_column(head, guesses)
    raw = tables.read_csv(spark, path, ", ".join(f"`{c}` string" for c in head), None)
    p = tables.points(raw, pick(["x", "X", "lon"]), pick(["y", "Y", "lat"]))
    return p.select(F.col("ord").alias("id"), "x", "y", F.col(pick(["street", "street_name"])).alias("street"), F.col(pick(["house", "house_no"])).alias("house"))


def diag_unmatched(spark: SparkSession, o: argparse.Namespace) -> int:
    points, areas = cut(_points(spark, o.points)), cut(_areas(spark, o.areas, o.area_field, o.areas_crs, o.points_crs))
    misses = diagnose.outside(points, areas, _cells(o))
    print(sinks.qa_report(diagnose.unmatched(points, areas, misses)))
    if not misses.isEmpty():
        sinks.write_geojson(misses.select("x", "y", "street", "house", "distance"), o.out, "x", "y")
    return 0


def diag_api(spark: SparkSession, o: argparse.Namespace) -> int:
    if not o.api and not o.api_url:
        raise SystemExit("name a captured file or the API")
    rows = permits.read_api(spark, o.api) if o.api else permits.fetch_api(spark, o.api_url, o.city, page_size=o.page_size, max_pages=o.max_pages)
    print(sinks.qa_report(diagnose.api_profile(cut(rows))))
    return 0


def diag_pages(spark: SparkSession, o: argparse.Namespace) -> int:
    pages = cut(permits.read_pages(spark, o.pdf))
    print(sinks.qa_report(diagnose.page_scan(pages)))
    return 0


def street_index(spark: SparkSession, o: argparse.Namespace) -> int:
    areas = _areas(spark, o.areas, o.area_field, o.areas_crs, o.points_crs)
    p = _points(spark, o.points)
    lines = legacy = aliases = None
    if o.lines:
        g, own = tables.layer(tables.read_geojson(spark, o.lines, "street:string"), o.lines_crs)
        g = projection.reproject_rings(g, own, o.points_crs)
        # An area's boundary runs along streets like a line does.
        closed = F.when(F.col("kind").endswith("Polygon"), F.transform("rings", lambda r: F.when(r[0] != F.element_at(r, -1), F.concat(r, F.slice(r, 1, 1))).otherwise(r))).otherwise(F.col("rings"))
        lines = g.withColumn("rings", closed).select("street", F.explode("rings").alias("points"))
    if o.legacy:
        legacy = tables.read_csv(spark, o.legacy, "street string, neighborhood string", None)
    if o.aliases:
        aliases = tables.read_aliases(spark, o.aliases)
    rows = cut(lookup_build.street_index(p, areas, lines, legacy, aliases, _cells(o)))
    sinks.write_index(rows.drop("ord"), o.out, ["street_key", "priority", "house_from"])
    if o.report:
        count = lambda x: x.agg(F.count(F.lit(1)).alias("n"))
        text = sinks.qa_report([
            ("rows", count(rows), 1), ("street keys", count(rows.select("street_key").distinct()), 1), ("areas", count(rows.select("neighborhood").distinct()), 1), ("by method", reports.statuses(rows, "method"), 100),
            ("streets in more than one area", reports.crossing(rows).orderBy("street_key"), 400), ("centrelines, weakest first", reports.weakest(rows.filter("priority = 3").select("street_key", "neighborhood", "support"), "support", 0.6, 200, "street_key"), 200),
            *([("in the old table only", index.missing_tier(legacy.select(T.normalize_street("street").alias("street_key")).filter("street_key <> ''").distinct(), rows).orderBy("street_key"), 200)] if legacy is not None else []),
        ])
        with open(o.report, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


def block_index(spark: SparkSession, o: argparse.Namespace) -> int:
    g, own = tables.layer(tables.read_geojson(spark, o.parcels, "block:string,parcel:string"), o.parcels_crs)
    areas = _areas(spark, o.areas, o.area_field, o.areas_crs, own)
    parcels = cut(g.select("block", "parcel", "rings").withColumn("id", F.xxhash64("block", "parcel", "rings")))
    shared = spatial.overlay(parcels.select("id", "rings"), areas, "id", "neighborhood", _cells(o))
    rows = cut(index.block_index(shared.join(parcels.select("id", "block", "parcel").distinct(), "id")))
    sinks.write_index(rows, o.out, ["block", "priority", "parcel"])
    if o.report:
        weak = reports.weakest(rows.filter("priority = 2").select("block", "neighborhood", "support"), "support", 0.8, 200, "block")
        with open(o.report, "w", encoding="utf-8") as f:
            f.write(sinks.qa_report([("rows", rows.agg(F.count(F.lit(1))), 1), ("blocks in more than one area", reports.crossing(rows.filter("priority = 1"), "block").orderBy("block"), 400), ("blocks, weakest first", weak, 200)]))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="what", required=True)

    def command(name: str, do: Callable, needed: str, optional: str = "") -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in needed.split():
            c.add_argument(f"--{x}", required=True)
        for x in optional.split():
            c.add_argument(f"--{x}")
        c.set_defaults(do=do)
        return c

    r = command("run", run, "today streets blocks landmarks state", "pdf api api-url aliases old-ids unmatched footer-table backups log")
    r.add_argument("--dry-run", action="store_true")
    command("migrate", migrate, "state old-ids")
    command("stats", make_stats, "today streets blocks landmarks out", "pdf api aliases")
    command("diag-pages", diag_pages, "pdf")
    for c in (r, command("capture", capture, "api-url out"), command("diag-api", diag_api, "", "api api-url")):
        c.add_argument("--city", type=int, default=0)
        c.add_argument("--page-size", type=int, default=api.PAGE_SIZE)
        c.add_argument("--max-pages", type=int, default=api.MAX_PAGES)
    command("api-report", api_report, "api").add_argument("--year", type=int, required=True)
    for name, do, needed, optional in (("street-index", street_index, "points areas out", "lines legacy aliases report areas-crs lines-crs"), ("block-index", block_index, "parcels areas out", "report areas-crs parcels-crs"), ("diag-unmatched", diag_unmatched, "points areas out", "areas-crs")):
        c = command(name, do, needed, optional)
        c.add_argument("--area-field", default="name")
        c.add_argument("--cell", type=float)
        if name != "block-index":
            c.add_argument("--points-crs", default="EPSG:2039")
    return top


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("permitflow").getOrCreate()
    return o.do(spark, o)


if __name__ == "__main__":
    raise SystemExit(main())
