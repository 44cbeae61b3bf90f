from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from permitflow.operators import projection, state
from permitflow.plans import daily, stats
from permitflow.sources import api, permits, sinks, tables
from permitflow.streaming import incremental


def pdf_row(number, action="כריתה", n="2", species="אורן", house="5", street="ציון", note="", request="כריתה", appeal="31/12/2026", day="1/9/2026"):
    return [action, n, species, "", "", house, street, "חיפה", note, "r", "app", request, appeal, day, number]


@pytest.fixture()
def pages(tmp_path):
    p = tmp_path / "pages.json"
    p.write_text(json.dumps([
        {"page": 1, "n_rows": 3, "table": [permits.HEADER, pdf_row("7"), pdf_row("7", n="1", species="ברוש"), ["short"]]}, {"page": 2, "n_rows": 0, "table": None},
        {"page": 3, "n_rows": 4, "table": [permits.HEADER, pdf_row("8", action="העתקה", note="לא ניתן לערר כלל"), pdf_row("9", action="", request="שימור", house="", street="מוריה 12א"), pdf_row("", n="x"), pdf_row("10", action="שתילת כריתה", n="?")]},
    ]), encoding="utf-8")
    return str(p)


def test_pdf(spark, pages):
    rows = permits.decode_pages(permits.read_pages(spark, pages), visual=False)
    m = {r["source_id"]: r for r in daily.requests(rows).collect()}
    assert set(m) == {"7", "8", "9", "10"}
    assert m["7"].fell_count == 3 and [(s["name"], s["n"]) for s in m["7"].species] == [("אורן", 2), ("ברוש", 1)]
    assert m["8"].relocate_count == 2 and not m["8"].can_appeal and m["8"].species is None
    assert m["9"].preserve_count == 2 and (m["9"].street, m["9"].house) == ("מוריה", "12א")
    assert m["10"].fell_count == 1 and m["10"].published == dt.date(2026, 9, 1)


def test_pdf_header_is_checked(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text(json.dumps([{"page": 1, "n_rows": 1, "table": [permits.HEADER[::-1]]}]), encoding="utf-8")
    with pytest.raises(permits.UnexpectedHeader):
        permits.decode_pages(permits.read_pages(spark, str(p)), visual=False)


def api_row(request, licence=None, fell=1, keep=0, name="אלון", **kw):
    d = {"requestId": request, "licenseId": licence, "licenseStatusDesc": kw.get("status", "בתוקף"), "approvedDate": "2026-08-01T00:00:00", "appealLastDate": kw.get("appeal"), "treeName": name, "unproot": fell, "copying": 0, "conservation": keep}
    return d | {"expandRows": kw.get("rows", [{"street": "שדרות מוריה 1", "homeNumber": "", "customerName": "c", "block": "10", "parcel": "1-2", "requestReason": "q"}])}


def test_cells_are_not_made_again_for_each_use(spark):
    """Where a query makes the cells from columns, one is made where it is used and in the comparison with the header, which
    only repeats of the header reach; and a row goes through Python once."""
    day = F.date_format(F.timestamp_seconds("id"), "d/M/yyyy")
    own = [F.lit(c) for c in pdf_row("")[:12]] + [day, F.lit(""), F.concat(F.lit("n"), F.col("id").cast("string"))]
    rows = spark.range(3).select(F.lit(2).alias("page"), F.col("id").cast("int").alias("row"), F.array(*own).alias("cells"))
    head = spark.createDataFrame([(1, 0, permits.HEADER)], "page int, row int, cells array<string>")
    d = permits.decode_pages(head.unionByName(rows), visual=False)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") <= 2 and plan.count("ArrowEvalPython") == 2  # one for each side of the union
    assert sorted((r.source_id, r.appeal_last) for r in d.collect()) == [(f"n{i}", dt.date(1970, 1, 1)) for i in range(3)]


def test_odd_rows(spark):
    """Nulls, short rows, repeats of the header, and cells that composition or cleaning changes."""
    schema = "page int, row int, cells array<string>"
    wide = pdf_row("\u3000\uff17", n="\u00a02", species="\ufb4b\u2003x", house="\uff15", street=" ב\u05bc\u05b0  1 ", note=None)
    rows = [
        (1, 0, None), (1, 1, ["short"]), (1, 2, permits.HEADER), (2, 0, permits.HEADER), (2, 1, [None, *permits.HEADER[1:]]), (2, 2, wide), (2, 3, pdf_row(None)), (2, 4, pdf_row("\u00a0\x1c")),
        (2, 5, pdf_row("8", house=" ", street="22 1א\u2028")), (2, 6, pdf_row("9", house="\t", street="1 2 צפון", action="\n", request=" \x1f")), (2, 7, [*pdf_row("10", house="5\n", street=""), "more"]),
    ]
    m = {r.source_id: r for r in permits.decode_pages(spark.createDataFrame(rows, schema), visual=False).collect()}
    assert set(m) == {"7", "8", "9", "10", permits.HEADER[14]}  # a row with a null is no repeat of the header
    assert (m["7"].house, m["7"].street, m["7"].species, m["7"].can_appeal) == ("5", "ב\u05b0\u05bc 1", "ו\u05b9 x", True)
    assert (m["8"].street, m["8"].house) == ("", "22 1א") and (m["9"].street, m["9"].house) == ("1 2 צפון", "")
    assert (m["9"].fell_count, m["9"].relocate_count, m["9"].preserve_count) == (0, 0, 0) and (m["10"].street, m["10"].house) == ("", "5")
    assert permits.decode_pages(spark.createDataFrame(rows[:2], schema), visual=False).collect() == []
    with pytest.raises(permits.UnexpectedHeader):  # the first full row decides, whatever its number is
        permits.decode_pages(spark.createDataFrame([(None, 5, [*permits.HEADER[:14], None]), *rows], schema), visual=False)


def test_visual_order_is_turned(spark):
    from permitflow.functions.bidi import turned

    shown = [turned(c) for c in permits.HEADER]
    cells = [turned(c) for c in pdf_row("7", street="ציון 22", house="")]
    d = permits.decode_pages(spark.createDataFrame([(1, 0, shown), (1, 1, cells), (2, 0, shown)], "page int, row int, cells array<string>"))
    assert [(r.source_id, r.street, r.house, r.fell_count, r.species) for r in d.collect()] == [("7", "ציון", "22", 2, "אורן")]


@pytest.fixture()
def captured(tmp_path):
    p = tmp_path / "api.json"
    p.write_text(json.dumps([api_row(1, 1234567, 2, 4), api_row(1, 1234567, 1, name="none"), api_row(2), api_row(None), api_row(3, 5, 0, 1, rows=[]), api_row(4, 6, status="לא ניתן לערעור", appeal="2020-01-01")]), encoding="utf-8")
    return str(p)


def test_api(spark, captured, tmp_path):
    rows = permits.decode_api(permits.read_api(spark, captured))
    m = {r["source_id"]: r for r in daily.requests(rows).collect()}
    assert set(m) == {"1", "2", "3", "4"}
    assert (m["1"].fell_count, m["1"].preserve_count, m["1"].stage, m["1"].licence_id) == (3, 4, "licensed", "1234567")
    assert [(s["name"], s["n"]) for s in m["1"].species] == [("אלון", 2)]
    assert m["2"].stage == "pending" and not m["2"].can_appeal and m["3"].street == "" and not m["4"].can_appeal
    env = tmp_path / "env.json"
    env.write_text(json.dumps([{"result": json.loads(open(captured, encoding="utf-8").read()), "pagination": {"totalPages": 1}}]), encoding="utf-8")
    assert permits.decode_api(permits.read_api(spark, str(env))).count() == rows.count()


def lookups(spark):
    streets = spark.createDataFrame([("מוריה", 0, 99999, "M", 2, 0)], "street_key string, house_from int, house_to int, neighborhood string, priority int, ord int")
    return daily.Lookups(streets, spark.createDataFrame([], "pattern string, neighborhood string, ord int"), spark.createDataFrame([], "block string, parcel string, neighborhood string, priority int, support double, ord int"))


def sources(spark, pages, captured):
    return {
        state.PDF: lambda: permits.decode_pages(permits.read_pages(spark, pages), visual=False),
        state.API: lambda: permits.decode_api(permits.read_api(spark, captured)),
    }


def flat_order(rows):
    """One type of ``ord`` for both sources."""
    a, b = rows.schema["ord"].dataType.names
    return rows.withColumn("ord", F.struct(F.col(f"ord.{a}").cast("long").alias("f"), F.col(f"ord.{b}").alias("i")))


def collected(spark, pages, captured, day="2026-09-02"):
    return daily.collect({k: lambda f=f: flat_order(f()) for k, f in sources(spark, pages, captured).items()}, day)


def no_log(spark):
    return spark.createDataFrame([], tables.STATE + ", line_no struct<run:bigint>")


def test_daily_run_sends_then_persists(spark, pages, captured, tmp_path):
    got = collected(spark, pages, captured)
    assert not got.errors and [(c[0], c[1], c[3], c[4], c[5]) for c in got.counters] == [("haifa_pdf", False, 5, 4, 4), ("yeela", False, 5, 4, 1)]
    path = str(tmp_path / "state")
    sent = []
    post = lambda t: (sent.append(t), (200, {"ok": True}))[1]
    n = daily.run(got, no_log(spark), lookups(spark), "2026-09-02", post, path, footer="the end", unmatched_path=str(tmp_path / "unmatched"))
    assert n == len(sent) == 3 and sent[2] == "the end"  # the digest, the late ones, the footer
    assert "1234567" in sent[1] and "•" in sent[0]
    assert sent[0].count("•") == 5  # the late one is in the digest too
    log, bad = tables.read_state(spark, path)
    assert bad == 0 and {r["key"] for r in log.collect()} == {"haifa_pdf:7", "haifa_pdf:8", "haifa_pdf:9", "haifa_pdf:10", "yeela:1"}
    assert tables.read_unmatched(spark, str(tmp_path / "unmatched")).first()["street"] == "ציון"
    assert daily.run(got, log, lookups(spark), "2026-09-03", post, path) == 0
    told = []
    with pytest.raises(sinks.NotDelivered):
        daily.run(got, no_log(spark), lookups(spark), "2026-09-02", lambda t: (500, {}), str(tmp_path / "other"), notify=told.append)
    assert not (tmp_path / "other").exists() and len(told) == 1
    s = stats.dataset(permits.decode_pages(permits.read_pages(spark, pages), visual=False), None, lookups(spark))
    assert s.count() == 4 and {r["date_kind"] for r in s.collect()} == {"requested"}


def test_one_failed_source_loses_nothing_of_the_other(spark, pages, captured, tmp_path):
    def broken():
        raise OSError("down")

    read = {state.PDF: broken, state.API: lambda: flat_order(sources(spark, pages, captured)[state.API]())}
    got = daily.collect(read, "2026-09-02")
    assert got.errors == ["haifa_pdf: down"] and {r["key"] for r in got.found.collect()} == {"yeela:1"}
    told = []
    assert daily.run(got, no_log(spark), lookups(spark), "2026-09-02", lambda t: (200, {"ok": True}), str(tmp_path / "s"), notify=told.append) == 2
    assert len(told) == 1 and "down" in told[0]
    nothing = daily.collect({state.PDF: broken}, "2026-09-02")
    with pytest.raises(RuntimeError, match="down"):
        daily.run(nothing, no_log(spark), lookups(spark), "2026-09-02", lambda t: (200, {"ok": True}), str(tmp_path / "t"), notify=told.append)
    with pytest.raises(ValueError, match="absent"):
        daily.open_requests(None, None, "2026-09-02")


def test_pending_then_licensed(spark, pages, captured, tmp_path):
    """A request under review is reported once if asked for, and again as an update when it has its licence."""
    path, sent = str(tmp_path / "state"), []
    post = lambda t: (sent.append(t), (200, {"ok": True}))[1]
    got = collected(spark, pages, captured)
    daily.run(got, no_log(spark), lookups(spark), "2026-09-02", post, path)
    assert not any("וטרם אושרו" in t for t in sent)
    assert daily.run(got, tables.read_state(spark, path)[0], lookups(spark), "2026-09-02", post, path, report_pending=True) == 1
    assert "וטרם אושרו" in sent[-1]
    assert daily.run(got, tables.read_state(spark, path)[0], lookups(spark), "2026-09-02", post, path, report_pending=True) == 0
    granted = tmp_path / "later.json"
    granted.write_text(json.dumps([api_row(2, 77)]), encoding="utf-8")
    later = daily.collect({state.API: lambda: flat_order(permits.decode_api(permits.read_api(spark, str(granted))))}, "2026-09-03")
    assert daily.run(later, tables.read_state(spark, path)[0], lookups(spark), "2026-09-03", post, path, report_pending=True) == 1
    assert "קיבלו רישיון" in sent[-1]
    assert daily.run(later, tables.read_state(spark, path)[0], lookups(spark), "2026-09-03", post, path) == 0


@pytest.mark.parametrize("swap", [False, True])
def test_later_run_wins_whatever_the_files_are_called(spark, tmp_path, swap):
    import os

    path = tmp_path / "state"
    cols = "key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string"
    for run, stage in ((1, "pending"), (2, "licensed")):
        before = set(path.glob("part-*")) if path.exists() else set()
        sinks.append_state(spark.createDataFrame([("a:1", "a", "1", None, [], None, stage)], cols).coalesce(1), str(path), run)
        new = next(iter(set(path.glob("part-*")) - before))
        os.rename(new, path / f"part-{'ab'[run - 1] if not swap else 'ba'[run - 1]}.json")
    for f in path.glob(".*.crc"):
        f.unlink()
    log, bad = tables.read_state(spark, str(path))
    assert bad == 0 and state.fold(log).first()["stage"] == "licensed" and tables.next_run(log) == 3


def test_bad_dates_in_state_lines(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"key":"a:1","source":"a","first_seen":"soon","stage":"pending","content":{"street":"x","published":"2026-01-02","appeal_last":"?"}}\n', encoding="utf-8")
    r = tables.read_state(spark, str(p))[0].first()
    assert r.first_seen is None and r.content.street == "x" and r.content.published == dt.date(2026, 1, 2) and r.content.appeal_last is None


def test_composition_and_aliases_at_reading(spark, tmp_path):
    p = tmp_path / "streets.csv"
    p.write_text("street_key,street_display,house_from,house_to,neighborhood,priority,method,support\nשׁד,x,,,A,2,m,1\nb,x,0,9,R,1,m,1\n", encoding="utf-8")
    a = tmp_path / "aliases.csv"
    a.write_text("alias,canonical\n# note\nA,B\nB,C\nR,\n", encoding="utf-8")
    got = tables.read_streets(spark, str(p), tables.read_aliases(spark, str(a))).collect()
    assert [(r.street_key, r.house_from, r.house_to, r.neighborhood) for r in got] == [("שׁד", 0, 99999, "C")]
    assert tables.read_csv(spark, str(p), tables.STREETS, None).count() == 2


def command(argv):
    from permitflow.__main__ import main

    return main(argv)


def test_commands(spark, pages, captured, tmp_path, capsys, monkeypatch):
    w = lambda name, text: ((tmp_path / name).write_text(text, encoding="utf-8"), str(tmp_path / name))[1]
    dims = ["--streets", w("s.csv", "street_key,street_display,house_from,house_to,neighborhood,priority,method,support\nציון,x,0,99999,Z,2,m,1\n"), "--blocks", w("b.csv", "block,parcel,neighborhood,priority,method,support\n10,,X,2,m,0.9\n"), "--landmarks", w("l.csv", "pattern,neighborhood,display_name\n")]
    ids = w("ids.txt", "1234567\n4321\nNone\n")
    st = str(tmp_path / "state")
    run = ["run", "--today", "2026-09-02", "--api", captured, *dims, "--state", st, "--old-ids", ids]
    monkeypatch.setenv("TELEGRAM_TOKEN", "t")
    monkeypatch.setenv("CHAT_ID", "c")
    assert command(run) == 1  # not migrated yet
    assert command(["migrate", "--state", st, "--old-ids", ids]) == 0 and command(["migrate", "--state", st, "--old-ids", ids]) == 0
    assert "2 record(s)" in (out := capsys.readouterr().out) and "0 record(s)" in out
    assert command([*run, "--dry-run"]) == 0 and "0 message(s)" in capsys.readouterr().out  # its one licence was sent before
    assert command(["stats", "--today", "2026-09-02", "--api", captured, *dims, "--out", str(tmp_path / "data")]) == 0
    head = spark.read.json(str(tmp_path / "data" / "header")).first()
    assert head["generated"] == "2026-09-02" and head["counts"]["records"] == 4
    assert command(["api-report", "--api", captured, "--year", "2026"]) == 0
    text = capsys.readouterr().out
    assert "by status" in text and "2  1  2" in text.split("== pending")[1]
    area = {"type": "Feature", "properties": {"name": "A", "block": "7", "parcel": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[200000, 740000], [200100, 740000], [200100, 740100], [200000, 740100]]]}}
    areas = w("a.geojson", json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2039"}}, "features": [area]}))
    points = w("p.csv", "street,house,x,y\nציון,3,200010,740010\nציון,5,200020,740010\n")
    assert command(["street-index", "--points", points, "--areas", areas, "--out", str(tmp_path / "si"), "--report", str(tmp_path / "si.txt")]) == 0
    made = tables.read_csv(spark, str(tmp_path / "si"), tables.STREETS).first()
    assert (made.street_key, made.neighborhood, made.method) == ("ציון", "A", "points_range") and "street keys" in (tmp_path / "si.txt").read_text()
    assert command(["block-index", "--parcels", areas, "--areas", areas, "--out", str(tmp_path / "bi"), "--report", str(tmp_path / "bi.txt")]) == 0
    assert {(r.block, r.parcel) for r in tables.read_csv(spark, str(tmp_path / "bi"), tables.BLOCKS).collect()} == {("7", "1"), ("7", None)}
    # The same layer without a system is refused, unless the command names one; one in degrees is brought to the points' grid.
    bare = w("bare.geojson", json.dumps({"type": "FeatureCollection", "features": [area]}))
    with pytest.raises(ValueError, match="no coordinate system"):
        command(["block-index", "--parcels", bare, "--areas", areas, "--out", str(tmp_path / "b0")])
    corners = spark.createDataFrame([(float(x), float(y)) for x, y in area["geometry"]["coordinates"][0]], "x double, y double").coalesce(1)
    area["geometry"]["coordinates"] = [[list(r) for r in projection.reproject_points(corners, "EPSG:2039", "EPSG:4326").collect()]]
    degrees = w("deg.geojson", json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": [area]}))
    assert command(["block-index", "--parcels", bare, "--parcels-crs", "EPSG:2039", "--areas", degrees, "--out", str(tmp_path / "b1")]) == 0
    assert {(r.block, r.parcel, r.neighborhood) for r in tables.read_csv(spark, str(tmp_path / "b1"), tables.BLOCKS).collect()} == {("7", "1", "A"), ("7", None, "A")}
    assert command(["street-index", "--points", points, "--areas", degrees, "--out", str(tmp_path / "s1")]) == 0
    assert tables.read_csv(spark, str(tmp_path / "s1"), tables.STREETS).first().neighborhood == "A"
    with pytest.raises(ValueError, match="no shapes"):
        tables.layer(tables.read_geojson(spark, w("e.geojson", '{"features":[]}'), "name:string"))


def test_point_collection(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, None)], "x double, y double, n string").repartition(2)
    sinks.write_geojson(df, str(tmp_path / "g"), "x", "y")
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part-*"))
    got = json.loads(text)
    assert got["type"] == "FeatureCollection" and {tuple(f["geometry"]["coordinates"]) for f in got["features"]} == {(1.0, 2.0), (3.0, 4.0)}


def test_state_log_skips_corrupt_lines(spark, tmp_path):
    p = tmp_path / "state.jsonl"
    p.write_text('{"key":"a:1","source":"a","stage":"pending"}\nnot json\n\n{"key":"a:1","source":"a","stage":"licensed","legacy_ids":["3"]}\n', encoding="utf-8")
    log, bad = tables.read_state(spark, str(p))
    assert bad == 1
    got = state.fold(log).collect()
    assert [(r["key"], r["stage"], r["legacy_ids"]) for r in got] == [("a:1", "licensed", ["3"])]


def test_csv_comments_quotes_and_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿alias,canonical\n  # note\n"a ""b""",c\nd,\n', encoding="utf-8")
    got = tables.read_csv(spark, str(p), "alias string, canonical string").collect()
    assert [(r.alias, r.canonical) for r in got] == [('a "b"', "c"), ("d", None)]


def test_small_helpers(tmp_path):
    assert tables.guess_column(["Name", "X"], ["name"]) == "Name"
    with pytest.raises(KeyError):
        tables.guess_column(["a"], ["b"])
    assert tables.sniff_encoding("שלום\n".encode("cp1255")) == "cp1255" and tables.sniff_encoding(b"a\n") == "utf-8-sig"
    assert tables.flag("Yes") and not tables.flag("no")
    with pytest.raises(RuntimeError):
        tables.load_settings({})
    assert tables.load_settings({"TELEGRAM_TOKEN": "t", "CHAT_ID": "c"}).operator_chat == "c"
    assert sinks.inline_json([{"a": "</b>"}], "x MARK y", "MARK") == 'x [{"a":"<\\/b>"}] y'
    assert not sinks.notify_operator("x", lambda t: (500, {}))


def test_retry():
    answers = [(503, b""), OSError("down"), (200, b"ok")]
    waits = []

    def send():
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert api.request(send, sleep=waits.append) == b"ok" and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError, match="404"):
        api.request(lambda: (404, b""), sleep=waits.append)
    with pytest.raises(RuntimeError, match="429 after 3"):
        api.request(lambda: (429, b""), sleep=waits.append)


def test_paged_api(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            page = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["page"]
            body = json.dumps({"result": [{"requestId": page * 10 + i} for i in range(2)], "pagination": {"totalPages": 3}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(api.PagedApi)
    got = spark.read.format("paged_api").option("url", f"http://127.0.0.1:{server.server_port}/").option("delay", "0").load().collect()
    live = permits.fetch_api(spark, f"http://127.0.0.1:{server.server_port}/", 4, delay=0)
    sinks.write_capture(live, str(tmp_path / "raw"))
    server.shutdown()
    assert sorted(r["requestId"] for r in permits.read_api(spark, str(tmp_path / "raw")).collect()) == [10, 11, 20, 21, 30, 31]
    assert sorted(json.loads(r["value"])["requestId"] for r in got) == [10, 11, 20, 21, 30, 31]


def test_points_swap(spark):
    p = spark.createDataFrame([("740000", "200000"), ("740001", "200001"), ("0", "0"), ("x", "1")], "a string, b string")
    assert sorted((r.x, r.y) for r in tables.points(p, "a", "b").collect()) == [(200000.0, 740000.0), (200001.0, 740001.0)]


def test_stream_replay(spark, captured, tmp_path):
    rows = permits.decode_api(permits.read_api(spark, captured)).withColumn("ord", F.col("ord.i"))
    src = str(tmp_path / "src")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    out = str(tmp_path / "log")
    incremental.start(stream, out, str(tmp_path / "cp"), "2026-01-01").awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 4
    incremental.extend(rows, 0, out, "2026-01-01")  # the same batch again
    assert spark.read.parquet(out).count() == first
    incremental.extend(rows, 1, out, "2026-01-02")  # the same rows in a later batch
    assert spark.read.parquet(out).count() == first
