"""The diagnostic commands, the run's backup and log, and running totals over a large key."""

from __future__ import annotations

import json
import statistics

import pytest
from pyspark.sql import functions as F

from permitflow.__main__ import main
from permitflow.operators import reports
from permitflow.operators.running import running, spread
from permitflow.sources import permits, tables


@pytest.fixture()
def command(spark):
    return main  # takes the session that is there


def feature(name, x, y, n):
    ring = [[x, y], [x + n, y], [x + n, y + n], [x, y + n]]
    return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_unmatched_points(command, tmp_path, capsys):
    areas = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:2039"}}, "features": [feature("A", 200_000, 740_000, 100), feature("B", 200_100, 740_000, 100)]}
    (tmp_path / "a.geojson").write_text(json.dumps(areas))
    rows = [("in", 200_010), ("near", 200_210), ("near", 200_220), ("mid", 200_280), ("far", 202_000), ("gone", 290_000)]
    (tmp_path / "p.csv").write_text("street,house,x,y\n" + "".join(f"{s},{i},{x},740050\n" for i, (s, x) in enumerate(rows)))
    assert command(["diag-unmatched", "--points", str(tmp_path / "p.csv"), "--areas", str(tmp_path / "a.geojson"), "--out", str(tmp_path / "out")]) == 0
    text = capsys.readouterr().out
    assert "== points ==\n6\n" in text and "== in no area ==\n5\n" in text
    assert all(x in text for x in ("0 to 25  2", "25 to 100  1", "500 to 2000  1", "10000 to 1e+09  1", "near  2  15.0", "200010.0  740050.0  290000.0  740050.0", "200000.0  740000.0  200200.0  740100.0"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert {(f["properties"]["street"], f["properties"].get("distance")) for f in got["features"]} == {("near", 10.0), ("near", 20.0), ("mid", 80.0), ("far", 1800.0), ("gone", None)}


def test_api_and_pages(command, tmp_path, capsys):
    nested = {"street": "s", "homeNumber": "", "customerName": "c", "block": "1", "parcel": "2", "requestReason": "q"}
    rows = [{"requestId": i, "licenseId": None, "treeName": "oak", "expandRows": [nested] * i} for i in range(3)] + [{"requestId": 9}]
    (tmp_path / "api.json").write_text(json.dumps(rows))
    assert command(["diag-api", "--api", str(tmp_path / "api.json")]) == 0
    text = capsys.readouterr().out
    assert "requestId  4  4" in text and "treeName  3  1  ['oak']" in text and "licenseId" not in text.split("== fields of nested")[0]
    assert "\n0  2\n1  1\n2  1\n" in text and '"requestId":2' in text.split("== the row with most")[1]
    with pytest.raises(SystemExit):
        command(["diag-api"])
    pages = [{"page": 1, "n_rows": 0, "table": None}, {"page": 2, "n_rows": 2, "table": [["התירכ", " "], ["12 a", "שימור"]]}, {"page": 3, "n_rows": 1, "table": [["כריתה", "x", "הקתעה"]]}]
    (tmp_path / "pages.json").write_text(json.dumps(pages))
    assert command(["diag-pages", "--pdf", str(tmp_path / "pages.json")]) == 0
    text = capsys.readouterr().out
    assert "2  3  3" in text and "1  0  12 a  a 21  N*2 S*1 L*1" in text and "כריתה" in text.split("== first rows")[1]
    assert "00  כריתה  2" in text and "01  שימור  1" in text and "02  העתקה  1" in text


def test_backup_and_log_of_a_run(command, spark, tmp_path):
    (tmp_path / "api.json").write_text("[]")
    for name, schema in (("s", tables.STREETS), ("b", tables.BLOCKS)):
        (tmp_path / f"{name}.csv").write_text(",".join(c.split()[0] for c in schema.split(", ")) + "\n")
    (tmp_path / "l.csv").write_text("pattern,neighborhood,display_name\n")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "old.jsonl").write_text('{"key":"a:1","source":"a","stage":"pending"}\n')
    (tmp_path / "pages.json").write_text(json.dumps([{"page": 1, "n_rows": 1, "table": [permits.HEADER]}]))
    dims = [x for k, v in (("streets", "s"), ("blocks", "b"), ("landmarks", "l")) for x in (f"--{k}", str(tmp_path / f"{v}.csv"))]
    args = ["run", "--today", "2026-09-02", "--api", str(tmp_path / "api.json"), *dims, "--state", str(tmp_path / "state"), "--dry-run"]
    assert command([*args, "--backups", str(tmp_path / "copies"), "--log", str(tmp_path / "run.log")]) == 0
    kept = list((tmp_path / "copies").iterdir())
    assert len(kept) == 1 and (kept[0] / "old.jsonl").read_text() == (tmp_path / "state" / "old.jsonl").read_text() and "state backed up" in (tmp_path / "run.log").read_text()
    # A folder that can't be made costs the copy, not the run.
    (tmp_path / "file").write_text("x")
    assert command([*args, "--backups", str(tmp_path / "file" / "below"), "--log", str(tmp_path / "run.log")]) == 0
    assert "no backup of the state" in (tmp_path / "run.log").read_text()


def test_medians_of_a_key_in_many_partitions(spark):
    rows = [("hot", float(i * 7919 % 2003)) for i in range(2000)] + [("hot", 5.0)] * 300 + [(None, 1.0), (None, 4.0), ("one", 3.0), ("x", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["n"], r["median"]) for r in reports.medians(df, "k", "v").collect()}
    assert got == {"hot": (2300, statistics.median(v for k, v in rows if k == "hot")), None: (2, 2.5), "one": (1, 3.0)}
    s = spread(df.filter("k is not null and v is not null"), ["k"], ["v"])
    out = running(s, "k", {"n": F.lit(1)}).filter("k = 'hot'")
    assert sorted(r["n"] for r in out.select("n").collect()) == list(range(1, 2301)) and out.select("_part").distinct().count() >= 1


def test_exact_median_decides_the_axes(spark):
    """Swapped axes are told by the exact median, whatever the spread of a few points."""
    p = spark.createDataFrame([("740000", "200000")] * 3 + [("9", "9")] * 2, "x string, y string")
    assert {(r["x"], r["y"]) for r in tables.points(p, "x", "y").collect()} == {(200000.0, 740000.0), (9.0, 9.0)}
