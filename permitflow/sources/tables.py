"""Lookup tables, point layers, the state log and id lists."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.functions import arrow as A
from permitflow.functions import text as T
from permitflow.operators import index, projection, reports

STATE = (
    "run long, key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string, "
    "content struct<street:string,house:string,neighborhood:string,fell_count:long,published:date,appeal_last:date>"
)
STREETS = "street_key string, street_display string, house_from int, house_to int, neighborhood string, priority int, method string, support double"
BLOCKS = "block string, parcel string, neighborhood string, priority int, method string, support double"

#: Envelope of the national grid, for points whose axes may be swapped.
ENVELOPE_X, ENVELOPE_Y = (100_000, 300_000), (350_000, 850_000)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str | None = "UTF-8") -> DataFrame:
    """CSV with a header; a byte-order mark is ignored, quotes are doubled, and rows whose first column starts with # are
    comments. ``ord`` keeps the order of the lines of one file. ``encoding`` None: the first of the usual ones that decodes
    the file, which is a hand-kept table, read whole."""
    if encoding is None:
        encoding = sniff_encoding(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])).replace("utf-8-sig", "UTF-8")
    df = spark.read.schema(schema).csv(path, header=True, escape='"', encoding=encoding).withColumn("ord", F.monotonically_increasing_id())
    return df.filter(~F.ltrim(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))).startswith("#"))


def sniff_encoding(head: bytes, encodings: tuple[str, ...] = ("utf-8-sig", "cp1255", "utf-8")) -> str:
    """The first encoding that decodes the sample, cut back to a line's end."""
    head = head[: head.rfind(b"\n") + 1] or head
    for e in encodings:
        try:
            head.decode(e)
            return e
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {encodings} decodes the file")


def guess_column(columns: list[str], guesses: list[str], override: str | None = None) -> str:
    """The override, else the first guess that names a column exactly, else without regard to case; else an error."""
    if override:
        if override not in columns:
            raise KeyError(f"{override!r} is not among {columns}")
        return override
    lower = {c.lower(): c for c in reversed(columns)}
    for g in guesses:
        if g in columns:
            return g
    for g in guesses:
        if g.lower() in lower:
            return lower[g.lower()]
    raise KeyError(f"none of {guesses} is among {columns}")


def points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Numeric points without (0, 0); the axes are swapped if the medians fit the envelope only that way."""
    p = df.withColumns({"x": F.col(x).try_cast("double"), "y": F.col(y).try_cast("double")})
    p = p.filter("x is not null and y is not null and not isnan(x) and not isnan(y) and not (x = 0 and y = 0)")
    axes = p.select(F.explode(F.create_map(F.lit("x"), F.col("x"), F.lit("y"), F.col("y"))).alias("axis", "v"))
    m = {"x": None, "y": None} | {r["axis"]: r["median"] for r in reports.medians(axes, "axis", "v").collect()}  # two rows
    fits = lambda v, e: v is not None and e[0] <= v <= e[1]
    if not (fits(m["x"], ENVELOPE_X) and fits(m["y"], ENVELOPE_Y)) and fits(m["y"], ENVELOPE_X) and fits(m["x"], ENVELOPE_Y):
        p = p.withColumns({"x": F.col("y"), "y": F.col("x")})
    return p


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(kind, rings, properties) of polygons, and of lines as one ring. An empty layer or one that names another system
    than the caller's is an error for the caller to raise; the system's name is in ``crs``."""
    raw = spark.read.text(path, wholetext=True)
    feature = f"struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>"
    f = raw.select(F.from_json("value", f"struct<crs:string,features:array<{feature}>>").alias("f")).select("f.crs", F.explode("f.features").alias("g"))
    kind, c = F.col("g.geometry.type"), F.col("g.geometry.coordinates")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    flat = "array<array<double>>"
    rings = F.when(kind == "Polygon", F.from_json(c, f"array<{flat}>")).when(kind == "MultiPolygon", F.flatten(F.from_json(c, f"array<array<{flat}>>")))
    rings = rings.when(kind == "LineString", F.array(F.from_json(c, flat))).when(kind == "MultiLineString", F.from_json(c, f"array<{flat}>"))
    return f.select("crs", kind.alias("kind"), F.transform(rings, ring).alias("rings"), "g.properties.*").filter("rings is not null")


def layer(shapes: DataFrame, crs: str | None = None) -> tuple[DataFrame, str]:
    """A layer that :func:`read_geojson` gave, and the name of its coordinate system, once it was found to hold shapes, all
    of one system. ``crs`` names the system in place of what the layer says; a layer that says nothing needs it."""
    n = shapes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("crs", F.lit(""))).alias("crs"), F.max("crs").alias("name")).first()
    if not n["n"]:
        raise ValueError("the layer holds no shapes")
    if n["crs"] > 1:
        raise ValueError("the layer mixes coordinate systems")
    name = projection.name_of(crs or n["name"])
    if name is None:
        raise ValueError("the layer names no coordinate system; pass one, such as EPSG:2039")
    projection.system(name)
    return shapes, name


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(state lines with line_no, number of lines that could not be read). Lines are ordered by ``run``, the ordinal that
    each append carries or its folder is named by, since names of written files have no order; lines without it, from a log kept by hand or by the
    predecessor, come first, in the order of their file. A date that can't be read is null and costs nothing else."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).filter(F.trim("value") != "")
    raw = re.sub(r"\bdate\b", "string", STATE)
    parsed = lines.select(F.from_json("value", raw).alias("s"), "f", "b", "i")
    bad = parsed.filter("s is null or s.key is null").count()
    published = F.regexp_extract("f", "/run=([0-9]+)/", 1).try_cast("long")
    good = parsed.withColumn("s", F.col("s").withField("run", F.coalesce("s.run", published))).filter("s.key is not null").select("s.*", F.struct(F.coalesce("s.run", F.lit(0)).alias("run"), "f", "b", "i").alias("line_no"))
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    content = F.col("content").withField("published", day("content.published")).withField("appeal_last", day("content.appeal_last"))
    return good.withColumns({"first_seen": day("first_seen"), "content": content, "legacy_ids": F.coalesce("legacy_ids", F.array().cast("array<string>"))}), bad


def next_run(log: DataFrame) -> int:
    """The ordinal of the next append: one more than the largest in the log."""
    return (log.agg(F.max("run")).first()[0] or 0) + 1 if "run" in log.columns else 1


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line (column ``value``); blanks and a byte-order mark go."""
    return spark.read.text(path).select(F.trim(F.replace("value", F.lit("﻿"), F.lit(""))).alias("value")).filter("value <> ''")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of areas, each chain followed to its end; an empty name means that the area is no place."""
    a = A.compose(read_csv(spark, path, "alias string, canonical string"), "alias", "canonical")
    a = a.select(T.clean_text("alias").alias("alias"), T.clean_text("canonical").alias("canonical"), "ord").filter("alias <> ''")
    return index.canonical(a.groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical")))


def _named(rows: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Rows under the current names of their areas, without those of areas that are no place."""
    rows = rows if aliases is None else index.rename_areas(rows, aliases)
    return rows.filter("neighborhood <> ''")


def read_streets(spark: SparkSession, path: str, aliases: DataFrame | None = None) -> DataFrame:
    s = A.compose(read_csv(spark, path, STREETS), "street_key", "neighborhood")
    s = s.withColumns({"street_key": T.clean_text("street_key"), "neighborhood": T.clean_text("neighborhood"), "priority": F.coalesce("priority", F.lit(4))})
    return _named(s.withColumns({"house_from": F.coalesce("house_from", F.lit(0)), "house_to": F.coalesce("house_to", F.lit(99999))}).filter("street_key <> ''"), aliases)


def read_blocks(spark: SparkSession, path: str, aliases: DataFrame | None = None) -> DataFrame:
    b = A.compose(read_csv(spark, path, BLOCKS), "block", "parcel", "neighborhood")
    return _named(b.withColumns({"block": T.clean_text("block"), "parcel": T.clean_text("parcel"), "neighborhood": T.clean_text("neighborhood"), "support": F.coalesce("support", F.lit(0.0)), "priority": F.coalesce("priority", F.lit(2))}).filter("block <> ''"), aliases)


def read_landmarks(spark: SparkSession, path: str, aliases: DataFrame | None = None) -> DataFrame:
    m = A.compose(read_csv(spark, path, "pattern string, neighborhood string, display_name string"), "pattern", "neighborhood")
    return _named(m.withColumns({"pattern": T.clean_text("pattern"), "neighborhood": T.clean_text("neighborhood")}).filter("pattern <> ''"), aliases)


def read_unmatched(spark: SparkSession, path: str) -> DataFrame:
    """(street, house) already on file; none if there is no file yet."""
    schema = "first_seen date, street string, house string, full_text string"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "street string, house string")
    return read_csv(spark, path, schema).select("street", F.coalesce("house", F.lit("")).alias("house"))


def flag(value: str | None, default: bool = False) -> bool:
    """Whether a setting says yes."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Delivery settings from the environment; ``missing`` names the required ones that are absent."""

    token: str = ""
    chat: str = ""
    operator_chat: str = ""
    report_pending: bool = False
    log_level: str = "INFO"
    missing: tuple[str, ...] = field(default=(), compare=False)


def load_settings(env: dict[str, str] | None = None, require: bool = True) -> Settings:
    e = os.environ if env is None else env
    get = lambda k: (e.get(k) or "").strip()
    missing = tuple(k for k in ("TELEGRAM_TOKEN", "CHAT_ID") if not get(k))
    if require and missing:
        raise RuntimeError(f"missing settings: {', '.join(missing)}")
    return Settings(get("TELEGRAM_TOKEN"), get("CHAT_ID"), get("OPERATOR_CHAT_ID") or get("CHAT_ID"), flag(e.get("REPORT_PENDING")), get("LOG_LEVEL") or "INFO", missing)
