"""The two permit sources as line rows of one licence shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.functions.arrow import compose, fix_bidi, reading_order
from permitflow.operators.state import API, PDF
from permitflow.sources.api import DELAY, MAX_PAGES, PAGE_SIZE, PagedApi

PAGES = "array<struct<page:int,n_rows:int,table:array<array<string>>>>"
API_ROW = (
    "requestId long, licenseId long, licenseStatusDesc string, approvedDate string, appealLastDate string, treeName string, unproot int, copying int, conservation int, "
    "expandRows array<struct<street:string,homeNumber:string,customerName:string,block:string,parcel:string,requestReason:string>>"
)

# The table's header in reading order, action wordings in order of precedence, and the wording that bars appeal.
HEADER = ["הערות לעצים", "מספר עצים", "שם עץ", "סוג עץ", "הערות לבקשה", "בית", "רח", "מקום הבקשה", "סיבה2", "סיבה", "שם", "פעולה", "תאריך אחרון לערעור", "תאריך בקשה", "מספר בקשה"]
ACTIONS = {"כריתה": "fell", "הכריתה": "fell", "כרתה": "fell", "כריתב": "fell", "כריתה .": "fell", "העתקה": "relocate", "שימור": "preserve", "שמירה": "preserve", "נדחה": "other"}
NO_APPEAL_PDF, NO_APPEAL_API = "לא ניתן לערר", "לא ניתן"

# Positions of the cells that are used.
_CELL = {"tree_action": 0, "count": 1, "species": 2, "house": 5, "street": 6, "note": 8, "reason": 9, "applicant": 10, "request_action": 11, "appeal": 12, "requested": 13, "number": 14}
_TEXTS = ["tree_action", "species", "street", "note", "reason", "applicant", "request_action"]


class UnexpectedHeader(RuntimeError):
    """The table is not the shape that is decoded."""


def classify_action(df: DataFrame, tree_cell: str, request_cell: str) -> DataFrame:
    """``df`` with ``action``. The first of two clean cells that isn't blank decides: by its whole text, else by the first
    known word within, else "other"."""
    words = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    c, within = F.col("action"), None
    for word, name in ACTIONS.items():
        within = F.when(c.contains(word), name) if within is None else within.when(c.contains(word), name)
    # The text in a column first: a chain of conditions over the expression itself would repeat it for each word.
    d = df.withColumn("action", F.when(F.col(tree_cell) != "", F.col(tree_cell)).otherwise(F.nullif(F.col(request_cell), F.lit(""))))
    return d.withColumn("action", F.coalesce(words[c], within, F.lit("other")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, row, cells) of a captured table file; pages without a table have no rows."""
    pages = spark.read.schema("page int, n_rows int, table array<array<string>>").json(path, multiLine=True)
    return pages.select("page", F.posexplode("table").alias("row", "cells"))


def check_header(cells: list[str]) -> None:
    """Raises unless the cells, in reading order, are the expected header."""
    wrong = [(i, h, c) for i, (h, c) in enumerate(zip(HEADER, cells, strict=False)) if h != c]
    if len(cells) != len(HEADER) or wrong:
        raise UnexpectedHeader(f"{len(cells)} columns; first differences: {wrong[:8]}")


def _cell(name: str) -> Column:
    return F.coalesce(F.get("cells", F.lit(_CELL[name])), F.lit(""))


def _first_full_row(rows: DataFrame) -> list[str] | None:
    """Cells of the first row of (page, row, cells) that is as wide as the header, or None. Its place is looked for in the
    numbers alone: cells may be costly to make, and are made for this row only."""
    full = rows.filter(F.get("cells", F.lit(_CELL["number"])).isNotNull() | (F.size("cells") >= len(HEADER)))
    at = full.agg(F.min(F.struct("page", "row")).alias("at")).first()["at"]
    if at is None:
        return None
    found = full.filter(F.col("page").eqNullSafe(at["page"]) & F.col("row").eqNullSafe(at["row"])).select("cells").first()
    return [c or "" for c in found["cells"]]


def decode_pages(rows: DataFrame, visual: bool = True) -> DataFrame:
    """Line rows of (page, row, cells). The first full row must be the header; repeats of it, short rows and rows without
    a request number are left out. ``visual``: cells are in visual order.

    Cells are taken out of a row's array one by one, never through a changed copy of it: where a query makes the array
    from columns, Spark then needs no array, and makes no cell that isn't used."""
    first, r = _first_full_row(rows), rows
    if first:
        raw = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(first)], "i int, raw string")
        read = raw.select("i", T.clean_text(fix_bidi("raw") if visual else "raw").alias("c"))
        check_header([x["c"] for x in sorted(read.collect())])
        # Whole rows are compared only where the number cell is the header's.
        r = r.filter((_cell("number") != F.lit(first[_CELL["number"]])) | (F.col("cells") != F.array(*map(F.lit, first))))
    d = r.filter(~T.is_blank(_cell("number"))).select("page", "row", *(_cell(n).alias(n) for n in _CELL))  # a short row has no number
    d = compose(reading_order(d, *_TEXTS) if visual else d, "house", "number", *_TEXTS)
    # Each value is made once, in a projection before those that use it several times.
    d = d.withColumns({n: T.clean_column(n) for n in ("house", "number", *_TEXTS)} | {"trees": T.pdf_count("count")})
    d = classify_action(d, "tree_action", "request_action").withColumn("tail", F.when(F.col("house") == "", T.house_tail(F.col("street"))).otherwise(""))
    action, n = F.col("action"), F.col("trees")
    tail, house = F.col("tail"), F.col("house")
    return d.select(
        T.state_key(F.lit(PDF), "number").alias("key"), F.struct("page", "row").alias("ord"), F.lit(PDF).alias("source"), F.col("number").alias("source_id"), F.lit("licensed").alias("stage"),
        F.lit(None).cast("string").alias("licence_id"), T.without_tail(F.col("street"), tail).alias("street"), F.when(house == "", F.trim(tail)).otherwise(house).alias("house"),
        *(F.when(action == a, n).otherwise(0).cast("long").alias(f"{a}_count") for a in ("fell", "relocate", "preserve")),
        F.when((action == "fell") & (F.col("species") != ""), F.col("species")).alias("species"), T.pdf_date("appeal").alias("appeal_last"), T.pdf_date("requested").alias("published"),
        (~F.col("note").contains(NO_APPEAL_PDF)).alias("can_appeal"), "applicant", F.lit("").alias("block"), F.lit("").alias("parcel"), "reason",
    )


def decode_api(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Line rows of API rows. Only the first of ``expandRows`` is used; a row without a request id is left out. A request
    with a licence id is licensed."""
    first = lambda f: T.clean_text(f"x_{f}")
    names = ["street", "homeNumber", "customerName", "block", "parcel", "requestReason"]
    r = rows.filter("requestId is not null").withColumns({f"x_{f}": F.get("expandRows", F.lit(0))[f] for f in names})
    r = compose(r, "treeName", *(f"x_{f}" for f in names))
    licence = F.nullif(T.clean_text("licenseId"), F.lit(""))
    source_id = F.col("requestId").cast("string")
    street, house = first("street"), first("homeNumber")
    name = T.clean_text("treeName")
    fell = T.api_count("unproot")
    return r.select(
        T.state_key(F.lit(API), source_id).alias("key"), order, F.lit(API).alias("source"), source_id.alias("source_id"), F.when(licence.isNotNull(), "licensed").otherwise("pending").alias("stage"),
        licence.alias("licence_id"), street.alias("street"), house.alias("house"),
        fell.cast("long").alias("fell_count"), T.api_count("copying").cast("long").alias("relocate_count"), T.api_count("conservation").cast("long").alias("preserve_count"),
        F.when((fell > 0) & ~F.lower(name).isin("", "none"), name).alias("species"), T.api_date("appealLastDate").alias("appeal_last"), T.api_date("approvedDate").alias("published"),
        (licence.isNotNull() & ~F.coalesce(F.col("licenseStatusDesc"), F.lit("")).contains(NO_APPEAL_API)).alias("can_appeal"),
        first("customerName").alias("applicant"), first("block").alias("block"), first("parcel").alias("parcel"), first("requestReason").alias("reason"),
    )


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a captured API file: a flat list, or envelopes with ``result``. ``ord`` is the place in the file."""
    both = spark.read.schema(f"result array<struct<{API_ROW.replace(' long', ':long').replace(' string', ':string').replace(' int', ':int').replace('expandRows array', 'expandRows:array')}>>, {API_ROW}").json(path, multiLine=True)
    both = both.withColumn("file_ord", F.monotonically_increasing_id())
    names = [c for c in both.columns if c not in ("result", "file_ord")]
    flat = both.filter("result is null").select(*names, F.struct("file_ord", F.lit(0).alias("i")).alias("ord"))
    env = both.filter("result is not null").select("file_ord", F.posexplode("result").alias("i", "r")).select("r.*", F.struct("file_ord", "i").alias("ord"))
    return flat.unionByName(env)


def fetch_api(spark: SparkSession, url: str, city: int, delay: float = DELAY, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """Rows of the live paged API, a task per page, in the shape of :func:`read_api`."""
    spark.dataSource.register(PagedApi)
    raw = spark.read.format("paged_api").options(url=url, city=city, delay=delay, pageSize=page_size, maxPages=max_pages).load()
    return _api_rows(raw)


def stream_api(spark: SparkSession, url: str, city: int, delay: float = DELAY, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """The same as a stream, which goes on from the last row that a checkpoint saw."""
    spark.dataSource.register(PagedApi)
    return _api_rows(spark.readStream.format("paged_api").options(url=url, city=city, delay=delay, pageSize=page_size, maxPages=max_pages).load())


def _api_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.from_json("value", API_ROW).alias("r"), F.struct("page", "i").alias("ord")).select("r.*", "ord")
