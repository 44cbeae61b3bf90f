"""Registered queries: the operators on the driver's tables, which stand in for permit records, and the same in SQL.

``lineitem`` plays the line rows of requests (``orders``), ``part`` the streets, ``events`` the state log, ``customer``
with ``nation`` the placed records. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.functions import similarity as sim
from permitflow.functions import text as T
from permitflow.functions.arrow import compose
from permitflow.operators import index, merge, ranges, render, reports, resolver, spatial, state
from permitflow.operators.lineage import cut

AS_OF = "1998-06-01"
KEYWORDS = ["the", "und", "que", "les"]
LANDMARKS = ["worthless", "idiot", "une ", "und ", "los ", "the "]
EDGES = [-1000.0, 0.0, 25.0, 100.0, 500.0, 2000.0, 10000.0]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> str:
    return f"cast({c} as decimal(14,2))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rows as one licence shape; ``ord`` covers every column used, so it is as good as a total order.

    The lines of a request are brought together and sorted as they are read, in few columns of numbers. The merge needs them
    so, and would otherwise sort and move its own rows, which are some times as wide, and partial records of hardly fewer
    lines, since those of a request lie far apart.
    """
    qty = "cast(l_quantity as bigint)"
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]
    return _t(spark, sf_dir, "lineitem").select(*columns).repartition("l_orderkey").sortWithinPartitions("l_orderkey").selectExpr(
        "l_orderkey as key",
        "named_struct('a', l_linenumber, 'b', l_partkey, 'c', l_suppkey, 'd', l_quantity, 'e', l_shipdate, 'f', l_returnflag, 'g', l_linestatus) as ord",
        f"if(l_returnflag = 'R', {qty}, 0L) as fell_count", f"if(l_returnflag = 'A', {qty}, 0L) as relocate_count", f"if(l_returnflag = 'N', {qty}, 0L) as preserve_count",
        "if(l_linestatus = 'F', concat('street ', l_suppkey), '') as street", "cast(l_partkey as string) as house",
        "cast(l_shipdate as date) as appeal_last", "cast(l_shipdate as date) as published",
        "if(l_linestatus = 'F', cast(l_suppkey as string), cast(null as string)) as licence_id",
        "if(l_linestatus = 'F', 'licensed', 'pending') as stage", "l_returnflag <> 'R' as can_appeal",
        "if(l_linenumber > 3, concat('applicant ', l_partkey), '') as applicant", "if(l_returnflag = 'N', cast(l_partkey as string), '') as block",
        "if(l_returnflag = 'A', cast(l_suppkey as string), '') as parcel", "l_returnflag as reason",
    )


_LINES = """lines as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) as ord,
  case when l_returnflag = 'R' then l_quantity::bigint else 0 end as fell_count, case when l_returnflag = 'A' then l_quantity::bigint else 0 end as relocate_count,
  case when l_returnflag = 'N' then l_quantity::bigint else 0 end as preserve_count,
  case when l_linestatus = 'F' then 'street ' || l_suppkey else '' end as street, l_partkey::varchar as house, l_shipdate::date as day,
  case when l_linestatus = 'F' then l_suppkey::varchar end as licence_id, l_linestatus = 'F' as licensed, l_returnflag <> 'R' as can_appeal,
  case when l_linenumber > 3 then 'applicant ' || l_partkey else '' end as applicant, case when l_returnflag = 'N' then l_partkey::varchar else '' end as block,
  case when l_returnflag = 'A' then l_suppkey::varchar else '' end as parcel, l_returnflag as reason from lineitem),
merged as (select key, sum(fell_count)::bigint as fell_count, sum(relocate_count)::bigint as relocate_count, sum(preserve_count)::bigint as preserve_count,
  coalesce(arg_min(street, ord) filter (where street <> ''), arg_min(street, ord)) as street, coalesce(arg_min(house, ord) filter (where street <> ''), arg_min(house, ord)) as house,
  max(day) as appeal_last, min(day) as published, arg_min(licence_id, ord) filter (where licence_id is not null) as licence_id,
  case when bool_or(licensed) then 'licensed' else 'pending' end as stage, bool_and(can_appeal) as can_appeal,
  coalesce(arg_min(applicant, ord) filter (where applicant <> ''), '') as applicant, coalesce(arg_min(block, ord) filter (where block <> ''), '') as block,
  coalesce(arg_min(parcel, ord) filter (where parcel <> ''), '') as parcel, coalesce(arg_min(reason, ord) filter (where reason <> ''), '') as reason
  from lines group by key)"""


@query(f"with {_LINES} select key, fell_count, relocate_count, preserve_count, street, house, appeal_last, published, licence_id, stage, can_appeal, applicant, block, parcel, reason from merged")
def request_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "key fell_count relocate_count preserve_count street house appeal_last published licence_id stage can_appeal applicant block parcel reason".split()
    return merge.merge_requests(_lines(spark, sf_dir)).select(*cols)


@query("""with x as (select l_orderkey as key, p_type as name, sum(l_quantity::bigint)::bigint as n, min(l_linenumber) as f from lineitem join part on l_partkey = p_partkey group by 1, 2)
select key, string_agg(name || case when n > 1 then ' x' || n else '' end, ', ' order by n desc, f, name) as species from x group by key""")
def species_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("key"), "p_type", F.col("l_quantity").cast("long").alias("qty"), "l_linenumber")
    return merge.sum_by_name(rows, "key", "p_type", "qty", "l_linenumber").select("key", T.species_text("species").alias("species"))


@query(f"with {_LINES} select key, appeal_last, fell_count, 'dated' as kind from merged where appeal_last >= date '{AS_OF}' "
       f"union all select key, appeal_last, fell_count, 'licensed' from merged where stage = 'licensed' and fell_count > 0 and (appeal_last is null or appeal_last >= date '{AS_OF}')")
def open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.merge_requests(_lines(spark, sf_dir)).select("key", "appeal_last", "fell_count", "stage")
    dated = merge.open_window(m, AS_OF, keep_undated=False).withColumn("kind", F.lit("dated"))
    return dated.unionByName(merge.open_licences(m, AS_OF).withColumn("kind", F.lit("licensed"))).drop("stage")


@query(f"with {_LINES} select key, fell_count from merged where stage = 'pending' and fell_count > 0")
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.pending(merge.merge_requests(_lines(spark, sf_dir))).select("key", "fell_count")


@query("""select user_id, event_id, event_type, round(value, 2) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("line_no"), "event_id", "event_type", F.round("value", 2).alias("value"))
    return state.fold(e, key="user_id").select("user_id", "event_id", "event_type", "value")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as records, and a state log: closed orders by key, part-shipped ones by customer as old ids."""
    o = _t(spark, sf_dir, "orders").select(
        F.concat_ws(":", F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").cast("string").alias("legacy_id"),
        F.when(F.col("o_totalprice") < 250000, "pending").otherwise("licensed").alias("stage"), "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"),
    )
    none = F.array().cast("array<string>")
    s = o.filter("o_orderstatus <> 'O'").select(
        F.when(F.col("o_orderstatus") == "F", F.col("key")).otherwise(F.concat(F.lit("old:"), "key")).alias("key"), "source",
        F.when(F.col("o_orderstatus") == "P", F.array("legacy_id")).otherwise(none).alias("legacy_ids"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("stage")).alias("stage"), F.col("day").alias("first_seen"),
    )
    return o.select("key", "source", "legacy_id", "stage", "o_orderkey", "day"), s


_STATE = """r as (select 'o:' || o_orderkey as key, o_orderpriority as source, o_custkey::varchar as legacy_id, case when o_totalprice < 250000 then 'pending' else 'licensed' end as stage, o_orderkey, o_orderstatus as s, o_orderdate::date as day from orders),
by_key as (select key, stage from r where s = 'F'), by_id as (select distinct source, legacy_id from r where s = 'P'),
m as (select r.*, by_key.key is not null or by_id.legacy_id is not null as seen, case when by_key.key is not null then by_key.stage when by_id.legacy_id is not null then 'pending' end as seen_stage
  from r left join by_key using (key) left join by_id on by_id.source = r.source and by_id.legacy_id = r.legacy_id)"""


@query(f"with {_STATE} select o_orderkey, key, stage from m where not seen")
def already_sent_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.classify(state.match(*_records(spark, sf_dir))).filter("kind = 'fresh'").select("o_orderkey", "key", "stage")


@query(f"with {_STATE} select o_orderkey, key, seen_stage from m where seen and seen_stage = 'pending' and stage = 'licensed'")
def pending_to_licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.classify(state.match(*_records(spark, sf_dir))).filter("kind = 'update'").select("o_orderkey", "key", "seen_stage")


@query(f"with {_STATE} select key, source, case when not seen then 'fresh' when seen_stage = 'pending' and stage = 'licensed' then 'update' else 'known' end as kind from m")
def classify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.classify(state.match(*_records(spark, sf_dir))).select("key", "source", "kind")


@query(f"""with {_STATE}, f as (select * from m where not seen)
select f.key, f.source, f.legacy_id as legacy_ids, f.day as first_seen, f.stage from f""")
def state_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _records(spark, sf_dir)
    fresh = state.classify(state.match(r, s)).filter("kind = 'fresh'").select("key", "source", "legacy_id", "stage", "day")
    return state.log_lines(fresh, s, F.col("day")).select("key", "source", F.array_join("legacy_ids", ",").alias("legacy_ids"), "first_seen", "stage")


@query("""with ids as (select trim(o_orderkey::varchar) as id from orders union select lpad(c_custkey::varchar, 7, '1') from customer union select p_name from part)
select case when length(id) = 7 then 'yeela' else 'haifa_pdf' end || ':legacy:' || id as key, id as source_id from ids
where regexp_full_match(id, '[0-9]+') and not exists (select 1 from orders o where o.o_orderstatus = 'F' and o.o_orderkey::varchar = id and length(id) <> 7)""")
def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    ids = o.select(F.col("o_orderkey").cast("string").alias("value")).unionByName(_t(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "1").alias("value")))
    ids = ids.unionByName(_t(spark, sf_dir, "part").select(F.col("p_name").alias("value")))
    have = o.filter("o_orderstatus = 'F'").select(F.lit(state.PDF).alias("source"), F.array(F.col("o_orderkey").cast("string")).alias("legacy_ids"))
    return state.migrate(ids, have).select("key", "source_id")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate::date, l_shipdate::date)::int as days from lineitem join orders on l_orderkey = o_orderkey
where date_diff('day', o_orderdate::date, l_shipdate::date) > 5""")
def backdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen, published = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    return j.filter(merge.back_dated(published, seen)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff(seen, published).alias("days"))


@query("""select n_name as area, (count(*) over (partition by n_name)) as n, c_custkey, c_name from customer join nation on c_nationkey = n_nationkey""")
def digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.digest(j, F.col("n_name"), "c_custkey", "c_name")


_FUNNEL = """select l_returnflag as source, l_returnflag = 'N' as failed, count(distinct l_suppkey) as pages, count(*) as raw_rows, count(distinct l_orderkey) as requests,
  count(*) filter (where l_quantity > 49) as passed, count(*) filter (where l_quantity > 50) as fresh from lineitem group by 1, 2"""


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source"), (F.col("l_returnflag") == "N").alias("failed")).agg(
        F.count_distinct("l_suppkey").alias("pages"), F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("l_orderkey").alias("requests"),
        F.count_if(F.col("l_quantity") > 49).alias("passed"), F.count_if(F.col("l_quantity") > 50).alias("fresh"),
    )


@query(f"""with c as ({_FUNNEL}) select *, case when pages = 0 then 'pages' when raw_rows = 0 then 'raw_rows' when requests = 0 then 'requests' when passed = 0 then 'passed' when fresh = 0 then 'fresh' end as first_zero,
case when pages = 0 then null when raw_rows = 0 then 'pages' when requests = 0 then 'raw_rows' when passed = 0 then 'requests' when fresh = 0 then 'passed' end as fed_by from c""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(_funnel(spark, sf_dir))


@query(f"with c as ({_FUNNEL}) select sum(pages)::bigint as pages, sum(raw_rows)::bigint as raw_rows, sum(requests)::bigint as requests, sum(passed)::bigint as passed, sum(fresh)::bigint as fresh, count(*) as sources from c where not failed")
def combined_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.combined(_funnel(spark, sf_dir))


_MODAL = """cnt as (select p_brand, p_size, p_type, count(*) as n from part group by all),
modal as (select p_brand, p_size, p_type, n, sum(n) over (partition by p_brand, p_size) as total, row_number() over (partition by p_brand, p_size order by n desc, p_type) as r from cnt),
h as (select p_brand, p_size, p_type from modal where r = 1),
g as (select *, sum(new) over (partition by p_brand order by p_size) as run from (select *, case when lag(p_type) over (partition by p_brand order by p_size) is not distinct from p_type then 0 else 1 end as new from h)),
runs as (select p_brand, p_type, min(p_size) as first, max(p_size) as last, count(*) as support from g group by p_brand, run, p_type),
rng as (select p_brand, (coalesce(lag(last) over w + 1, 0))::int as house_from, (case when lead(last) over w is null then 99999 else last end)::int as house_to, p_type, support from runs window w as (partition by p_brand order by first))"""


def _houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.modal(_t(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_type").select("p_brand", "p_size", "p_type")


@query(f"with {_MODAL} select * from rng")
def build_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.build(_houses(spark, sf_dir), "p_brand", "p_size", "p_type", min_run=1, min_support=1)


@query(f"""with {_MODAL}, ix as (select p_brand, house_from, house_to, p_type, 1 as priority, row_number() over (partition by p_brand order by house_from) as ord from rng),
lv as (select p_brand, p_type from (select p_brand, p_type, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r = 1),
q as (select p_partkey as rid, p_brand, case when p_size > 40 then null else p_size + 3 end as number from part),
c as (select q.rid, ix.p_type as neighborhood, 1 as priority, true as in_range, 0 as k, house_to - house_from as w, ord from q join ix on q.p_brand = ix.p_brand and q.number between house_from and house_to and not (house_from <= 0 and house_to >= 99999)
  union all select q.rid, lv.p_type, 2, false, 1, 99999, 0 from q join lv using (p_brand)
  union all select q.rid, ix.p_type, 1, false, 1, 99999, ord from q join ix on q.p_brand = ix.p_brand and house_from <= 0 and house_to >= 99999)
select rid, neighborhood, priority, in_range from (select *, row_number() over (partition by rid order by k, priority, w, ord) as r from c) where r = 1""")
def house_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = _t(spark, sf_dir, "part")
    r = build_ranges(spark, sf_dir)
    ix = r.select("p_brand", "house_from", "house_to", F.col("p_type").alias("neighborhood"), F.lit(1).alias("priority"), F.row_number().over(Window.partitionBy("p_brand").orderBy("house_from")).alias("ord"))
    whole = ranges.modal(part, ["p_brand"], "p_type").select("p_brand", F.lit(0).alias("house_from"), F.lit(99999).alias("house_to"), F.col("p_type").alias("neighborhood"), F.lit(2).alias("priority"), F.lit(0).alias("ord"))
    q = part.select(F.col("p_partkey").alias("rid"), "p_brand", F.when(F.col("p_size") <= 40, F.col("p_size") + 3).alias("number"))
    return resolver.decided(q, ix.unionByName(whole), "p_brand").select("rid", "neighborhood", "priority", "in_range")


@query("""with c as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2)
select l_suppkey, l_returnflag, n, total, round(n / total, 3) as support, round(n / total, 3) < 0.4 as weak from (select *, (sum(n) over (partition by l_suppkey))::bigint as total, row_number() over (partition by l_suppkey order by n desc, l_returnflag) as r from c) where r = 1""")
def modal_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranges.modal(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")
    return m.select("l_suppkey", "l_returnflag", "n", "total", F.round("share", 3).alias("support"), (F.round("share", 3) < 0.4).alias("weak"))


@query("""with s as (select l_suppkey, l_returnflag, sum(l_extendedprice::decimal(14,2)) as size from lineitem group by 1, 2)
select l_suppkey, l_returnflag, round(size::double / total::double, 3) as support from (select *, sum(size) over (partition by l_suppkey) as total, row_number() over (partition by l_suppkey order by size desc, l_returnflag) as r from s) where r = 1""")
def area_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_returnflag", f"{_cents('l_extendedprice')} as area")
    s = rows.groupBy("l_suppkey", "l_returnflag").agg(F.sum("area").cast("double").alias("area"))
    return index.share_majority(s, ["l_suppkey"], "l_returnflag", "area")


@query("""with n as (select distinct p_name as name from part), w as (select distinct unnest(string_split(name, ' ')) as q from n),
q as (select q from w union select distinct split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) from n),
m as (select q, name from q, n where list_has_all(string_split(name, ' '), string_split(q, ' ')))
select q, count(*) as n, min(name) as name from m group by q""")
def token_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    q = n.select(F.explode(F.split("name", " ")).alias("q")).unionByName(n.select(F.concat_ws(" ", F.split_part("name", F.lit(" "), F.lit(2)), F.split_part("name", F.lit(" "), F.lit(1))).alias("q"))).distinct()
    return resolver.subset_matches(q.select(F.col("q").alias("qid"), "q"), n).groupBy(F.col("qid").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))


_MARKS = " ".join(f"when contains(hay, '{p}') then 'area {i}'" for i, p in enumerate(LANDMARKS))


@query(f"""with d as (select doc_id as rid, trim(regexp_replace(coalesce(text, '') || ' ' || coalesce(source, ''), '\\s+', ' ', 'g')) as hay from documents)
select rid, case {_MARKS} end as neighborhood, 0.85::double as confidence from d where case {_MARKS} end is not null""")
def landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([(p, f"area {i}", i) for i, p in enumerate(LANDMARKS)], "pattern string, neighborhood string, ord int")
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.coalesce("text", F.lit("")).alias("full_text"), F.coalesce("source", F.lit("")).alias("street"))
    return resolver.landmark(d, marks).select("rid", "neighborhood", F.col("confidence").cast("double").alias("confidence"))


@query("""with d as (select doc_id as rid, trim(regexp_replace(coalesce(text, '') || ' ' || coalesce(source, ''), '\\s+', ' ', 'g')) as hay from documents),
m as (select substr(hay, 1, 14) as pattern, min(rid) as ord from d where hay <> '' group by 1)
select rid, arg_min('area ' || ord, ord) as neighborhood from d join m on contains(hay, pattern) group by rid""")
def landmark_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many patterns as there are beginnings of documents, each of which may stand anywhere in another."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.coalesce("text", F.lit("")).alias("full_text"), F.coalesce("source", F.lit("")).alias("street"))
    hay = T.clean_text(F.concat_ws(" ", "full_text", "street"))
    marks = d.select(F.substring(hay, 1, 14).alias("pattern"), "rid").filter("pattern <> ''").groupBy("pattern").agg(F.min("rid").alias("ord"))
    marks = marks.withColumn("neighborhood", F.concat(F.lit("area "), F.col("ord").cast("string")))
    return resolver.landmark(d, marks).select("rid", "neighborhood")


@query("""with q as (select distinct l_linenumber as a, l_quantity::int as b from lineitem),
x as (select a, b, unnest(generate_series(least(a, b), greatest(a, b)))::varchar as id from q union select a, b, (a + 100)::varchar from q) select distinct a, b, id from x""")
def id_list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    text = F.concat(F.lit(" "), F.col("b").cast("string"), F.lit("-"), F.col("a").cast("string"), F.lit("; 000"), (F.col("a") + 100).cast("string"))
    return q.select("a", "b", F.explode(T.id_list(text)).alias("id"))


@query("""with pr as (select l_partkey % 40 as b, l_suppkey % 25 as p, n_name as area, row_number() over (partition by l_partkey % 40, l_suppkey % 25 order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_partkey desc) as r
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
parcels as (select b, p, area from pr where r = 1),
bl as (select b, area, n / total as support, row_number() over (partition by b order by n desc, area) as r from (select b, area, count(*) as n, sum(count(*)) over (partition by b) as total from parcels group by 1, 2)),
q as (select o_orderkey as rid, o_orderkey % 50 as b1, o_custkey % 40 as b2, o_custkey % 27 as p from orders),
k as (select rid, p, 0 as k, b1 as b from q union all select rid, p, 1, b2 from q where b2 <> b1),
h as (select rid, min(area) as lo, max(area) as hi from k join parcels using (b, p) group by 1),
mj as (select rid, area, support from (select rid, area, support, row_number() over (partition by rid order by k) as r from k join bl using (b) where bl.r = 1) where r = 1)
select rid, lo as neighborhood, 0.95::double as confidence, 'block_parcel' as method, false as approximate from h where lo = hi
union all select rid, area, round(case when support >= 0.8 then 0.8 else support end, 6), case when support >= 0.8 then 'block_majority' else 'block_majority_weak' end, support < 0.8 or h.rid is not null from mj left join h using (rid) where h.rid is null or h.lo <> h.hi""")
def block_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = li.selectExpr("cast(l_partkey % 40 as string) as block", "cast(l_suppkey % 25 as string) as parcel", "n_name as neighborhood", "named_struct('a', l_orderkey, 'b', l_linenumber, 'c', l_suppkey, 'd', l_partkey) as ord")
    parcels = cut(rows.groupBy("block", "parcel").agg(F.max_by("neighborhood", "ord").alias("neighborhood")))
    whole = ranges.modal(parcels, ["block"], "neighborhood").select("block", F.lit("").alias("parcel"), "neighborhood", F.lit(2).alias("priority"), F.col("share").alias("support"), F.lit(0).alias("ord"))
    blocks = parcels.select("block", "parcel", "neighborhood", F.lit(1).alias("priority"), F.lit(1.0).alias("support"), F.lit(0).alias("ord")).unionByName(whole)
    q = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as rid", "concat(o_orderkey % 50, ',', o_custkey % 40) as block", "cast(o_custkey % 27 as string) as parcel")
    return resolver.block(q, blocks).withColumn("confidence", F.round("confidence", 6))


@query("""with n as (select distinct p_name as name from part), q as (select distinct replace(name, 'e', '') as q from n)
select q, name, levenshtein(q, name)::int as d from q join n on abs(length(q) - length(name)) <= 2 and levenshtein(q, name) <= 2""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    q = n.select(F.replace("name", F.lit("e"), F.lit("")).alias("q")).distinct()
    return resolver.near_names(q, "q", n, "name", 2).select("q", "name", "d")


# Weighted similarity of the pairs ``p`` (a, b): every LCS by its table, row after row, every stretch one by one.
_SCORED = """w as (select a, b, list_filter(string_split(a, ' '), lambda v: v <> '') as x, list_filter(string_split(b, ' '), lambda v: v <> '') as y from p),
k as (select a, b, array_to_string(list_sort(x), ' ') as sa, array_to_string(list_sort(y), ' ') as sb, array_to_string(list_sort(list_distinct(x)), ' ') as ua, array_to_string(list_sort(list_distinct(y)), ' ') as ub,
  array_to_string(list_sort(list_intersect(x, y)), ' ') as joint, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: not list_contains(y, v)))), ' ') as da, array_to_string(list_sort(list_distinct(list_filter(y, lambda v: not list_contains(x, v)))), ' ') as db from w),
g as (select a, b, 'raw' as kind, a as s, b as l from k union all select a, b, 'words', sa, sb from k union all select a, b, 'words', ua, ub from k),
h as (select a, b, kind, s, l from g where length(s) <= length(l) union all select a, b, kind, l, s from g where length(l) <= length(s)),
v as (select a, b, kind, s, substr(l, greatest(st, 0)::int + 1, (least(st + length(s), length(l)) - greatest(st, 0))::int) as t from (select *, unnest(range(1 - length(s), length(l))) as st from h)),
need as (select a as s, b as t from k union select sa, sb from k union select da, db from k union select s, t from v),
r as (select s, t, 0 as i, list_transform(range(length(t)), lambda j: 0::bigint) as line from need union all
  select s, t, i + 1, list_transform(range(1, length(t) + 1), lambda j: list_max(step[1 : j])) from (select *, list_transform(range(1, length(t) + 1), lambda j: greatest(line[j], case when substr(t, j::int, 1) = substr(s, i + 1, 1) then coalesce(line[j - 1], 0) + 1 else 0 end)) as step from r where i < length(s))),
c as (select s, t, coalesce(line[length(t)], 0) as m from r where i = length(s)),
best as (select a, b, max(200.0 * m / (length(s) + length(t))) filter (where kind = 'raw') as partial, max(200.0 * m / (length(s) + length(t))) filter (where kind = 'words') as words from v join c using (s, t) group by a, b),
m as (select k.*, 200.0 * c1.m / (length(a) + length(b)) as share, 200.0 * c2.m / (length(sa) + length(sb)) as word_sorted, partial, case when joint <> '' then 100.0 else words end as partial_words,
  case when joint <> '' and (da = '' or db = '') then 100.0 else greatest(100.0 * (1 - (length(da) + length(db) - 2.0 * c3.m) / (2 * length(joint) + 2 * (joint <> '')::int + length(da) + length(db))),
    case when joint <> '' then 100.0 * (1 - (1.0 + length(da)) / (2 * length(joint) + 1 + length(da))) else 0 end, case when joint <> '' then 100.0 * (1 - (1.0 + length(db)) / (2 * length(joint) + 1 + length(db))) else 0 end) end as word_set
  from k join c c1 on c1.s = a and c1.t = b join c c2 on c2.s = sa and c2.t = sb join c c3 on c3.s = da and c3.t = db join best using (a, b)),
scored as (select *, case when greatest(length(a), length(b)) < 1.5 * least(length(a), length(b)) then greatest(share, 0.95 * word_sorted, 0.95 * word_set)
  else greatest(share, partial * case when greatest(length(a), length(b)) <= 8 * least(length(a), length(b)) then 0.9 else 0.6 end, 0.95 * partial_words * case when greatest(length(a), length(b)) <= 8 * least(length(a), length(b)) then 0.9 else 0.6 end) end as score from m)"""
_ASKED = "case p_partkey % 5 when 0 then p_name || 's' when 1 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) when 2 then p_name || ' ' || lower(p_type) when 3 then substr(p_name, 1, 1) || substr(p_name, 3) else split_part(p_name, ' ', 2) end"


@query(f"""with recursive p as (select * from (select distinct {_ASKED} as a from part), (select distinct p_name as b from part)), {_SCORED},
ix as (select p_name as b, min(p_brand) as area from part group by p_name),
top as (select *, row_number() over (partition by a order by score desc, b) as n, max(score) over (partition by a) as high from scored where score >= 88),
tied as (select a, min(area) as lo, max(area) as hi, arg_min(area, n) as neighborhood, max(high) as high from top join ix using (b) where n <= 40 and high - score <= 2 group by a)
select p_partkey as rid, neighborhood, round(high / 100, 6) as confidence, 'fuzzy_street_level_p2' as method, true as approximate from part join tied on a = {_ASKED} where lo = hi""")
def fuzzy_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were lengthened, turned around, shortened by a letter or cut to a word, looked up among the right ones."""
    part = _t(spark, sf_dir, "part")
    ix = part.groupBy(F.col("p_name").alias("street_key")).agg(F.min("p_brand").alias("neighborhood"), F.min("p_partkey").alias("ord")).select("*", F.lit(0).alias("house_from"), F.lit(99999).alias("house_to"), F.lit(2).alias("priority"))
    q = part.select(F.col("p_partkey").alias("rid"), F.expr(_ASKED).alias("street"), F.col("p_size").alias("number"))
    return resolver.fuzzy(q, ix).withColumn("confidence", F.round("confidence", 6))


_CHAIN = "a as (select 'N' || n_nationkey as alias, case when n_nationkey = 0 then '' when n_nationkey = 13 then 'N21' else 'N' || (n_nationkey // 2) end as canonical from nation)"


@query(f"""with recursive {_CHAIN}, s as (select alias, canonical as t, [alias] as seen from a union all select s.alias, a.canonical, list_append(s.seen, s.t) from s join a on s.t = a.alias where not list_contains(s.seen, s.t))
select alias, arg_max(t, len(seen)) as canonical from s group by alias""")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    a = _t(spark, sf_dir, "nation").select(F.concat(F.lit("N"), k.cast("string")).alias("alias"), F.when(k == 0, "").when(k == 13, "N21").otherwise(F.concat(F.lit("N"), F.floor(k / 2).cast("string"))).alias("canonical"))
    return index.canonical(a)


@query("""select p_partkey, case when p_brand = 'Brand#1' then 'Brand#2' else p_brand end as p_brand from part where p_brand <> 'Brand#3'""")
def dropped_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "")], "alias string, canonical string")
    return index.rename_areas(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), a, "p_brand")


_WORDS = """ix as (select case when p_size % 3 = 0 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) else p_name end as street_key, p_brand as neighborhood, (1 + p_size % 4)::int as priority, 'm' as method, p_partkey as ord from part),
t as (select *, list_sort(list_distinct(string_split(street_key, ' '))) as tokens from ix),
g as (select tokens, min(priority) as best, arg_min(street_key, priority::bigint * 1000000000 + ord) as kept, list_distinct(list(street_key)) as keys from t where len(tokens) > 1 group by 1 having count(distinct street_key) > 1)"""


@query(f"""with {_WORDS} select street_key, neighborhood, priority, method, ord from t left join g using (tokens) where best is null or (street_key = kept and priority = best)
union all select o as street_key, neighborhood, priority, method || '_wordorder', ord from (select t.*, unnest(list_filter(keys, lambda x: x <> kept)) as o from t join g using (tokens) where priority = best)""")
def word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    ix = _t(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, turned).otherwise(F.col("p_name")).alias("street_key"), F.col("p_brand").alias("neighborhood"), (1 + F.col("p_size") % 4).alias("priority"), F.lit("m").alias("method"), F.col("p_partkey").alias("ord"))
    return index.merge_word_order(ix)


@query("""with n as (select distinct p_name, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)
select p_name, 0 as k, b as key from n union all select p_name, 1, a from n where a <> b""")
def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "part").select("p_name").distinct()
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    shown = F.concat(F.lit("("), a, F.lit(") רחוב "), b, F.lit("., 12א"))
    return n.select("p_name", F.posexplode(T.street_keys(shown)).alias("k", "key"))


@query(r"""select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) as text_md5, try_cast(nullif(regexp_extract(coalesce(text, ''), '([0-9]+)', 1), '') as integer) as number from documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose(_t(spark, sf_dir, "documents"), "text").select("doc_id", F.md5(T.clean_text("text")).alias("text_md5"), T.house_number("text").alias("number"))


@query("""select strftime(o_orderdate, '%Y-%m') as period, count(distinct l_orderkey) as n_licences, count(*) as n_rows, sum(l_quantity::bigint)::bigint as felled from lineitem join orders on l_orderkey = o_orderkey group by 1
union all select strftime(o_orderdate, '%Y'), count(distinct l_orderkey), count(*), sum(l_quantity::bigint)::bigint from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_orderdate", F.col("l_quantity").cast("long").alias("felled"))
    both = [reports.period_rollup(j, F.date_format("o_orderdate", p), ["felled"], "l_orderkey") for p in ("yyyy-MM", "yyyy")]
    return both[0].unionByName(both[1])


@query("""select p_type, sum(l_quantity::bigint)::bigint as total from lineitem join part on l_partkey = p_partkey group by 1 having sum(l_quantity) > 0 order by 2 desc, 1 limit 15""")
def top_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return reports.top_sums(j.select("p_type", F.col("l_quantity").cast("long").alias("qty")), "p_type", "qty", 15)


@query("""with x as (select 'o_orderstatus' as field, o_orderstatus as v from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'o_custkey', o_custkey::varchar from orders),
d as (select field, v, count(*) as n, row_number() over (partition by field order by v) as r from x where v is not null and v <> '' group by 1, 2)
select field, sum(n)::bigint as present, count(*) as n_distinct, string_agg(v, ',' order by v) filter (where r <= 12) as sample from d group by 1""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reports.profile(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return p.withColumn("sample", F.array_join("sample", ","))


@query("""select n as size, count(*) as n from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(" union all ".join(f"select lang, '{c}' as cell, '{k}' as keyword, count(*) filter (where contains({c}, '{k}') or contains({c}, '{k[::-1]}')) as n from documents group by 1 having count(*) filter (where contains({c}, '{k}') or contains({c}, '{k[::-1]}')) > 0" for c in ("text", "source") for k in KEYWORDS))
def keyword_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    cells = {c: F.col(c) for c in ("text", "source")}
    tests = reports.keyword_matrix(d.select("lang", "text", "source"), {f"{c}": v for c, v in cells.items()}, KEYWORDS, by=["lang"])
    return tests


_BINS = " ".join(f"when c_acctbal >= {EDGES[i]} and c_acctbal < {EDGES[i + 1]} then {i + 1}" for i in range(len(EDGES) - 1))


@query(f"select * from (select (case {_BINS} end)::int as bin, count(*) as n from customer group by 1) where bin is not null")
def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_t(spark, sf_dir, "customer"), "c_acctbal", EDGES)


@query("""select c_mktsegment, count(*) as n, round(median(c_acctbal), 4) as median from customer group by 1""")
def segment_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.medians(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").withColumn("median", F.round("median", 4))


@query("""select c_nationkey, count(*) as n, round(median(c_acctbal), 4) as median from customer group by 1 order by 2 desc, 1 limit 10""")
def top_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_medians(_t(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 10).withColumn("median", F.round("median", 4))


@query("select min(s_acctbal) as min_x, min(s_nationkey) as min_y, max(s_acctbal) as max_x, max(s_nationkey) as max_y from supplier")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bounding_box(_t(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey")


@query("""with u as (select 'orders' as source, 'requested' as kind, o_orderdate::date as date, 0::bigint as fell from orders union all
select 'lines', 'approved', case when l_linestatus = 'F' then l_shipdate::date end, l_quantity::bigint from lineitem)
select source, count(*) as records, count(*) filter (where date is null) as undated, sum(fell)::bigint as felled, min(year(date))::int as first_year, max(year(date))::int as last_year, count(distinct year(date)) as n_years from u group by 1""")
def union_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.lit("requested").alias("date_kind"), F.col("o_orderdate").cast("date").alias("date"), F.lit(0).cast("long").alias("fell"))
    li = _t(spark, sf_dir, "lineitem").select(F.lit("lines").alias("source"), F.lit("approved").alias("date_kind"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")).alias("date"), F.col("l_quantity").cast("long").alias("fell"))
    return reports.dataset_counts(o.unionByName(li))


@query("""with w as (select distinct p_name from part), s as (select distinct p_name from part where p_size = 1)
select p_name from w where p_name not in (select p_name from s)""")
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    s = p.filter("p_size = 1").select("p_name")
    return index.missing_tier(p.select("p_name").distinct(), s, "p_name")


# Pieces are [joiner, text]; '-' begins a chunk, '+' begins one that is full. A fold over them fills chunks greedily.
_SPLIT_SQL = r"""with d as (select doc_id, text from documents where text is not null and text <> ''),
para as (select doc_id, generate_subscripts(ps, 1) as p, unnest(ps) as para from (select doc_id, string_split(text, chr(10) || chr(10)) as ps from d where length(text) > 4096)),
line as (select doc_id, p, generate_subscripts(ls, 1) as l, unnest(ls) as line from (select doc_id, p, string_split(para, chr(10)) as ls from para where length(para) > 4096)),
piece as (select doc_id, p, 0 as l, 0 as c, [chr(10) || chr(10), para] as x from para where length(para) <= 4096
  union all select doc_id, p, l, 0, [case when l > 1 then chr(10) else '-' end, line] from line where length(line) <= 4096
  union all select doc_id, p, l, c, [case when (c + 1) * 4096 < length(line) then '+' else '-' end, substring(line, c * 4096 + 1, 4096)] from (select *, unnest(generate_series(0, (length(line) - 1) // 4096)) as c from line where length(line) > 4096)),
fold as (select doc_id, list_reduce(list_prepend(['='], list(list_concat(['='], x) order by p, l, c)), lambda acc, y: case
    when y[2] not in ('-', '+') and len(acc) = 1 then list_append(acc, '=' || y[3])
    when y[2] not in ('-', '+') and acc[-1] = '=' then list_append(acc[:-2], '=' || y[3])
    when y[2] not in ('-', '+') and length(acc[-1]) - 1 + length(y[2]) + length(y[3]) <= 4096 then list_append(acc[:-2], acc[-1] || y[2] || y[3])
    else list_append(acc, case when y[2] = '+' then '+' else '=' end || y[3]) end) as acc from piece group by doc_id),
out as (select doc_id, i, chunk from (select doc_id, generate_subscripts(acc, 1) as i, unnest(acc) as chunk from fold) where i > 1 and (chunk[1] = '+' or regexp_matches(chunk[2:], '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')))
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as n, md5(rtrim(chunk[2:], chr(10))) as chunk_md5 from out
union all select doc_id, 0, md5(text) from d where length(text) <= 4096"""


@query(_SPLIT_SQL)
def split_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "n", F.md5("chunk").alias("chunk_md5"))


@query(f"""with recursive {_MODAL},
lists as (select p_brand, list(struct_pack(v := p_type, f := first, l := last, s := support) order by first) as x from runs group by p_brand),
step as (select p_brand, x, 1 as phase from lists union all
  select p_brand, case when phase = 1 and i is not null then x[1 : i - 2] || [struct_pack(v := x[i - 1].v, f := x[i - 1].f, l := x[i + 1].l, s := x[i - 1].s + x[i].s + x[i + 1].s)] || x[i + 2 :]
    when phase = 2 and len(x) > 1 and x[w].s < 2 then x[1 : lo - 1] || [struct_pack(v := x[case when lo = w then w + 1 else lo end].v, f := x[lo].f, l := x[lo + 1].l, s := x[lo].s + x[lo + 1].s)] || x[lo + 2 :] else x end,
    case when phase = 1 and i is null then 2 when phase = 2 and not (len(x) > 1 and x[w].s < 2) then 3 else phase end
  from (select *, case when w = 1 or w < len(x) and x[w + 1].s > x[w - 1].s then w else w - 1 end as lo from (select *, list_filter(range(2, len(x)), lambda k: x[k].s < 2 and x[k - 1].v = x[k + 1].v)[1] as i,
    list_position(list_transform(x, lambda r: r.s), list_min(list_transform(x, lambda r: r.s))) as w from step where phase < 3))),
flat as (select p_brand, unnest(x) as r from step where phase = 3),
same as (select *, sum(new) over (partition by p_brand order by r.f) as run from (select *, case when lag(r.v) over (partition by p_brand order by r.f) is not distinct from r.v then 0 else 1 end as new from flat)),
one as (select p_brand, r.v as p_type, min(r.f) as first, max(r.l) as last, sum(r.s)::bigint as support from same group by p_brand, run, r.v)
select p_brand, (coalesce(lag(last) over w + 1, 0))::int as house_from, (case when lead(last) over w is null then 99999 else last end)::int as house_to, p_type, support from one window w as (partition by p_brand order by first)""")
def absorb_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.build(_houses(spark, sf_dir), "p_brand", "p_size", "p_type", min_run=2, min_support=2)


@query("""with b as (select n_nationkey, (n_nationkey % 5) * 20.0 as x0, (n_nationkey // 5) * 2200.0 - 1000 as y0 from nation), p as (select c_custkey, (c_custkey % 1000) / 10.0 as x, c_acctbal as y from customer)
select c_custkey, n_nationkey::bigint as area from p join b on x > x0 and x < x0 + 20 and y > y0 and y < y0 + 2200""")
def spatial_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "customer").selectExpr("c_custkey", "cast((c_custkey % 1000) / 10.0D as double) as x", "c_acctbal as y")
    x0, y0 = (F.col("n_nationkey") % 5) * 20.0, F.floor(F.col("n_nationkey") / 5) * 2200.0 - 1000
    ring = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in ((0, 0), (20, 0), (20, 2200), (0, 2200))))
    areas = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("area"), F.array(ring).alias("rings"))
    return spatial.within(points, areas).select("c_custkey", "area")


_TURNED = "case when p_size % 3 = 0 then reverse(p_name) when p_size % 3 = 1 then split_part(p_name, ' ', 2) || ' ' || lower(p_type) || ' ' || split_part(p_name, ' ', 1) else p_name || ' ' || p_name || ' ' || lower(p_brand) end"


@query(f"""with recursive p as (select distinct p_name as a, {_TURNED} as b from part), {_SCORED}
select a as p_name, b as other, round(share, 6) as share, round(partial, 6) as partial, round(word_sorted, 6) as word_sorted, round(word_set, 6) as word_set, round(partial_words, 6) as partial_words, round(score, 6) as score from scored""")
def text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(_t(spark, sf_dir, "part").select("p_name", F.expr(_TURNED).alias("other")).distinct())
    of = (sim.share, sim.partial, sim.word_sorted, sim.word_set, sim.partial_words)
    return n.select("p_name", "other", *(F.round(sim.measure(f, "p_name", "other"), 6).alias(f.__name__) for f in of), F.round(sim.similarity("p_name", "other"), 6).alias("score"))


@query("""with s as (select distinct 'Supplier' as street, s_nationkey::varchar as house from supplier), h as (select distinct 'Supplier' as street, n_nationkey::varchar as house from nation where n_regionkey = 2)
select street, house from s where house not in (select house from h)""")
def unmatched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = _t(spark, sf_dir, "supplier").select(F.split_part("s_name", F.lit("#"), F.lit(1)).alias("street"), F.col("s_nationkey").cast("string").alias("house"), F.col("s_name").alias("full_text"))
    seen = _t(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.lit("Supplier").alias("street"), F.col("n_nationkey").cast("string").alias("house"))
    return state.unmatched(misses, seen, F.current_date()).select("street", "house")
