"""Queries of the training-data operators: thin digests over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.llm import conversation_trie, curriculum, decontam, filter_audit, html_extract, line_dedup, packing, quality, simhash, suffix_dedup, token_rollup, toxicity, url_filter
from permitflow.llm.common import cut, shared_dir, sized, table


def tokenizer_path() -> str:
    """The production vocabulary; other callers pass their own path to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), kept=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(table(spark, sf_dir, "documents")).select(*cols)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted; then the toxic ones among the labelled are withdrawn, and those of low quality come back
    revised, with their white space trimmed. The first batch is replayed, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    version = "byte_bpe_50k"
    store = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}").temporary()
    changes = token_rollup.count_tokens(docs, tokenizer_path(), version)
    store.commit("documents", changes)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    ids = sized(cut(marks.filter("coalesce(toxic, 0) <> 1 and quality = 0").select("doc_id")))
    poor = docs.join(ids, "doc_id", "left_semi").withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    revised = token_rollup.count_tokens(poor, tokenizer_path(), version, seq=1)
    store.commit("corrections", revised.unionByName(token_rollup.withdrawals(marks.filter("toxic = 1"), version, seq=1)))
    store.commit("documents", changes)  # a replay: skipped before it is computed
    return store.totals()


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to three turns of the first of their twenty, as threads that fork from one start do."""
    most = lambda c: (F.crc32(c.cast("string")) % 4).cast("int")
    return conversation_trie.trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 20, most, 3)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_url_filter, op4_suffix_array_dedup, op5_quality_rules, op6_token_counts, op7_html_extraction, op8_simhash_near_dedup, op9_best_fit_packing, op10_benchmark_decontamination, op11_conversation_trie, op12_filter_audit, op13_mixing)}


# Lines by exact distinct counts: sketches only decide where they are sure to be right.
_OP1_SQL = """with d as (select doc_id, coalesce(source, chr(1)) as site, text, string_split(text, chr(10)) as lines from documents),
o as (select doc_id, site, unnest(generate_series(1, len(lines))) as pos, unnest(lines) as line from d),
k as (select doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(13)) as key from o),
b as (select key, min(struct_pack(d := doc_id, p := pos)) as first from k where key <> '' group by key having count(distinct site) >= 10),
j as (select k.*, b.key is not null and (b.first.d <> k.doc_id or b.first.p <> k.pos) as gone from k left join b using (key)),
t as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from j group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, length(coalesce(t.text, '')) as n_chars, md5(coalesce(t.text, '')) as text_md5
from documents left join t using (doc_id)"""

# Texts as hexadecimal digits of their bytes, so that strings of 50 bytes are substrings of 100 digits.
_OP4_SQL = """with d as (select doc_id, coalesce(hex(encode(text)), '') as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) as p from d where length(h) >= 100)),
o as (select s, min(doc_id) as low from w group by s),
hit as (select w.doc_id, p from w join o using (s) where low < w.doc_id),
r as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end as new from hit),
g as (select doc_id, min(p) as a, max(p) + 50 as z from (select *, sum(new) over (partition by doc_id order by p) as run from r) group by doc_id, run),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as y from g),
e as (select doc_id, count(*) as n_spans, sum(z - a)::bigint as n_removed, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as left_over from k join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_over, h))) as kept_sha256 from d left join e using (doc_id)"""

_OP10_SQL = r"""with lower_az as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from lower_az),
i as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ik as (select item, w, least(10, len(w)) as k from i where len(w) > 0),
iw as (select distinct item, k, array_to_string(w[s : s + k - 1], ' ') as win from (select item, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from ik)),
dw as (select doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') as win from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from d, (select distinct k from ik) where len(w) >= k)),
m as (select doc_id, s, k, item from dw join iw using (k, win)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + k - 1)) as p from m) group by 1),
g as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (doc_id) left join g using (doc_id)"""


# Checksums of ids are made bit by bit; prefixes are lists of turns, and a node is one of them.
_OP11_SQL = r"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as i from conversations where conv_id is not null),
c as (select conv_id, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint), lambda a, b: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(a, b)), 4294967295::bigint), 4294967295) % 4 as h from (select distinct conv_id from t)),
s as (select c.conv_id, i as d, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and i <= h),
n as (select c.conv_id, h, count(s.d) as got from c left join s using (conv_id) group by all),
o as (select * from s union all select n.conv_id, i - h + got, role, text from n join t using (conv_id) where i > h),
p as (select conv_id, d as depth, text, list(struct_pack(r := role, t := text)) over (partition by conv_id order by d) as path from o
  union all select conv_id, 0, '', [] from c),
m as (select depth, path, min(conv_id) as owner, count(*) as n_convs, (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')), 0) as saved from p group by depth, path),
l as (select conv_id, max(depth) as length from p group by conv_id),
w as (select p.conv_id, p.depth, m.owner from p join m using (depth, path)),
k as (select distinct w.owner, w.depth, u.owner as parent from w join w u on u.conv_id = w.conv_id and u.depth = w.depth - 1),
kids as (select parent as owner, depth - 1 as depth, count(*) as n_children from k group by all),
node as (select m.owner, m.depth, n_convs, saved, coalesce(n_children, 0) as n_children from m left join kids using (owner, depth)),
sub as (select w.owner, w.depth, sum(y.saved) as saved_tokens, count(*) filter (where y.n_children = 0) as n_leaves from node y join w on w.conv_id = y.owner and w.depth <= y.depth group by all),
e as (select owner, w.depth, sha256(string_agg(w.conv_id::varchar, ',' order by w.conv_id)) as ends from w join l on l.conv_id = w.conv_id and l.length = w.depth group by all)
select node.owner as conv_id, node.depth, k.parent as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::bigint as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from node join sub using (owner, depth) left join k using (owner, depth) left join e using (owner, depth)"""

# All orders are the pairwise distinct choices of five letters; an order's rows are counted one by one.
_OP12_SQL = r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as low from d),
f as (select part, doc_id, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(low < doc_id, false)] as fails from w),
g as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from (
  select part, fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic from f left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1) using (doc_id)) group by all),
x as (select unnest(generate_series(1, 5)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as idx from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select idx, step, list_transform(idx, lambda i: substr('ABCDE', i, 1)) as letters from o, (select i as step from x)),
r as (select part, array_to_string(letters, '') as filter_order, step, fails[idx[step]] as hit, coalesce(list_bool_or(list_transform(idx[1 : step - 1], lambda i: fails[i])), false) as before,
  len(list_filter(fails, lambda v: v)) as n_fails, n, good, toxic from g, s)
select part, filter_order, step::int as step, coalesce(sum(n) filter (where not hit and not before), 0)::bigint as kept, coalesce(sum(n) filter (where hit and not before), 0)::bigint as removed,
coalesce(sum(n) filter (where hit and before), 0)::bigint as redundant, coalesce(sum(n) filter (where hit and n_fails = 1), 0)::bigint as unique_fails,
coalesce(sum(good) filter (where hit and not before), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where hit and not before), 0)::bigint as toxic_lost,
coalesce(sum(n * 120 // greatest(n_fails, 1)) filter (where hit), 0)::bigint as shapley from r group by part, filter_order, step"""

# Targets by the source at which the level of words per weight is found, in order of their ceilings.
_OP13_SQL = r"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
k as (select *, row_number() over (order by source nulls last) - 1 as rank, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 3.0::double * source_size as cap from s),
q as (select *, (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over (order by cap / w, rank rows between current row and unbounded following) as free from k),
v as (select coalesce(arg_min(rest / free, row(cap / w, rank)) filter (where w * (rest / free) < cap), 0) as level from q),
t as (select source, rank, source_size, least(cap, w * level) as target from k, v),
o as (select d.*, t.* exclude (source), sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first, size rows unbounded preceding) - size as begin from d join t on d.source is not distinct from t.source),
r as (select *, least(round(target)::bigint, 3 * source_size) as quota, case when size > 0 and begin < least(round(target)::bigint, 3 * source_size) then begin / target end as share from o),
p as (select *, case rank % 3
  when 0 then case when share < 0.6 then 2 * share / (sqrt(2.56 - 3.2 * share) + 1.6) else 0.5 + (share - 0.6) / 0.8 end
  when 1 then share
  else case when share < 0.4 then 2 * share / (sqrt(0.16 + 3.2 * share) + 0.4) else 0.5 + (share - 0.4) / 1.2 end end as first_position from r)
select doc_id, size, source_size, target, (greatest(least(size, quota - begin), 0) + greatest(least(size, quota - begin - source_size), 0) + greatest(least(size, quota - begin - 2 * source_size), 0))::bigint as taken, round(first_position, 6) as first_position from p"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express. String kernels, fingerprints, sketches of more values than they hold, byte-pair ids,
    template trees and markup are held against brute force in tests instead."""
    return {"op1_line_dedup": _OP1_SQL, "op4_suffix_array_dedup": _OP4_SQL, "op10_benchmark_decontamination": _OP10_SQL, "op11_conversation_trie": _OP11_SQL, "op12_filter_audit": _OP12_SQL, "op13_mixing": _OP13_SQL}
