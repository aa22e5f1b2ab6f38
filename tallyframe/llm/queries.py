"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, htmltext, licenses, lm, packing, pii, quality, simhash, toxicity, trie, urlfilter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer; resolved on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def piece_vocabulary_path() -> str:
    return tokenizer_path("piece_bpe_32k.model")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), piece_vocabulary_path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rules_frame(spark, urlfilter.BASE_RULES)
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_lattice_lm, op4_license_scan, op5_pii, op6_quality, op7_decontamination, op8_simhash, op9_warc_transactions, op10_url_rules, op11_main_text, op12_filter_audit, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": op4_sql(), "op7_decontamination": OP7_SQL, "op10_url_rules": OP10_SQL, "op9_warc_transactions": OP9_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}


OP10_SQL = r"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path
  from pages),
r(said, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(said, length(rhost || rpath)) as said
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select page_id, host, path, rule, coalesce(said, 'allow') as verdict from u left join fits using (page_id)
"""

OP9_SQL = r"""
with p as (
  select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
bits as (
  select page_id, octet_length(b) as payload_bytes, h,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::int, 5))::int) as five
  from p),
d as (
  select page_id, payload_bytes,
         array_to_string(list_transform(five, lambda x:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') as payload_digest
  from bits),
m as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to
from m
"""

OP12_SQL = r"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) over (partition by t), false)} as x
  from d left join l using (doc_id)),
g as (
  select part, good, toxic, (case when x['A'] then 'A' else '' end) || (case when x['B'] then 'B' else '' end) || (case when x['C'] then 'C' else '' end) || (case when x['D'] then 'D' else '' end) || (case when x['E'] then 'E' else '' end) as fails, count(*) as n
  from f group by all),
o(filter_order) as (
  select '' union all select filter_order || x from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(x) where not contains(filter_order, x)),
s as (select filter_order, step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as earlier from o, (values (1), (2), (3), (4), (5)) v(step) where length(filter_order) = 5),
c as (
  select part, filter_order, step, x,
         sum(n) filter (translate(fails, earlier || x, '') = fails)::bigint as kept,
         sum(n) filter (contains(fails, x) and translate(fails, earlier, '') = fails)::bigint as removed,
         sum(n) filter (contains(fails, x) and translate(fails, earlier, '') <> fails)::bigint as redundant,
         sum(n) filter (fails = x)::bigint as unique_fails,
         sum(n) filter (contains(fails, x) and translate(fails, earlier, '') = fails and good)::bigint as good_lost,
         sum(n) filter (contains(fails, x) and translate(fails, earlier, '') = fails and toxic)::bigint as toxic_lost
  from g, s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails,
       coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost, coalesce(sum(removed) over (partition by part, x), 0)::bigint as shapley
from c
"""

OP13_SQL = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
         xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
             lambda crc, b: list_reduce([xor(crc, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h
  from (select distinct conv_id from t)),
r as (
  select c.conv_id, pos, role, text from c join t on t.conv_id = base and pos < h
  union all select conv_id, pos + 10, role, text from c join t using (conv_id) where pos >= h),
s as (
  select conv_id, row_number() over w as depth, length(text) as chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over w) as node
  from r window w as (partition by conv_id order by pos)),
m as (select conv_id, depth, chars, node from s union all select conv_id, 0, 0, '' from c),
n as (select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved from m group by node),
last as (select conv_id, arg_max(node, depth) as node from m group by 1),
e as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from last group by 1),
-- a node's ancestors are the nodes of its smallest member that are not deeper
a as (select m.node as above, n.node, n.saved from n join m on m.conv_id = n.conv_id and m.depth <= n.depth),
p as (select a.above as parent, a.node from a join n x on x.node = a.above join n y on y.node = a.node where x.depth = y.depth - 1),
k as (select parent, count(*) as n_children from p group by 1),
b as (select above, count(*) filter (k.parent is null) as n_leaves, sum(saved)::bigint as saved_tokens from a left join k on k.parent = a.node group by 1)
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from n left join p on p.node = n.node left join n q on q.node = p.parent left join k on k.parent = n.node join b on b.above = n.node left join e on e.node = n.node
"""

OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bi as (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0),
g as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram from bi),
di as (select doc_id, w, unnest(generate_series(1, len(w))) as i from d where len(w) > 0),
dg as (select doc_id, len(w) as nw, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') as gram from di, (select distinct n from g) s where i + s.n - 1 <= len(w)),
hits as (select doc_id, i, dg.n, item_id from dg join g using (n, gram)),
covered as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from hits),
c as (select doc_id, count(*) as n_hit from covered group by 1),
k as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from hits group by 1)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join k using (doc_id)
"""


def op4_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
    return OP4_SQL.replace("TEMPLATE_ROWS", rows)


OP4_SQL = r"""
with t0(template, license, text) as (values TEMPLATE_ROWS),
t as (select template, license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from t0),
ts as (select template, license, len(w) - 1 as n from t),
-- 2 * shared / (n + s) can be 0.8 only where s * 3 >= n * 2 and s * 2 <= n * 3
sizes as (select template, s0 from (select template, n, unnest(range(1, 2 * n + 1)) as s0 from ts) where s0 * 3 >= n * 2 and s0 * 2 <= n * 3),
tb as (select template, g, count(*) as tn from (select template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from t) group by all),
d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from documents),
di as (select rid, w, unnest(range(1, len(w))) as p from d where len(w) > 1),
h as (select rid, template, p, g, tn from (select rid, p, w[p] || ' ' || w[p + 1] as g from di) join tb using (g)),
c as (select rid, template, n, count(*) over (partition by rid, template) as found from h join ts using (template) qualify row_number() over (partition by rid, template) = 1 and found * 3 >= n * 2),
cs as (select distinct rid, template, n, len(w) - 1 as size, least(s0, len(w) - 1) as s
       from c join d using (rid) join sizes using (template) where len(w) - 1 >= (select min(s0) from sizes z where z.template = c.template)),
starts as (select distinct cs.*, least(p, size - s + 1) as a from cs join h using (rid, template)),
inside as (select st.rid, st.template, n, s, a, g, least(count(*), any_value(tn)) as k from starts st join h on h.rid = st.rid and h.template = st.template and h.p >= a and h.p < a + s group by all),
m as (select rid, template, 2.0::double * sum(k)::bigint / (n + s) as dice from inside group by rid, template, n, s, a),
b as (select rid, arg_min(license, (-dice, license)) as license, max(dice) as dice, count(distinct license) as n_licenses
      from m join ts using (template) where dice >= 0.8 group by rid)
select doc_id, license, coalesce(dice, 0.0::double) as dice, coalesce(n_licenses, 0) as n_licenses from d left join b using (rid)
"""
