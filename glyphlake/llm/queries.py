"""The queries over the test tables, one for each operator of this package."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, licenses, minhash, packing, quality, secrets, sharding, token_files, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the number of links that the search has used depends on its centres
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


OP1_SQL = r"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as (
  select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from split),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(id, c) as (select doc_id, doc_id from documents union select l.b, r.c from reach r join links l on l.a = r.id)
select d.doc_id, coalesce(z.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d left join sizes z on z.doc_id = d.doc_id join (select id, min(c) as c from reach group by id) m on m.id = d.doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("masked")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
split as (
  select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from texts),
sets as (
  select kind, id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
  from split),
items as (select id as item_id, s, count(*) over (partition by id) as n_item from sets where kind = 'i')
select d.id as doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from items i join sets d on d.kind = 'd' and d.s = i.s
group by d.id, item_id, n_item having 100 * count(*) >= 75 * n_item
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("n_lines")


_LN_GAMMA = math.log(quality.GAMMA)
_RATE = "select g_lang, g_source, doc_id, '{}' as rate, {} as v from fine"
# rate, upper quantile, reach in ranges, least range, whether low values are out of line
_LIMITS = ", ".join(f"('{n}', {1 - u!r}, {u!r}, {quality.FENCE * share!r}, {least!r}, {low})" for n, (u, share, least, low) in quality.RATES.items())
_LEVEL = """
  select {keys} l.rate, max("all") as n, any_value(l.two) as two, any_value(l.reach) as reach, any_value(l.least) as least,
         min(case when upto > l.p * ("all" - 1) then bucket end) as lo, min(case when upto > l.q * ("all" - 1) then bucket end) as hi
  from (select *, sum(n) over (partition by {keys} rate) as "all", sum(n) over (partition by {keys} rate order by bucket rows unbounded preceding) as upto
        from (select {keys} rate, bucket, sum(n) as n from sketch group by all)) s join limits l on l.rate = s.rate group by {keys} l.rate"""
_FENCE = """
  select * exclude (lo, hi), case when two then lo - reach * greatest(hi - lo, least) end as low, hi + reach * greatest(hi - lo, least) as high
  from (select * replace (case when lo = {zero} then 0.0::double else pow({gamma}::double, lo) * {middle}::double end as lo,
                          case when hi = {zero} then 0.0::double else pow({gamma}::double, hi) * {middle}::double end as hi) from ({level}))"""
_fence_of = lambda keys: _FENCE.format(zero=quality._ZERO, gamma=repr(quality.GAMMA), middle=repr(2 / (1 + quality.GAMMA)), level=_LEVEL.format(keys=keys))

OP6_SQL = rf"""
with split as (
  select doc_id, lang, source, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as s from split where len(w) > 2),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
spread as (select doc_id, count(distinct i + k) as n from twice, range(3) r(k) group by doc_id),
counts as (
  select s.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(l) as n_lines,
         len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed, coalesce('=' || lang, '-') as g_lang, coalesce('=' || source, '-') as g_source
  from split s left join spread x on x.doc_id = s.doc_id),
fine as (select * from counts where not base_failed),
rates as ({" union all ".join(_RATE.format(n, f"case when {b} > 0 then {a} / {b} else 0.0 end::double") for n, a, b in (("word_length", "word_chars", "n_words"), ("symbol_rate", "n_symbols", "n_words"), ("dup_line_rate", "n_dup_lines", "n_lines"), ("repeat_rate", "n_repeat_words", "n_words")))}),
sketch as (select g_lang, g_source, rate, case when v > 0 then ceil(ln(v) / {_LN_GAMMA!r}::double)::int else {quality._ZERO} end as bucket, count(*) as n from rates group by all),
limits(rate, p, q, reach, least, two) as (select a, b::double, c::double, d::double, e::double, f from (values {_LIMITS}) v(a, b, c, d, e, f)),
g as ({_fence_of("g_lang, g_source, ")}), l as ({_fence_of("g_lang, ")}), a as ({_fence_of("")}),
out_of_line as (
  select distinct r.doc_id from rates r join g on g.g_lang = r.g_lang and g.g_source = r.g_source and g.rate = r.rate join l on l.g_lang = r.g_lang and l.rate = r.rate join a on a.rate = r.rate
  where v > case when g.n >= {quality.MIN_GROUP} then g.high when l.n >= {quality.MIN_GROUP} then l.high else a.high end
     or v < case when g.n >= {quality.MIN_GROUP} then g.low when l.n >= {quality.MIN_GROUP} then l.low else a.low end)
select c.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and o.doc_id is null as kept
from counts c left join out_of_line o on o.doc_id = c.doc_id
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.listed_sites(spark))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_VALUES = lambda *rows: ", ".join(f"('{x}')" for x in rows)
_SITES = " union all ".join(f"select a || '-' || b as ab, b || '-' || a as ba from (values {_VALUES(*x)}) x(a), (values {_VALUES(*y)}) y(b)" for x, y in urls.SITE_WORDS)
OP9_SQL = rf"""
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
names as (select unnest([ab, ba]) as name from ({_SITES})),
hosts as (select distinct name || '.' || suffix || '/' as entry, name || '.' || suffix as h from names, (values {_VALUES(*urls.SITE_SUFFIXES)}) s(suffix)),
fits as (
  select d.host, d.path, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(r.verdict, length(r.h || r.p)) as verdict
  from (select distinct host, path from u) d join rules r on (d.host = r.h or ends_with(d.host, '.' || r.h)) and starts_with(d.path, r.p)
  group by 1, 2),
lists as (
  select d.host, min_by(l.entry, (length(l.entry), l.entry)) as listed
  from (select distinct host, trim(lower(url_decode(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''))), '.') as bare from u) d
  join hosts l on d.bare = l.h or ends_with(d.bare, '.' || l.h) group by 1)
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, case when l.listed is not null then 'block' else 'allow' end) as verdict, l.listed
from u left join fits f on u.host = f.host and u.path = f.path left join lists l on u.host = l.host
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_sharding, op3_secret_scan, op4_decontamination, op5_token_files, op6_quality_rules, op7_html_extraction, op8_best_fit_packing, op9_url_filter, op10_license_scan]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op4_decontamination": OP4_SQL, "op6_quality_rules": OP6_SQL, "op9_url_filter": OP9_SQL}
