"""The registered queries: each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, exact_dedup, html_text, near_dedup, packing, pii, quality, sharding, toxicity, turn_repair, url_filter, whitening
from .common import table

#: Key of the example pseudonyms; a deployment passes its own secret.
EXAMPLE_KEY = b"example key, not a secret"


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chars")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2, threshold=0.8)


def op7_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize_texts(table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    return found.select("doc_id", F.size("spans").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"), "text")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch day, which the table doesn't have: it follows from the page's number."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries of three lists, made from the hosts and URLs of pages by their hashes, since no table has lists."""
    pages = table(spark, sf_dir, "pages").where("url is not null").select(url_filter.host_of(F.col("url")).alias("host"), url_filter.page_of(F.col("url")).alias("page"))
    number = lambda c, at, n: F.conv(F.substring(F.md5(c), at, 4), 16, 10).cast("int") % n
    first = F.lit("2024-01-01").cast("date")

    def entry(rows: DataFrame, name: str, kind: str, pattern: str, day, action: str) -> DataFrame:
        return rows.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.col(pattern).alias("pattern"), F.date_add(first, day).alias("day"), F.lit(action).alias("action"))

    hosts = pages.select("host").distinct()
    domains = hosts.select(F.regexp_extract("host", "([^.]+[.][^.]+[.][^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    spam, gone = domains.where(number("domain", 1, 3) == 0), number("domain", 5, 180)
    some = pages.where(number("page", 1, 20) == 0).select("page").distinct()
    ads = hosts.where("host like '%pills%' or host like '%casino%'")
    return (
        entry(spam, "spam", "domain", "domain", gone, "add").union(entry(spam, "spam", "domain", "domain", gone + 60, "remove"))
        .union(entry(spam.where(number("domain", 9, 2) == 0), "spam", "domain", "domain", gone + 90, "add"))
        .union(entry(ads, "adult", "domain", "host", F.lit(0), "add"))
        .union(entry(some, "takedown", "page", "page", number("page", 5, 366), "add"))
    )


def op8_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(captures(spark, sf_dir), list_entries(spark, sf_dir))


def op9_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "coverage", "longest", "n_tiles")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    done = byte_bpe.round_trip(docs)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_rows(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minimax_shards, op2_toxicity, op3_html_text, op4_ordinal_quality, op5_exact_dedup, op6_near_dedup, op7_pii_feistel, op8_url_asof, op9_benchmark_tiling, op10_byte_bpe,
        op11_whitening, op12_best_fit_packing, op13_turn_repair,
    )
}

_EXACT = r"""
with d as (
  select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) h from documents
), g as (
  select h, count(*) group_size, max(n) n from d group by h
), k as (
  select g.h, g.group_size, g.n, min(d.doc_id) keep_id from g join d on d.h = g.h and d.n = g.n group by all
)
select d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id as kept, d.h as text_sha256 from d join k using (h)
"""

_NEAR = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as (
  select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end s from w
), e as materialized (select doc_id, len(s) n, unnest(s) g from s),
l as materialized (
  select a.doc_id a, b.doc_id b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), u as materialized (select a, b from l union all select b, a from l),
r as (select distinct a node, a reach from u union select r.node, u.b from r join u on u.a = r.reach),
c as (select node, min(reach) component_id from r group by node)
select s.doc_id, cast(len(s) as bigint) n_shingles, coalesce(c.component_id, s.doc_id) component_id, coalesce(c.component_id, s.doc_id) = s.doc_id as kept
from s left join c on c.node = s.doc_id
"""

_URL = r"""
with p as (
  select page_id, url, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) host,
         coalesce(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '') path,
         date '2024-01-01' + cast(page_id % 366 as integer) as day
  from pages
), q as (select *, host || path page from p),
x as (select distinct regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) v from q where host <> ''),
s as (
  select v, date '2024-01-01' + cast(('0x' || substr(md5(v), 5, 4))::bigint % 180 as integer) d, ('0x' || substr(md5(v), 9, 4))::bigint % 2 again
  from x where v <> '' and ('0x' || substr(md5(v), 1, 4))::bigint % 3 = 0
), i as (
  select 'spam' list, 'domain' kind, v pattern, d f, d + 60 t from s
  union all select 'spam', 'domain', v, d + 90, null from s where again = 0
  union all select distinct 'adult', 'domain', host, date '2024-01-01', null from q where host like '%pills%' or host like '%casino%'
  union all select distinct 'takedown', 'page', page, date '2024-01-01' + cast(('0x' || substr(md5(page), 5, 4))::bigint % 366 as integer), null
    from q where url is not null and ('0x' || substr(md5(page), 1, 4))::bigint % 20 = 0
), h as (
  select q.page_id, i.list, i.pattern, i.f from q join i on i.f <= q.day and (i.t is null or q.day < i.t)
    and (i.kind = 'domain' and (q.host = i.pattern or ends_with(q.host, '.' || i.pattern)) or i.kind = 'page' and q.page <> q.host and q.page = i.pattern)
), b as (
  select page_id, count(distinct list) n, (array_agg(struct_pack(list := list, pattern := pattern, f := f) order by length(pattern) desc, list, pattern, f))[1] as hit from h group by page_id
)
select q.page_id, q.url, q.host, q.day, coalesce(b.n, 0) > 0 as blocked, cast(coalesce(b.n, 0) as integer) as n_lists, b.hit.list as list, b.hit.pattern as pattern, b.hit.f as since
from q left join b using (page_id)
"""

# CRC-32 has no function here: byte by byte, bit by bit. Each recursion reads one turn of all conversations and keeps the best of each state.
_TURNS = r"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') key from conversations
), h as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 20 m from k
), d as (
  select conv_id, turn, row_number() over (partition by conv_id order by turn nulls first, r0, t0, copy) i, case when m = 4 then 'user' else r0 end r, case m when 1 then '' when 2 then translate(t0, '.!?', '') else t0 end t
  from h, (values (0), (1)) v(copy) where m <> 0 and (copy = 0 or m = 3)
), f as (
  select *, lag(substr(r, 1, 1)) over (partition by conv_id order by i) before,
    case when not regexp_matches(t, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, r, t order by i) > 1 then 'd' when not regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') then 't' else 'f' end fault
  from d
), n as (
  select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, sum((fault = 'b')::bigint) blank, sum((fault = 'd')::bigint) duplicate, sum((fault = 't')::bigint) truncated,
    sum((before is not null and (before || substr(r, 1, 1)) not in ('su', 'ua', 'au'))::bigint) illegal
  from f group by conv_id
), step(a, role, b) as (values ('0', 's', '1'), ('0', 'u', '2'), ('1', 'u', '2'), ('3', 'u', '2'), ('2', 'a', '3')),
ins as (
  select s a, s b, 0 cost, '' audit, '' lines from (values ('0'), ('1'), ('2'), ('3')) v(s)
  union all select a, b, 3, 'I', case role when 'u' then 'user:' else 'assistant:' end || chr(10) from step where role <> 's'
  union all select a, '3', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10) from (values ('0'), ('1')) v(a)
), way as (
  select f.conv_id, f.i, i.a, e.b, i.cost + e.cost cost, i.audit || e.audit audit, i.lines || e.lines lines
  from f, ins i, lateral (
    select i.b b, 4 cost, 'D' audit, '' lines
    union all select s.b, case when fault = 't' then 3 else 0 end, 'K', r || ':' || t || chr(10) from step s where s.a = i.b and s.role = substr(r, 1, 1) and fault in ('t', 'f')
    union all select s.b, case when fault = 't' then 6 else 3 end, 'R', case s.role when 'u' then 'user:' else 'assistant:' end || t || chr(10) from step s where s.a = i.b and s.role <> 's' and fault in ('t', 'f')
  ) e
), walk as (
  select conv_id, 0::bigint i, '0' st, {'cost': 0::bigint, 'audit': '', 'lines': ''} best from n
  union all
  select w.conv_id, w.i + 1, y.b, min({'cost': w.best.cost + y.cost, 'audit': w.best.audit || y.audit, 'lines': w.best.lines || y.lines})
  from walk w join way y on y.conv_id is not distinct from w.conv_id and y.i = w.i + 1 and y.a = w.st group by w.conv_id, w.i, y.b
), ended as (
  select n.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit, 'lines': w.best.lines || i.lines}) best
  from walk w join n on n.conv_id is not distinct from w.conv_id and n.n = w.i join ins i on i.a = w.st and i.b in ('0', '3') group by n.conv_id
), c as (select distinct conv_id from conversations)
select c.conv_id, coalesce(n.gaps, 0)::bigint gaps, coalesce(n.blank, 0)::bigint blank, coalesce(n.duplicate, 0)::bigint duplicate, coalesce(n.truncated, 0)::bigint truncated, coalesce(n.illegal, 0)::bigint illegal,
  coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(left(e.best.lines, length(e.best.lines) - 1), '')) repaired_sha256
from c left join n on n.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op13_turn_repair": _TURNS, "op5_exact_dedup": _EXACT, "op6_near_dedup": _NEAR, "op8_url_asof": _URL}
