"""DuckDB SQL for the registered queries, put together from shared common table expressions."""

from __future__ import annotations

from ..operators.evaluate import CATEGORIES
from .queries import GRID


def _r(x: str, n: int = 6) -> str:
    return f"floor(({x}) * 1e{n}::double + 0.5::double) / 1e{n}::double"


def _chunks(name: str = "ch", size: int = 512, overlap: int = 64) -> str:
    step = size - overlap
    return f"""{name}_w as (
      select doc_id, i * {step} s, substr(text, i * {step} + 1, {size}) t, length(text) n
      from (select doc_id, text, unnest(range(0, greatest(cast(ceil((length(text) - {size}) / {step}::double) as bigint), 0) + 1)) i from documents where regexp_matches(text, '\\S'))
    ), {name} as materialized (
      select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as integer) chunk_index, t as text, cast(s as integer) start_char, cast(least(s + {size}, n) as integer) end_char
      from {name}_w where regexp_matches(t, '\\S')
    )"""


TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
Q = "q as (select item_id query_id, text query, text answer, case when item_id % 3 = 0 then 'multi_hop' else 'simple' end difficulty, 'passage|t' || (item_id % 4) tags from benchmark)"
QA = """qa as (
  select conv_id * 1000 + turn query_id, text query, answer, case when turn = 0 then 'simple' else 'multi_hop' end difficulty
  from (select *, lead(role) over w next_role, lead(text) over w answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant'
)"""
# runs of Han stand apart from other letters, and are cut to pairs
HAN_TERMS = "flatten(list_transform(regexp_extract_all(lower(regexp_replace({}, '([一-鿿]+)', chr(1) || '\\1' || chr(1), 'g')), '[\\p{{L}}\\p{{N}}]+'), lambda r: case when regexp_matches(r, '^[一-鿿]') then list_transform(range(1, greatest(length(r), 2)), lambda i: substr(r, i, 2)) else [r] end))"
INDEX = f"""{_chunks()}, tk as (select doc_id, chunk_index, unnest({TERMS.format("text")}) term from ch),
post as materialized (select term, doc_id, chunk_index, count(*) tf from tk group by all),
cl as materialized (select doc_id, chunk_index, len({TERMS.format("text")}) dl from ch),
cs as (select count(*) n_chunks, avg(dl) avgdl from cl),
tr as (select term, count(*) df, ln((select n_chunks from cs) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) raw from post group by term),
ts as materialized (select term, df, case when raw < 0 then 0.25::double * (select avg(raw) from tr) else raw end idf from tr)"""


def _bm25(k: int) -> str:
    return f"""{INDEX}, {Q}, qt as (select query_id, term, count(*) qtf from (select query_id, unnest({TERMS.format("query")}) term from q) group by all),
raw as (
  select query_id, doc_id, chunk_index, sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (select avgdl from cs)))) raw
  from qt join post using (term) join ts using (term) join cl using (doc_id, chunk_index) group by all
), sc as (select query_id, doc_id, chunk_index, {_r("raw / case when m > 0 then m else 1 end")} score from (select *, max(raw) over (partition by query_id) m from raw)),
sp as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index) rank from sc) where rank <= {k})"""


def _vector(rows: str, key: str, name: str) -> str:
    """Hashed unit vectors as lists, by key."""
    return f"""{name}_b as (select {key}, ('0x' || substr(md5(term), 1, 7))::bigint % 64 b, count(*)::double n from (select {key}, unnest({TERMS.format("text")}) term from {rows}) group by all),
{name}_u as (select *, n / sqrt(sum(n * n) over (partition by {key})) v from {name}_b),
{name} as materialized (select r.*, list_transform(range(0, 64), lambda d: coalesce(m.m[d], 0::double)) e from {rows} r left join (select {key}, map_from_entries(list((b, v))) m from {name}_u group by all) m using ({key}))"""


SENT_LIST = "list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
SENT = f"ss as (select doc_id, {SENT_LIST} l from documents), s as materialized (select doc_id, unnest(range(0, len(l))) pos, unnest(l) as text from ss)"
SIM = f"{SENT}, {_vector('s', 'doc_id, pos', 'sv')}, sim as (select doc_id, pos, text, e, lead(e) over w nx, lead(pos) over w np from sv window w as (partition by doc_id order by pos)), adj as (select doc_id, pos, text, case when np is null then null when list_sum(list_transform(e, lambda x: x * x)) > 0 and list_sum(list_transform(nx, lambda x: x * x)) > 0 then {_r('list_dot_product(e, nx) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(nx, nx)))')} else 0 end similarity from sim)"

SEGMENTS = f"{SIM}, ct as (select *, coalesce((lag(similarity) over (partition by doc_id order by pos) < 0.1)::int, 0) c from adj), sr as (select *, sum(c) over (partition by doc_id order by pos rows unbounded preceding) segment from ct), sg as materialized (select doc_id, segment::bigint segment, string_agg(text, '' order by pos) as text from sr group by doc_id, segment)"


def _fold(smallest: int = 100, largest: int = 1024) -> str:
    """fc (doc_id, chunk_index, text): the segments of sg folded one by one, all documents at once in each turn."""
    cut = f"list_transform(range(0, ceil(length({{0}}) / {largest}::double)::bigint), lambda k: substr({{0}}, k * {largest} + 1, {largest}))"
    return f"""fn as materialized (select doc_id, row_number() over (partition by doc_id order by segment) i, text t from sg where text <> ''),
fo(doc_id, i, held, outs) as (
  select distinct doc_id, 0::bigint, '', cast([] as varchar[]) from fn
  union all
  select doc_id, i, substr(h, n * {largest} + 1), case when whole then [held] else cast([] as varchar[]) end || list_transform(range(0, n), lambda k: substr(h, k * {largest} + 1, {largest})) from (
    select *, greatest(ceil(length(h) / {largest}::double)::bigint - 1, 0) n from (
      select fo.doc_id, fn.i, held, length(held) >= {smallest} whole, case when length(held) >= {smallest} then t else held || t end h from fo join fn on fn.doc_id = fo.doc_id and fn.i = fo.i + 1))
), fl as (select doc_id, flatten(list(outs order by i)) done, arg_max(held, i) held from fo group by doc_id),
ft as (select doc_id, case when held = '' then done when length(held) < {smallest} and len(done) > 0 then done[1:len(done) - 1] || {cut.format("(done[len(done)] || held)")} else done || [held] end parts from fl),
fc as (select doc_id, unnest(range(0, len(p)))::int chunk_index, unnest(p) as text from (select doc_id, list_filter(parts, lambda x: regexp_matches(x, '\\S')) p from ft))"""


DENSE = f"""{_vector("ch", "doc_id, chunk_index", "cv")}, qr as (select query_id, query as text from q), {_vector("qr", "query_id", "qv")},
de as materialized (
  select * from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index) rank from (
    select query_id, doc_id, chunk_index, {_r("list_dot_product(cv.e, qv.e)")} score from qv, cv)) where rank <= 20
)"""
FUSED = f"""{_bm25(20)}, {DENSE}, fu as materialized (
  select * from (select *, row_number() over (partition by query_id order by score desc, dense_rank nulls last, sparse_rank) rank from (
    select query_id, doc_id, chunk_index, {_r("coalesce(1::double / (60 + a.rank), 0) + coalesce(1::double / (60 + b.rank), 0)", 9)} score, a.rank dense_rank, b.rank sparse_rank
    from de a full outer join sp b using (query_id, doc_id, chunk_index))) where rank <= 10
)"""
RERANKED = f"""{FUSED}, rr as materialized (
  select query_id, doc_id, chunk_index, score, row_number() over (partition by query_id order by score desc, before) rank from (
    select query_id, doc_id, chunk_index, fu.rank before, {_r(f"case when len(list_distinct({TERMS.format('query')})) > 0 then len(list_intersect(list_distinct({TERMS.format('query')}), {TERMS.format('ch.text')}))::double / len(list_distinct({TERMS.format('query')})) else 0 end")} score
    from fu join q using (query_id) join ch using (doc_id, chunk_index))
)"""

RULES = """rc as (
  select p_partkey doc_id, '**规则P' || p_partkey || '：条目**' || chr(10) || '- 适用条件：' || p_type || ' 且数量不少于' || p_size || '。' || chr(10) || '- 规定：' || p_brand || '须提前申报登记。' || chr(10)
    || case when p_partkey % 4 = 0 then repeat('补充说明', 40) else '' end || chr(10) || '- 关联规则：参见规则P' || (p_partkey * 7 + 1) % (select count(*) from part) || '。如果' || p_brand || '已登记则需要' || p_type || '审批。' as text from part
), sec as (
  select doc_id, unnest(range(0, len(l))) section, unnest(l) as text from (
    select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(\\*\\*规则[A-Z]\\d+)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 20) l from rc)
), rn as materialized (
  select doc_id || ':0:' || section node_id, substr(text, 1, 200) as text, doc_id, 0 chunk_index, coalesce(nullif(regexp_extract(text, '规则([A-Z]\\d+)', 1), ''), doc_id || ':0:' || section) rule_id, section, text whole from sec
)"""
_ASKED = "q as (select p_partkey query_id, p_type || ' 且数量不少于' || p_size || ' P' || p_partkey query from part where p_partkey % 20 = 0)"
_END = "((?s:.)[^。\\n]*)"


def _found(name: str, kind: str, patterns: list[str]) -> str:
    parts = " union all ".join(f"select node_id src, doc_id, section, {k} pattern, regexp_extract_all(whole, '{p}', 1) l from rn" for k, p in enumerate(patterns))
    return f"""{name} as materialized (
  select src || ':{kind}:' || pattern || ':' || m node_id, src, doc_id, section, pattern, m, substr(t, 1, 200) as text from (
    select *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) t from (select src, doc_id, section, pattern, unnest(range(0, len(l))) m, unnest(l) raw from ({parts}))) where length(t) > 5
)"""


CONDITIONS = _found("cn", "con", [f"条件[：:]\\s*{_END}", "(?s)如果(.+?)则", "(?s)当(.+?)时", f"适用条件[：:]\\s*{_END}", f"前提[：:]\\s*{_END}"])
CONCLUSIONS = _found("kn", "end", [f"则{_END}", f"需要{_END}", f"要求{_END}", f"规定[：:]\\s*{_END}", f"须{_END}"])
REFS = """rf as materialized (
  select r.src, t.dst, r.pattern, r.m, r.doc_id, r.section from (
    select src, doc_id, section, rule_id, min(pattern) pattern, min(m) m from (
      select src, doc_id, section, pattern, unnest(range(0, len(l))) m, unnest(l) rule_id from (
        select node_id src, doc_id, section, 0 pattern, regexp_extract_all(text, '参见规则([A-Z]\\d+)', 1) l from rn
        union all select node_id, doc_id, section, 1, regexp_extract_all(text, '关联规则[：:].+?规则([A-Z]\\d+)', 1) from rn
        union all select node_id, doc_id, section, 2, regexp_extract_all(text, '详见([A-Z]\\d+)', 1) from rn)) group by all) r
  join (select rule_id, arg_max(node_id, [doc_id, section]) dst from rn group by rule_id) t using (rule_id)
)"""
EDGES = """ed as materialized (
  select src, node_id dst, 'requires' relation_type, 1::double weight, [1, pattern, m] o from cn union all select src, node_id, 'leads_to', 0.8::double, [2, pattern, m] from kn
  union all select src, dst, 'requires', 0.9::double, [3, pattern, m] from rf
)"""
GRAPH = f"{RULES}, {CONDITIONS}, {CONCLUSIONS}, {REFS}, {EDGES}"


def _paths(hits: str) -> str:
    """Walks of up to two hops from the chunks of hits (query_id, doc_id, score, rank)."""
    return f"""h as materialized ({hits}),
nd as materialized (select node_id, doc_id, 0 k, 0 p, 0 m from rn union all select node_id, doc_id, 1, pattern, m from cn union all select node_id, doc_id, 2, pattern, m from kn),
p0 as (select h.query_id, n.node_id node, h.score, [h.rank, n.k, n.p, n.m] o from h join nd n using (doc_id)),
a1 as (select p0.query_id, e.dst node, {_r("p0.score * 0.7::double * e.weight", 9)} score, p0.node || '>' || e.dst nodes, e.relation_type relations, p0.o || e.o o from p0 join ed e on e.src = p0.node),
i1 as materialized (select *, coalesce(greatest((select max(z.score) from p0 z where z.query_id = a.query_id and z.node = a.node), max(score) over w), -1) < score improved from (select * from a1 where score >= 0.1) a
  window w as (partition by query_id, node order by o rows between unbounded preceding and 1 preceding)),
s1 as materialized (select query_id, node, max(score) score from (select query_id, node, score from p0 union all select query_id, node, score from i1) group by all),
a2 as (select i1.query_id, e.dst node, {_r("i1.score * 0.7::double * e.weight", 9)} score, i1.nodes || '>' || e.dst nodes, i1.relations || '>' || e.relation_type relations, i1.o || e.o o from i1 join ed e on e.src = i1.node where improved),
i2 as materialized (select a.*, coalesce(greatest(z.score, max(a.score) over w), -1) < a.score improved from (select * from a2 where score >= 0.1) a left join s1 z on z.query_id = a.query_id and z.node = a.node
  window w as (partition by a.query_id, a.node order by a.o rows between unbounded preceding and 1 preceding)),
pa as (select *, 1 hops from i1 union all select *, 2 hops from i2)"""


PATHS = f"{GRAPH}, {_paths('select doc_id query_id, doc_id, 0.5::double + (doc_id % 5) / 10::double score, 1 rank from rc')}"
EXPANDED = f"""{PATHS}, fa as (
  select pa.query_id, n.doc_id, arg_min(pa.score, [[hops], o]) score, min([[hops], o]) place from pa join nd n on n.node_id = pa.node where improved group by all
), ex as (select * from (select *, row_number() over (partition by query_id order by score desc, place) rank from fa where query_id <> doc_id) where rank <= 5)"""

RULE_RANKED = f"{RULES}, ch as materialized (select doc_id, 0 chunk_index, text from rc), {RERANKED[RERANKED.index(' tk as (') + 1:].replace(Q, _ASKED)}".replace(TERMS.format("text"), HAN_TERMS.format("text")).replace(TERMS.format("query"), HAN_TERMS.format("query")).replace(TERMS.format("ch.text"), HAN_TERMS.format("ch.text"))
EVID = f"{_bm25(5)}, ev as materialized (select sp.*, ch.text, sp.doc_id || ':' || sp.chunk_index chunk_id from sp join ch using (doc_id, chunk_index))"
CITED = "ci as (select query_id, list_sort(list(chunk_id)) cited from ev where rank <= 2 group by query_id)"
# by shape of the response: prose without JSON; an object inside prose; two objects, the first counts; an object with prose after it; a
# null confidence and a list are errors; an object without answer and confidence; a block that is no JSON; an object alone
PARSED = f"""{EVID}, {CITED}, ps as (select query_id,
  case query_id % 14 when 0 then 'no json here' when 3 then 'x' || query_id when 4 then 'error' when 5 then 'error' when 6 then '' when 7 then '{{not: json}} at all' when 9 then 'q' || query_id when 11 then '' when 12 then '' when 13 then 'True' else 'a' || query_id end answer,
  case when query_id % 14 in (1, 2, 6, 8) then cited when query_id % 14 = 11 then string_split('c' || query_id, '') when query_id % 14 = 12 then ['k' || query_id, 'b'] else cast([] as varchar[]) end cited,
  case query_id % 14 when 0 then 0.3::double when 3 then 0.3::double when 4 then 0::double when 5 then 0::double when 6 then 0.5::double when 7 then 0.3::double when 9 then 0.25::double when 10 then 1::double when 11 then 0.5::double when 12 then 0.5::double when 13 then 0.5::double else (query_id % 10) / 10::double end confidence from ci)"""
RESULTS = f"""{QA}, rs as materialized (
  select query_id, query, answer, case when query_id % 3 <> 0 then case when query_id % 2 = 0 then repeat('.', 190) else '' end || answer || ' end' else '' end told,
    {_r("case when query_id % 3 <> 0 then (query_id % 11) / 11::double else 0 end", 4)} confidence, {_r("case when query_id % 3 <> 0 then query_id % 97 + 0.125::double else 0 end", 2)} latency_ms,
    case when query_id % 3 <> 0 then query_id || '|x' else '' end cited_chunks, difficulty from qa
), rh as (select * exclude (answer, told), substr(answer, 1, 200) reference, substr(told, 1, 200) predicted_answer, trim(substr(answer, 1, 30), ' ' || chr(10)) <> '' and contains(told, trim(substr(answer, 1, 30), ' ' || chr(10))) is_hit from rs)"""
PRF = f"""{QA}, tp as (select query_id, difficulty, list_distinct({TERMS.format("query")}) p, list_distinct({TERMS.format("answer")}) r, query = answer exact from qa),
pr as materialized (select query_id, difficulty, exact, case when len(p) = 0 and len(r) = 0 then 1 when len(p) = 0 or len(r) = 0 then 0 else len(list_intersect(p, r))::double / len(p) end "precision",
  case when len(p) = 0 and len(r) = 0 then 1 when len(p) = 0 or len(r) = 0 then 0 else len(list_intersect(p, r))::double / len(r) end recall from tp)"""
ERRORS = f"""{EVID}, er as (
  select q.query_id, coalesce(a.predicted, '') predicted, coalesce(a.confidence, 0) confidence, {_r("coalesce(a.avg, 0)", 4)} avg_score, coalesce(a.n_hits, 0) n_hits, q.answer reference, q.query, q.difficulty, q.tags
  from q left join (select query_id, count(*) n_hits, avg(score) avg, arg_min(substr(text, 1, 200), rank) predicted, arg_min(score, rank) confidence from ev group by query_id) a using (query_id)
), ec as (
  select query_id, query, reference, difficulty, tags, predicted, confidence, avg_score, n_hits, case when length(predicted) < 5 then 'generation_error' when n_hits = 0 then 'no_evidence' when confidence < 0.3 then 'low_confidence'
    when case when reference = '' then 0 else len(list_intersect(list_distinct(string_split(substr(reference, 1, 50), '')), list_distinct(string_split(substr(predicted, 1, 100), ''))))::double / len(list_distinct(string_split(substr(reference, 1, 50), ''))) end < 0.3 then 'wrong_evidence'
    else 'correct' end category from er
)"""


def _grid() -> str:
    sizes, overlaps, ks = GRID
    pairs = [(s, o) for s in sizes for o in overlaps if o < s]
    parts, rows = [], []
    for n, (s, o) in enumerate(pairs):
        parts.append(_chunks(f"c{n}", s, o))
        rows.append(f"select {n} pair, {s} chunk_size, {o} overlap, doc_id, chunk_index, text from c{n}")
    kk = ", ".join(f"({k})" for k in ks)
    return f"""{", ".join(parts)}, {Q}, gc as materialized ({" union all ".join(rows)}),
post as materialized (select pair, term, doc_id, chunk_index, count(*) tf from (select pair, doc_id, chunk_index, unnest({TERMS.format("text")}) term from gc) group by all),
cl as materialized (select pair, doc_id, chunk_index, len({TERMS.format("text")}) dl from gc), cs as materialized (select pair, count(*) n_chunks, avg(dl) avgdl from cl group by pair),
tr as (select pair, term, count(*) df, ln(any_value(n_chunks) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) raw from post join cs using (pair) group by all),
ts as materialized (select tr.pair, term, case when raw < 0 then 0.25::double * m else raw end idf from tr join (select pair, avg(raw) m from tr group by pair) x on x.pair = tr.pair),
qt as (select query_id, term, count(*) qtf from (select query_id, unnest({TERMS.format("query")}) term from q) group by all),
raw as (select pair, query_id, doc_id, chunk_index, sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) raw
  from qt join post using (term) join ts using (pair, term) join cl using (pair, doc_id, chunk_index) join cs using (pair) group by all),
sc as (select pair, query_id, doc_id, chunk_index, {_r("raw / case when m > 0 then m else 1 end")} score from (select *, max(raw) over (partition by pair, query_id) m from raw)),
sp as (select * from (select *, row_number() over (partition by pair, query_id order by score desc, doc_id, chunk_index) rank from sc) where rank <= {max(ks)}),
told as (select pair, query_id, rank, score, len(list_filter(list_distinct(list_filter(string_split_regex(substr(answer, 1, 50), '\\s+'), lambda w: w <> '')), lambda w: contains(substr(gc.text, 1, 100), w))) > 0 hit
  from sp join gc using (pair, doc_id, chunk_index) join q using (query_id)),
gr as (
  select c.chunk_size || '_' || c.overlap || '_' || k.k config, c.chunk_size, c.overlap, k.k top_k,
    {_r("coalesce((select count(distinct query_id) from told t where t.pair = c.pair and t.rank <= k.k and t.hit) / (select count(*) from q)::double, 0)", 4)} hit_rate,
    {_r("coalesce((select sum(score) from told t where t.pair = c.pair and t.rank = 1) / (select count(*) from q)::double, 0)", 4)} avg_score, cs.n_chunks
  from (select distinct pair, chunk_size, overlap from gc) c join cs using (pair), (values {kk}) k(k)
)"""


def _abl() -> str:
    one = "select '{n}' config, query_id, doc_id, chunk_index, score, rank from {t} where rank <= 5"
    rows = " union all ".join(one.format(n=n, t=t) for n, t in (("sparse", "sp"), ("dense", "de"), ("hybrid", "fu"), ("hybrid_rerank", "rr"), ("hybrid_rerank_graph", "rr")))
    key = "trim(substr(answer, 1, 30), ' ' || chr(10))"
    return f"""with {RERANKED}, al as materialized ({rows}), af as (select config, query_id, string_agg(text, ' ' order by rank) found, max(case when rank = 1 then score end) top from al join ch using (doc_id, chunk_index) group by all)
select n.config, {_r(f"avg(case when {key} <> '' and coalesce(contains(found, {key}), false) then 1::double else 0 end)", 4)} hit_rate, {_r("avg(coalesce(top, 0))", 4)} avg_top_score, count(*) n_queries
from (select distinct config from al) n cross join q left join af on af.config = n.config and af.query_id = q.query_id group by n.config"""


_LABEL = "'chunk_' || lpad(chunk_index::varchar, greatest(4, length(chunk_index::varchar))::integer, '0') chunk_id"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PIECES = "d as (select doc_id, regexp_extract_all(text, '\\s*(?:[一-鿿]+|[a-zA-Z0-9]+|[^\\s])') l from documents where regexp_matches(text, '\\S'))"
_KEY = "trim(substr(answer, 1, 30), ' ' || chr(10))"
_NAMES = ", ".join(f"('{c}', '{t}')" for c, t in CATEGORIES.items())
SQL: dict[str, str] = {
    "chunk_chars": f"with {_chunks()} select *, 'chunk_' || lpad(chunk_index::varchar, greatest(4, length(chunk_index::varchar))::integer, '0') chunk_id from ch",
    "tokenize_offsets": f"with {_PIECES}, p as (select doc_id, unnest(range(0, len(l)))::int pos, unnest(l) piece from d), e as (select doc_id, pos, ltrim(piece, {_WS}) token, sum(length(piece)) over (partition by doc_id order by pos)::int e from p) select doc_id, pos, token, e - length(token)::int as start, e as \"end\" from e",
    "split_sentences": f"with {SENT} select * from s",
    "adjacent_similarity": f"with {SIM} select doc_id, pos, {_r('similarity')} similarity from adj where similarity is not null",
    "semantic_segments": f"with {SEGMENTS} select doc_id, segment, text from sg",
    "enforce_chunk_sizes": f"with recursive {SEGMENTS}, {_fold()} select *, {_LABEL} from fc",
    "chunk_semantic": f"with recursive {SEGMENTS.replace('from documents)', 'from documents where length(text) > 100)', 1)}, {_fold()}, sn as (select doc_id, {SENT_LIST} l, trim(text, {_WS}) t, length(text) n from documents where regexp_matches(text, '\\S')) select doc_id, chunk_index, text, null::int sentence_count, length(text)::int char_count, {_LABEL} from fc semi join (select doc_id from sn where len(l) > 1) using (doc_id) union all select doc_id, 0, t, len(l)::int, null, 'chunk_0000' from sn where len(l) <= 1 or n <= 100",
    "terms": f"with {INDEX} select term, sum(tf)::bigint n from post group by term",
    "postings": f"with {INDEX} select * from post",
    "chunk_lengths": f"with {INDEX} select * from cl",
    "corpus_stats": f"with {INDEX} select n_chunks, {_r('avgdl')} avgdl from cs",
    "term_stats": f"with {INDEX} select term, df, {_r('idf')} idf from ts",
    "embed_text": f"with {_chunks()}, {_vector('ch', 'doc_id, chunk_index', 'v')} select doc_id, chunk_index, b::int dim, {_r('v')} as value from v_u",
    "normalize_vectors": f"select vec_id, unnest(range(0, len(e)))::int dim, unnest(list_transform(e, lambda x: {_r('x / n')})) as value from (select vec_id, e, sqrt(list_dot_product(e, e)) n from (select vec_id, list_transform(embedding, lambda x: x::double * 3) e from embeddings))",
    "build_indices": f"with {INDEX} select 'chunks' as name, count(*) n from ch union all select 'postings', count(*) from post union all select 'terms', count(*) from ts union all select 'vectors', count(*) from ch union all select 'nodes', (select count(*) from ch where length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 20)",
    "bm25_search": f"with {_bm25(20)} select * from sp",
    "segmented_search": f"with {_bm25(20)} select * from sp",
    "cached_search": f"with {_bm25(20)} select *, 0::bigint scored_again from sp",
    "bm25_padded": f"with {_bm25(500)}, n as (select q.query_id, count(sp.rank) n from q left join sp using (query_id) group by all), fl as (select n.query_id, c.doc_id, c.chunk_index, n.n, row_number() over (partition by n.query_id order by c.doc_id, c.chunk_index) r from n cross join ch c where n.n < 500 and not exists (select 1 from sp where sp.query_id = n.query_id and sp.doc_id = c.doc_id and sp.chunk_index = c.chunk_index)) select query_id, doc_id, chunk_index, score, rank from sp union all select query_id, doc_id, chunk_index, 0::double, r + n from fl where r + n <= 500",
    "dense_search": f"select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from (select a.vec_id query_id, b.vec_id doc_id, 0 chunk_index, {_r('list_dot_product(a.embedding::double[], b.embedding::double[])')} score from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 20",
    "dedupe_queries": f"with {QA} select query_id, min(query_id) over (partition by query) first_id from qa",
    "rrf_fuse": f"with {FUSED} select * from fu",
    "rerank": f"with {RERANKED} select * from rr",
    "retrieve_batch": f"with {RERANKED} select *, false expanded_via_graph from rr where rank <= 5",
    "line_match": f"with {Q}, w as (select query_id, list_distinct(list_filter(string_split_regex(regexp_replace(query, '[？?]', '', 'g'), '\\s+'), lambda x: x <> '')) w from q), l as materialized (select doc_id, unnest(range(0, len(x))) pos, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents)), m as (select query_id, doc_id, pos, line, len(list_filter(w, lambda x: contains(line, x))) n from w, l), b as (select query_id, n, line, row_number() over (partition by query_id order by n desc, doc_id, pos) r from m) select query_id, n::int n_words, case when n = 0 then '' else substr(line, 1, 200) end line from b where r = 1",
    "rule_nodes": f"with {RULES} select node_id, text, doc_id, chunk_index, rule_id from rn",
    "rule_conditions": f"with {RULES}, {CONDITIONS} select node_id, text, src, 1::double weight from cn",
    "rule_conclusions": f"with {RULES}, {CONCLUSIONS} select node_id, text, src, 0.8::double weight from kn",
    "reference_edges": f"with {RULES}, {REFS} select src, dst, 'requires' relation_type, 0.9::double weight from rf",
    "graph_neighbors": f"with {GRAPH}, b0 as (select node_id as start, node_id node, 1::double score, 0 hops from rn), b1 as (select b.start, e.dst node, max({_r('b.score * e.weight', 9)}) score, 1 hops from b0 b join ed e on e.src = b.node group by all), b2 as (select b.start, e.dst node, max({_r('b.score * e.weight', 9)}) score, 2 hops from b1 b join ed e on e.src = b.node group by all), al as (select * from b0 union all select * from b1 where score >= 0.1 union all select * from b2 where score >= 0.1) select start, node, max(score) score, arg_min(hops, [-score, hops]) hops from al group by start, node",
    "graph_subgraph": f"with {GRAPH} select 'edge' kind, src, dst, weight from ed where dst in (select node_id from rn union all select node_id from cn) union all select 'node', node_id, null, null from (select node_id from rn union all select node_id from cn)",
    "chunk_nodes": f"with {GRAPH} select * from (select node_id, 'rule' as type, text, doc_id from rn union all select node_id, 'condition', text, doc_id from cn union all select node_id, 'conclusion', text, doc_id from kn)",
    "reference_edges_whole": f"with {RULES}, {REFS.replace('(text,', '(whole,')} select src, dst, 'requires' relation_type, 0.9::double weight from rf",
    "retrieve_rules": f"with {RULE_RANKED}, {CONDITIONS}, {CONCLUSIONS}, {REFS}, {EDGES}, {_paths('select query_id, doc_id, score, rank from rr where rank <= 5')}, fa as (select pa.query_id, n.doc_id, arg_min(pa.score, [[hops], o]) score, min([[hops], o]) place from pa join nd n on n.node_id = pa.node where improved and (pa.query_id, n.doc_id) not in (select (query_id, doc_id) from rr) group by all), ex as (select * from (select *, row_number() over (partition by query_id order by score desc, place) rank from fa) where rank <= 5), al as (select query_id, doc_id, score, false x, rank from rr union all select query_id, doc_id, score, true, rank from ex) select * from (select query_id, doc_id, 0 chunk_index, score, x expanded_via_graph, row_number() over (partition by query_id order by score desc, x, rank) rank from al) where rank <= 5",
    "retrieve_rules_plain": f"with {RULE_RANKED} select query_id, doc_id, chunk_index, score, false expanded_via_graph, rank from rr where rank <= 5",
    "chunk_tokens": f"with {_PIECES}, w as (select doc_id, l, unnest(range(0, greatest(ceil((len(l) - 128) / 112::double)::bigint, 0) + 1)) k from d) select doc_id, k::int chunk_index, 'chunk_' || lpad(k::varchar, 4, '0') chunk_id, ltrim(array_to_string(l[k * 112 + 1:k * 112 + 128], ''), {_WS}) as text, (k * 112)::int start_token, least(k * 112 + 128, len(l))::int end_token, (least(k * 112 + 128, len(l)) - k * 112)::int token_count from w",
    "graph_stats": f"with {GRAPH} select 'chunks' as name, count(*) n from rc union all select 'node rule', count(*) from rn union all select 'node condition', count(*) from cn union all select 'node conclusion', count(*) from kn union all select 'edge ' || relation_type, count(*) from ed group by relation_type",
    "graph_paths": f"with {PATHS} select query_id, nodes, relations, score, hops from pa",
    "expanded_chunks": f"with {EXPANDED} select query_id, doc_id, score, rank from ex",
    "merge_expanded": f"with {EXPANDED}, al as (select query_id, doc_id, score, false x, 1 rank, length(text) n_chars from h join rc using (doc_id) union all select ex.query_id, ex.doc_id, ex.score, true, ex.rank, length(rn.text) from ex join rn using (doc_id)) select query_id, doc_id, score, x expanded_via_graph, row_number() over (partition by query_id order by score desc, x, rank) rank, n_chars from al",
    "evidence_prompt": f"with {EVID}, pt as (select query_id, count(*) n, string_agg('[证据' || rank || '] ID: ' || chunk_id || chr(10) || '内容: ' || text || chr(10), chr(10) order by rank) e from ev group by query_id) select q.query_id, coalesce(n, 0) n_evidence, md5(case when e is null then '抱歉，没有找到相关的证据。' else e || chr(10) || '问题: ' || query end) prompt_md5 from q left join pt using (query_id)",
    "parse_responses": f"with {PARSED} select query_id, answer, array_to_string(cited, '|') cited, confidence from ps",
    "confidence_gate": f"with {PARSED}, f as (select query_id, list(chunk_id) ids, count(*) n, avg(case when rank <= 3 then score end) top from ev group by query_id), g as (select query_id, {_r('greatest(0::double, least(1::double, 0.4::double * confidence + 0.3::double * coalesce(len(list_intersect(cited, ids))::double / n, 0) + 0.3::double * greatest(0::double, least(1::double, coalesce(top, 0)))))')} confidence from ps left join f using (query_id)), h as (select *, printf('%.2f', {_r('confidence', 2)}) s from g) select query_id, confidence, confidence < 0.4 should_clarify, case when confidence < 0.4 then '答案置信度较低（' || s || '），请提供更具体的问题。' end clarification, case when confidence >= 0.4 and confidence < 0.7 then '答案置信度为 ' || s || '，请验证关键信息。' end warning from h",
    "hit_at_k": f"with {EVID}, f as (select query_id, string_agg(text, ' ' order by rank) found from ev group by query_id) select query_id, {_KEY} <> '' and coalesce(contains(found, {_KEY}), false) is_hit from q left join f using (query_id)",
    "keyword_hit": f"with {EVID}, f as (select query_id, string_agg(substr(text, 1, 100), ' ' order by rank) found from ev group by query_id) select query_id, coalesce(len(list_filter(list_filter(string_split_regex(substr(answer, 1, 50), '\\s+'), lambda w: w <> ''), lambda w: contains(found, w))) > 0, false) is_hit from q left join f using (query_id)",
    "eval_rows": f"with {RESULTS} select * from rh",
    "run_summary": f"with {RESULTS} select count(*) total, {_r('coalesce(avg(is_hit::int::double), 0)', 4)} hit_rate, {_r('coalesce(avg(confidence), 0)', 4)} avg_confidence, {_r('coalesce(avg(latency_ms), 0)', 2)} avg_latency_ms from rh",
    "token_prf": f"with {PRF} select query_id, {_r('\"precision\"')} as precision, {_r('recall')} recall, exact from pr",
    "bucket_metrics": f"with {PRF}, g as (select case when grouping(difficulty) = 1 then 'overall' else difficulty end bucket, count(*) n, avg(\"precision\") p, avg(recall) r, avg(exact::int::double) e from pr group by rollup (difficulty)) select bucket, n, {_r('p', 4)} as precision, {_r('r', 4)} recall, {_r('case when p + r > 0 then 2 * p * r / (p + r) else 0 end', 4)} f1, {_r('e', 4)} exact_match from g",
    "bucket_counts": f"with {QA} select difficulty, count(*) n from qa group by difficulty",
    "error_rows": f"with {ERRORS}, nm(category, description) as (values {_NAMES}) select query_id, substr(query, 1, 100) query, substr(reference, 1, 100) reference, substr(predicted, 1, 100) predicted, difficulty, tags, n_hits, avg_score, {_r('confidence', 4)} confidence, category, description from ec join nm using (category)",
    "error_summary": f"with {ERRORS}, t as (select count(*) n from ec), c as (select x.category, count(ec.query_id) n from (values ('correct'), ('generation_error'), ('low_confidence'), ('no_evidence'), ('wrong_evidence')) x(category) left join ec using (category) group by x.category union all select 'total', n from t) select category, n, {_r('case when (select n from t) > 0 then 100::double * n / (select n from t) else 0 end', 2)} percent from c",
    "read_corpus": "select item_id, text from benchmark where text <> ''",
    "read_queries": f"with {Q} select query, case when query_id % 3 = 1 then '' else answer end answer, '' reasoning_chain, case when query_id % 4 = 0 then 'unknown' else difficulty end difficulty, case when query_id % 5 = 0 then '' else tags end tags from q",
    "stored_tables": f"with {INDEX} select ts.term, df, {_r('idf')} idf, sum(tf)::bigint n, sum(dl)::bigint chunk_terms, (select n_chunks from cs) n_chunks from ts join post using (term) join cl using (doc_id, chunk_index) group by ts.term, df, idf",
    "results_csv": f"with {RESULTS} select * from rh",
    "exported_graph": f"with {GRAPH} select 'edge' kind, src, dst, relation_type \"type\", null as text, weight, to_json(o)::varchar ord from (select * replace ([doc_id, 0, section] || o as o) from (select ed.*, coalesce(r.doc_id, 0) doc_id, coalesce(r.section, 0) section from ed join rn r on r.node_id = ed.src)) union all select 'node', node_id, null, t, text, null, to_json(o)::varchar from (select node_id, 'rule' t, text, [doc_id, 0, section, 0, 0, 0] o from rn union all select node_id, 'condition', text, [doc_id, 0, section, 1, pattern, m] from cn union all select node_id, 'conclusion', text, [doc_id, 0, section, 2, pattern, m] from kn)",
    "grid_search": f"with {_grid()} select * from gr",
    "best_config": f"with {_grid()} select * from gr order by hit_rate desc, chunk_size, overlap, top_k limit 1",
    "ablation": _abl(),
}
