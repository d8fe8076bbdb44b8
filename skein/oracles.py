"""DuckDB SQL for the queries of skein.queries, over the same tables."""

from skein.queries import PROMPTS

_prompts = "(select * from (values " + ", ".join(f"({i}::bigint, '{p}')" for i, p in PROMPTS) + ") t(query_id, prompt))"

_nodes = """(
  select p_partkey::bigint seq, 'part-' || p_partkey id, p_name as name, 'database' as type, 'low_level' as level, p_brand || ' ' || p_type description, [p_type] tags from part
  union all select 1000000000000 + s_suppkey, 'supplier-' || s_suppkey, s_name, 'database', 'low_level', 'supplier of parts', []::varchar[] from supplier
  union all select 2000000000000 + n_nationkey, 'nation-' || n_nationkey, n_name, 'theme', 'high_level', 'a nation', []::varchar[] from nation
  union all select 3000000000000 + r_regionkey, 'region-' || r_regionkey, r_name, 'theme', 'high_level', 'a region of nations', []::varchar[] from region)"""

_edges = """(
  select distinct l_partkey::bigint * 1000000000 + l_suppkey seq, 'part-' || l_partkey source, 'supplier-' || l_suppkey target, 'supplied_by' relation from lineitem
  union all select s_suppkey::bigint * 1000000000 + s_nationkey + 1152921504606846976, 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'belongs_to' from supplier
  union all select n_nationkey::bigint * 1000000000 + n_regionkey + 2305843009213693952, 'nation-' || n_nationkey, 'region-' || n_regionkey, 'belongs_to' from nation)"""

_scored = f"""
nodes as {_nodes}, prompts as {_prompts},
tok as (select query_id, list_filter(string_split_regex(lower(prompt), '\\s+'), lambda t: length(t) > 2) tokens from prompts),
hay as (select *, lower(concat_ws(' ', name, description, array_to_string(tags, ' '))) tx, lower(name) nm from nodes),
scored as (select query_id, h.*, list_sum(list_concat([0], list_transform(tokens, lambda t: (case when contains(tx, t) then 2 else 0 end) + (case when contains(nm, t) then 4 else 0 end))))::int score
  from hay h, tok)"""

_dual = f"""{_scored},
best as (select *, row_number() over (partition by query_id, level order by score desc, seq)::int rank from scored where score > 0),
hits as (select * from best where rank <= case level when 'low_level' then 5 else 3 end),
firsts as (select *, row_number() over (partition by level order by seq)::int rank from nodes),
missed as (select p.query_id, f.* from prompts p, firsts f where f.rank <= case f.level when 'low_level' then 3 else 2 end
  and not exists (select 1 from hits h where h.query_id = p.query_id and h.level = f.level)),
found as (select query_id, level, rank, id, name, type, description, score, false is_fallback from hits
  union all select query_id, level, rank, id, name, type, description, 0, true from missed),
paths as (select distinct f.query_id, e.seq, e.source src, e.target dst, e.relation from {_edges} e, (select distinct query_id, id from found) f where e.source = f.id or e.target = f.id)"""

_fnv = "list_reduce(list_prepend(2166136261::bigint, list_transform(list_filter(string_split(g, ''), lambda c: c <> ''), lambda c: ascii(c)::bigint)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


def _embedding(table: str, key: str) -> str:
    """CTEs that end in emb_<table>(k, dim, val): the hash embedding of a table's text."""
    t = table
    return f"""
w_{t} as (select k, unnest(l) w, generate_subscripts(l, 1) i from (select {key} k, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') l from {t})),
g_{t} as (select k, w g, 1 / sqrt(i) wt from w_{t} union all
  select k, unnest(list_transform(range(1, length(w) - 1), lambda j: substr(w, j, 3))) g, 0.45 / sqrt(i) wt from w_{t} where length(w) >= 3),
h_{t} as (select g, case when h >= 2147483648 then h - 4294967296 else h end h from (select g, {_fnv} h from (select distinct g from g_{t}))),
s_{t} as (select k, (abs(h) % 384)::int dim, sum(case when h > 0 then wt else -wt end) v from g_{t} join h_{t} using (g) group by all),
n_{t} as (select k, sqrt(sum(v * v)) n from s_{t} group by k),
emb_{t} as (select k, dim, round(v / case when n = 0 then 1 else n end, 6) + 0.0 val from s_{t} join n_{t} using (k))"""


def _packed(source: str, limit: int, join: str) -> str:
    """Folds a list s of strings into chunks c of at most ``limit`` characters."""
    pieces = f"list_transform(range(0, greatest(length(b.cur), 1), {limit}), lambda i: substring(b.cur, (i + 1)::int, {limit}))"
    long = f"when length(b.cur) > {limit} then {{'out': list_concat(if(a.cur = '', a.out, list_append(a.out, a.cur)), {pieces}), 'cur': ''}}" if join == "' '" else ""
    gap = 1 if join == "' '" else 2
    return f"""
f as (select doc_id, list_reduce(list_prepend({{'out': []::varchar[], 'cur': ''}}, list_transform(s, lambda z: {{'out': []::varchar[], 'cur': z}})),
  lambda a, b: case {long}
    when a.cur <> '' and length(a.cur) + length(b.cur) + {gap} > {limit} then {{'out': list_append(a.out, a.cur), 'cur': b.cur}}
    else {{'out': a.out, 'cur': if(a.cur = '', b.cur, a.cur || {join} || b.cur)}} end) r from {source}),
o as (select doc_id, if(r.cur = '', r.out, list_append(r.out, r.cur)) c from f)"""


_rotated = """
r as (select list_transform(range(64), lambda i: list_transform(range(64), lambda j: (sin(i * 13.37::double + j * 42.1::double) * 2 - 1) / 8::double)) rot),
e as (select vec_id, embedding::double[] x from embeddings),
n as (select vec_id, x, case when list_dot_product(x, x) = 0 then 1 else sqrt(list_dot_product(x, x)) end nm, rot from e, r),
y as (select *, list_transform(rot, lambda q: list_dot_product(q, list_transform(x, lambda w: w / nm))) y from n),
c as (select *, list_transform(y, lambda v: greatest(-8, least(7, floor(v * 12 + 0.5)::int))) sq from y),
b as (select *, list_transform(range(64), lambda i: sq[i + 1] / 12::double + if(y[i + 1] - sq[i + 1] / 12::double >= 0, 0.02, -0.02)) est from c)"""

_knn = """
q as (select vec_id q_id, embedding::double[] q from embeddings where vec_id % 20 = 0),
cs as (select q_id, vec_id, greatest(-1, least(1, round(list_cosine_similarity(q, embedding::double[]), 4))) sim from q, embeddings),
kd as (select *, round(greatest(0, 1 - sim), 4) distance from cs),
kn as (select *, row_number() over (partition by q_id order by distance, vec_id)::int rank from kd)"""

_tq = f"""{_rotated},
tqq as (select vec_id q_id, list_transform(rot, lambda w: list_dot_product(w, x)) rq from b where vec_id % 20 = 0),
ts as (select q_id, vec_id, greatest(-1, least(1, round(list_dot_product(rq, est), 4))) + 0.0 score from tqq, b),
tn as (select *, row_number() over (partition by q_id order by score desc, vec_id)::int rank from ts)"""

_fused = """rows as (select q_id query_id, vec_id, rank, 0 s from kn where rank <= 20 union all select q_id, vec_id, rank, 1 from tn where rank <= 20),
fused as (select query_id, vec_id, min(s) s, arg_min(rank, s) r, string_agg(case s when 0 then 'graph' else 'vector' end, '+' order by s) sources, sum(1.0::double / (rank + 60)) score from rows group by query_id, vec_id),
placed as (select *, row_number() over (partition by query_id order by round(score, 12) desc, s, r, vec_id)::int rank from fused)"""

_candidates = "rows as (select q_id query_id, vec_id, 'graph' source, rank original_rank, rank::bigint input_seq from kn where rank <= 6 union all select q_id, vec_id, 'vector', rank, rank + 4294967296 from tn where rank <= 6)"

_reranked = f"""{_candidates},
sc as (select *, case when vec_id % 7 > 0 then (vec_id % 11)::double end llm_score from rows),
nr as (select *, row_number() over (partition by query_id order by llm_score desc nulls last, case when llm_score is null then original_rank end nulls first, input_seq)::int new_rank from sc)"""

_prompt_knn = f"""asked as (select query_id, prompt text from prompts), {_embedding('documents', 'doc_id')}, {_embedding('asked', 'query_id')},
nd as (select k, sqrt(sum(val * val)) n from emb_documents group by k), na as (select k, sqrt(sum(val * val)) n from emb_asked group by k),
dots as (select b.k query_id, d.k doc_id, sum(b.val * d.val) dt from emb_asked b join emb_documents d using (dim) group by all),
pairs as (select na.k query_id, nd.k doc_id, coalesce(dt / (na.n * nd.n), 0) s from na cross join nd left join dots on dots.query_id = na.k and dots.doc_id = nd.k),
dist as (select *, round(greatest(0, 1 - greatest(-1, least(1, round(s, 4)))), 4) distance from pairs),
near as (select *, greatest(0, least(1, round(1 - distance, 4))) similarity, row_number() over (partition by query_id order by distance, doc_id)::int rank from dist)"""

_turn_scores = """select conv_id, turn, '{kind}' kind, case when trim(text) = '' then 0.0 else greatest(0.0, least(1.0, round(0.3::double + {form} +
  ((case when contains(lower(text), 'the') then 1 else 0 end) + (case when contains(lower(text), 'json') then 1 else 0 end)) * 0.1::double
  + (case when length({t}) > 20 and length({t}) < 4000 then 0.15::double else 0 end) + (case when contains(text, '```') then 0.1::double else 0 end), 3))) end score from conversations"""
_trim = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

_base = "round(0.3::double + (case when regexp_matches(text, '(?i)istruzioni|step|instructions') then 0.1::double else 0 end) + (case when regexp_matches(text, '(?i)json|output') then 0.1::double else 0 end), 2)"

_blocks = f"""{_dual},
a as (select query_id, string_agg('• ' || name || ': ' || description, chr(10) order by rank) l from found where level = 'high_level' group by 1),
b as (select query_id, string_agg('• ' || name || ' (' || type || '): ' || description || ' [workspace]', chr(10) order by rank) l from found where level = 'low_level' group by 1),
ps as (select *, row_number() over (partition by query_id order by seq) r from paths),
p as (select query_id, string_agg('• (' || src || ') --[' || relation || ']--> (' || dst || ')', chr(10) order by r) l from ps where r <= 4 group by 1),
{_prompt_knn},
c as (select query_id, string_agg('• [sim=' || printf('%.3f', ((round(similarity * 10000)::bigint + 5) // 10)::double / 1000) || '] (' || doc_id || ') ' || text, chr(10) order by rank) l from near join documents using (doc_id) where rank <= 4 group by 1)"""

ORACLES = {
    "cosine_knn": f"with {_knn} select q_id, rank, vec_id, greatest(0, least(1, round(1 - distance, 4))) similarity, distance from kn where rank <= 5",
    "l2_normalize": """with e as (select vec_id, embedding::double[] v from embeddings), n as (select *, sqrt(list_dot_product(v, v)) n from e)
select vec_id, (i - 1)::int pos, round(v[i] / case when n = 0 then 1 else n end, 6) + 0.0 val from (select vec_id, v, n, unnest(range(1, len(v) + 1)) i from n)""",
    "index_stats_layers": """with u as (select (('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint + 1)::double / 4294967297.0::double u from embeddings),
l as (select least(5, floor(-ln(u) / ln(16.0::double)))::int lv from u)
select layer::int layer, count(*) node_count from (select unnest(range(0, lv + 1)) layer from l) group by layer""",
    "upsert_latest": "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) r from conversations) where r = 1",
    "chunk_sentences": rf"""with sent as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda z: z <> '') s from documents),
{_packed("sent", 800, "' '")}
select doc_id, (i - 1)::int chunk_index, length(c[i])::int char_count, md5(c[i]) text_md5 from (select doc_id, c, unnest(range(1, len(c) + 1)) i from o)""",
    "chunk_paragraphs": rf"""with para as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '') s from documents),
{_packed("para", 1400, "chr(10) || chr(10)")},
p as (select doc_id, flatten(list_transform(c, lambda z: list_transform(range(0, length(z), 1400), lambda i: substring(z, (i + 1)::int, 1400)))) c from o)
select doc_id, (i - 1)::int chunk_index, length(c[i])::int char_count, md5(c[i]) text_md5 from (select doc_id, c, unnest(range(1, len(c) + 1)) i from p)""",
    "fnv_hash_words": f"""with w as (select distinct unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) g from documents),
h as (select g word, {_fnv} u from w), s as (select word, case when u >= 2147483648 then u - 4294967296 else u end h from h)
select word, h, (abs(h) % 384)::int bucket, (case when h > 0 then 1 else -1 end)::int sign from s""",
    "hash_embedding": f"with {_embedding('documents', 'doc_id')} select k doc_id, dim, val from emb_documents",
    "text_knn": f"""with {_embedding('documents', 'doc_id')}, {_embedding('benchmark', 'item_id')},
nd as (select k, sqrt(sum(val * val)) n from emb_documents group by k), nb as (select k, sqrt(sum(val * val)) n from emb_benchmark group by k),
dots as (select b.k q_id, d.k doc_id, sum(b.val * d.val) dt from emb_benchmark b join emb_documents d using (dim) group by all),
sims as (select q_id, doc_id, greatest(-1, least(1, round(dt / (nb.n * nd.n), 4))) sim from dots join nb on nb.k = q_id join nd on nd.k = doc_id),
ranked as (select *, row_number() over (partition by q_id order by round(greatest(0, 1 - sim), 4), doc_id)::int rank from sims)
select q_id, rank, doc_id, greatest(0, least(1, round(1 - round(greatest(0, 1 - sim), 4), 4))) similarity from ranked where rank <= 4""",
    "keyword_scores": f"with {_scored} select query_id, id, score from scored where score > 0",
    "dual_level_topk": f"with {_dual} select query_id, level, rank, id, score, is_fallback from found",
    "relational_paths": f"with {_dual} select query_id, src, dst, relation from paths",
    "mentions": r"""with nodes as (select conv_id seq, 'title-' || conv_id id, regexp_extract(text, '^(\S+ \S+)', 1) as name from conversations where turn = 0
  union all select conv_id + 1000000000, 'word-' || conv_id, regexp_extract(text, '^(\S+)', 1) from conversations where turn = 1),
split as (select seq, id, regexp_extract_all(lower(name), '[\p{L}\p{N}_#]+') w from nodes),
names as (select array_to_string(w, ' ') as key, arg_min(id, seq) node_id, len(any_value(w)) n from split where len(w) > 0 group by 1),
parts as (select conv_id || '-' || turn chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_#]+|[^\p{L}\p{N}_#]+') p from conversations),
rows as (select chunk_id, unnest(p) part, generate_subscripts(p, 1) k from parts),
placed as (select *, sum(length(part)) over (partition by chunk_id order by k)::bigint as stop from rows),
words as (select chunk_id, part, stop - length(part) as start, stop, row_number() over (partition by chunk_id order by k) k from placed where regexp_full_match(part, '[\p{L}\p{N}_#]+')),
runs as (select a.chunk_id, a.start, a.stop, a.part as key, 1 n from words a union all
  select a.chunk_id, a.start, b.stop, a.part || ' ' || b.part, 2 from words a join words b on a.chunk_id = b.chunk_id and b.k = a.k + 1 union all
  select a.chunk_id, a.start, c.stop, a.part || ' ' || b.part || ' ' || c.part, 3 from words a join words b on a.chunk_id = b.chunk_id and b.k = a.k + 1 join words c on a.chunk_id = c.chunk_id and c.k = a.k + 2),
found as (select chunk_id, node_id, start, stop from runs join names using (key, n))
select chunk_id, node_id, start start_char, stop end_char from found f where not exists
  (select 1 from found g where g.chunk_id = f.chunk_id and g.start <= f.start and g.stop >= f.stop and g.stop - g.start > f.stop - f.start)""",
    "slugify_names": """with n as (select 'part' kind, p_partkey::bigint as key, p_name as name from part union all select 'supplier', s_suppkey, s_name from supplier union all select 'customer', c_custkey, c_name from customer)
select kind, key, substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) slug from n""",
    "merge_nodes": f"""with nodes as {_nodes}, known as (select lower(trim(name)) k from nodes where type = 'theme'),
fresh as (select lower(trim(name)) k, seq, name, row_number() over (partition by lower(trim(name)) order by seq, name) r from nodes where type = 'database'),
placed as (select name, row_number() over (order by seq, name) - 1 + (select count(*) from known) seq from fresh where r = 1 and k not in (select k from known))
select seq, 'ing-' || substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || seq id, name, 'tables' file_location from placed""",
    "merge_edges": f"""with nodes as {_nodes}, ids as (select lower(trim(name)) k, arg_min(id, seq) id from nodes group by 1),
rel as (select l_orderkey::bigint * 10 + l_linenumber seq, lower(p_name) s, lower(s_name) t, l_discount::double weight from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
ends as (select rel.seq, a.id source, b.id target, weight from rel join ids a on a.k = s join ids b on b.k = t),
firsts as (select *, row_number() over (partition by source, target order by seq, weight) r from ends)
select source, target, 'supplied_by' relation, weight from firsts f where r = 1 and not exists (select 1 from {_edges} e where e.source = f.source and e.target = f.target and e.relation = 'supplied_by')""",
    "rrf_fusion": f"with {_knn}, {_tq}, {_fused} select query_id, rank, vec_id, sources, round(score, 6) rrf_score from placed",
    "rerank_order": f"""with {_knn}, {_tq}, {_reranked}
select query_id, vec_id, source, original_rank, llm_score, new_rank, original_rank - new_rank rank_delta from nr""",
    "hybrid_context_text": f"""with {_blocks}
select query_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10), '[Themes]', a.l), concat_ws(chr(10), '[Entities]', b.l), concat_ws(chr(10), '[Relations]', p.l), concat_ws(chr(10), '[Text chunks]', coalesce(c.l, '• (none)'))) context
from prompts left join a using (query_id) left join b using (query_id) left join p using (query_id) left join c using (query_id)""",
    "rrf_block": f"""with {_knn}, {_tq}, {_fused}
select query_id, string_agg('• [rrfScore=' || printf('%.5f', score + 1e-12) || ', sources=' || sources || '] ' || 'v' || vec_id, chr(10) order by rank) block from placed group by 1""",
    "rerank_block": f"""with {_knn}, {_tq}, {_reranked}
select query_id, string_agg('• [' || coalesce('score=' || llm_score::int || '/10', 'FAILED') || ', rank ' || new_rank || ' was ' || original_rank || ' ' ||
  case when original_rank > new_rank then '▲' || (original_rank - new_rank) when original_rank < new_rank then '▼' || (new_rank - original_rank) else '=' end || ', source=' || source || '] v' || vec_id, chr(10) order by new_rank) block from nr group by 1""",
    "rerank_tally": f"""with {_knn}, {_tq}, {_reranked}
select query_id, count(llm_score) candidates_scored, count(*) - count(llm_score) candidates_failed, bool_or(original_rank <> new_rank) rank_changed from nr group by 1""",
    "rerank_calls": f"""with {_knn}, {_tq}, {_candidates},
rated as (select *, list_sum(list_transform(list_filter(string_split('v' || vec_id, ''), lambda c: c <> ''), lambda c: ascii(c)))::int % 14 n from rows)
select query_id, vec_id, source, case when n < 13 then least(10, n)::double end llm_score, n = 13 failed from rated""",
    "rerank_scores": """select p_partkey, case p_partkey % 7 when 0 then 10.0::double when 1 then 0 when 2 then 7 when 3 then null when 4 then null when 5 then 0 else least(10.0::double, p_partkey % 11 + 0.5::double) end score from part""",
    "hyde_search_text": """select conv_id * 100000 + turn query_id, md5(case when length(text) % 5 < 2 then text else length(text) || ' characters' end) search_md5,
case length(text) % 5 when 0 then 'TimeoutError: no answer' when 1 then 'empty passage' end hyde_error from conversations""",
    "ledger_answers": """select conv_id, turn, case when length(text) % 7 > 0 then length(text) || ' characters' end answer, case when length(text) % 7 = 0 then 'TimeoutError: no answer' end error
from (select conv_id, turn, coalesce(text, '') text from conversations)""",
    "exchanged_requests": """select conv_id, turn::bigint turn, case when role = 'user' then 'hybrid' else 'keyword' end as mode, case when turn % 3 = 0 then 60 else turn % 3 * 10 end::double rrf_k,
md5(text) prompt_md5 from conversations""",
    "compile_gain": f"""with s as ({_turn_scores.format(kind="json", form=f"(case when json_valid({_trim}) then 0.3::double when contains(text, '{{') and contains(text, '}}') then 0.1::double else 0 end)", t=_trim)}),
o as (select conv_id, turn, length(text) n, {_base} b from conversations),
g as (select conv_id, turn, n % 3 > 0 live, case when n % 3 > 0 then score else b end base_score, case when n % 3 = 0 then round(b + 0.2::double, 2) when n % 2 = 0 then 0.95::double else score end compiled_score from s join o using (conv_id, turn))
select *, case when base_score > 0 then case when compiled_score >= base_score then '+' else '' end || printf('%.1f', (compiled_score - base_score) / base_score * 100) else '+0.0' end || '%' gain from g""",
    "draft_target_rates": rf"""with t as (select conv_id, turn, text, list_filter(string_split_regex(lower({_trim}), '\s+'), lambda w: w <> '') w from conversations),
p as (select a.conv_id, a.turn, a.text x_text, b.text y_text, a.w x, b.w y, least(len(a.w), len(b.w)) n from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
r as (select *, case when n = 0 then 0.0 else round(len(list_filter(range(1, n + 1), lambda i: x[i] = y[i]))::double / n, 3) end rate from p)
select conv_id, turn, printf('%.2fx', (length(x_text) % 50 + 1)::double / 7) speedup, printf('%.1f', rate * 100) || '%' acceptance, md5(substring(x_text, 1, 160)) draft_md5, md5(substring(y_text, 1, 160)) target_md5 from r""",
    "merge_tally": f"""with nodes as {_nodes}, known as (select distinct lower(trim(name)) k from nodes where type = 'theme'),
fresh as (select count(distinct lower(trim(name))) n from nodes where type = 'database' and lower(trim(name)) not in (select k from known)),
every as (select count(*) n from nodes where type = 'database'), themes as (select count(*) n from nodes where type = 'theme'),
pairs as (select count(*) n from (select distinct lower(p_name), lower(s_name) from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey)),
old as (select count(*) n from {_edges})
select fresh.n nodes_added, every.n - fresh.n nodes_merged, pairs.n edges_added, themes.n + fresh.n n_nodes, old.n + pairs.n n_edges from fresh, every, themes, pairs, old""",
    "ingest_report": rf"""with d as (select doc_id, case when doc_id % 10 > 0 then text else ' ' end text from documents),
sent as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda z: z <> '') s from d),
{_packed("sent", 800, "' '")}
select doc_id, length(text)::int total_chars, case when regexp_replace(text, '^\s+|\s+$', '', 'g') = '' then 'no text' end error, len(c)::bigint chunks from d join o using (doc_id)""",
    "validate_relations": """with p as (select * from part where p_partkey % 10 > 0)
select p_partkey chunk_index, upper(p_name) source, 'Second' target, 'relates_to' relation, case when p_partkey % 3 = 1 then 0.25::double else 0.5::double end weight from p
union all select p_partkey, 'second', p_name, 'r', 1.0::double from p""",
    "tq_compress": f"""with {_rotated} select vec_id, to_base64(unhex(array_to_string(list_transform(sq, lambda v: to_hex(v + 8)), ''))) as data,
array_to_string(list_transform(range(64), lambda i: if(y[i + 1] - sq[i + 1] / 12::double >= 0, '1', '0')), '') residual_bits, round(nm, 6) norm, '6.4x' ratio from b""",
    "tq_search": f"with {_tq} select q_id, rank, vec_id, score from tn where rank <= 10",
    "validate_extraction": """with p as (select p_partkey, p_name, p_partkey % 10 = 0 bad from part)
select p_partkey chunk_index, case when bad then 'not a JSON object' end error, case when not bad then p_name end as name,
  case when bad then null when p_partkey % 3 = 0 then 'theme' when p_partkey % 3 = 1 then 'concept' else 'api' end as type,
  case when bad then null when p_partkey % 2 = 0 then 'high_level' else 'low_level' end as level, case when bad then null when p_partkey % 5 = 0 then '' else 'd' end description, case when not bad then 'a,b' end tags from p
union all select p_partkey, null, 'second', 'concept', 'low_level', '', '' from p where not bad and p_partkey % 4 > 0""",
    "token_overlap": rf"""with t as (select conv_id, turn, list_filter(string_split_regex(lower({_trim}), '\s+'), lambda w: w <> '') w from conversations),
p as (select a.conv_id, a.turn, a.w x, b.w y, least(len(a.w), len(b.w)) n from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, case when n = 0 then 0.0 else round(len(list_filter(range(1, n + 1), lambda i: x[i] = y[i]))::double / n, 3) end rate from p""",
    "adherence_score": _turn_scores.format(kind="string", form="0.15::double", t=_trim)
    + " union all "
    + _turn_scores.format(kind="json", form=f"(case when json_valid({_trim}) then 0.3::double when contains(text, '{{') and contains(text, '}}') then 0.1::double else 0 end)", t=_trim),
    "offline_prompt_score": f"""with b as (select conv_id, turn, {_base} b from conversations), c as (select *, round(b + 0.2::double, 2) c from b)
select conv_id, turn, b base_score, c compiled_score, '+' || printf('%.1f', (c - b) / b * 100) || '%' gain from c""",
    "compiled_prompt": rf"""with p as (select conv_id, turn, concat_ws(chr(10) || chr(10), '[Signature: answering]', 'Task: Answer the turn',
  '[Input fields]' || chr(10) || '  - question (string): what was said', '[Output fields]' || chr(10) || '  - the (string): an article' || chr(10) || '  - Json (json): ',
  case when role = 'user' then '[Demonstration]' || chr(10) || 'Input: ' || text || chr(10) || 'Output: ' || substring({_trim}, 1, 500) else '[Demonstration]' || chr(10) || '(no model answered; structure only)' end,
  '[Input]' || chr(10) || text, 'Answer with the output fields only, in the types given above.') p from conversations)
select conv_id, turn, md5(p) prompt_md5, length(p)::int n_chars from p""",
    "status_counts": f"select (select count(*) from {_nodes}) nodes, (select count(*) from {_edges}) edges, (select count(*) from embeddings) chunks",
}
ORACLES["sql_sentence_chunks"], ORACLES["sql_paragraph_chunks"] = ORACLES["chunk_sentences"], ORACLES["chunk_paragraphs"]
ORACLES["laid_out_paths"] = ORACLES["relational_paths"]

ORACLES["extract_graph"] = f"""with c as ({ORACLES["chunk_paragraphs"]})
select doc_id, chunk_index, case char_count % 5 when 0 then 'TimeoutError: no answer' when 1 then 'not a JSON object' end error,
case when char_count % 5 > 1 then 'Entity ' || char_count end first_name, case when char_count % 5 > 1 then 2 end::int n_entities,
case when char_count % 5 > 1 then case char_count % 4 when 0 then 0.0 when 1 then 1.0 else 0.5 end end::double weight from c"""
_modes = "(values (0, 'keyword'), (1, 'vector'), (2, 'hybrid'), (3, 'hybrid_rerank'), (4, 'hybrid_rrf'), (5, 'vector_hyde'), (6, 'hybrid_hyde')) m(m, mode)"
ORACLES["answered_requests"] = f"""with {_blocks},
lists as (select query_id, 'graph' source, name || ': ' || description as text, rank from found where level = 'low_level'
  union all select query_id, 'vector', text, rank from near join documents using (doc_id) where rank <= 4),
rated as (select *, length(text) % 11 score, 1.0::double / (case when query_id % 2 = 1 then 10 else 60 end + rank) rrf from lists),
ranked as (select *, row_number() over (partition by query_id order by score desc, source, rank) now from rated),
rb as (select query_id, string_agg('• [rrfScore=' || printf('%.5f', rrf + 1e-12) || ', sources=' || source || '] ' || text, chr(10) order by round(rrf, 12) desc, source, rank) l from rated group by 1),
kb as (select query_id, string_agg('• [score=' || score || '/10, rank ' || now || ' was ' || rank || ' ' || case when rank > now then '▲' || (rank - now) when rank < now then '▼' || (now - rank) else '=' end
  || ', source=' || source || '] ' || text, chr(10) order by now) l from ranked group by 1),
made as (select query_id + 10 * m query_id, mode, prompt, concat_ws(chr(10) || chr(10), case mode when 'hybrid_rrf' then rb.l when 'hybrid_rerank' then kb.l end,
  concat_ws(chr(10), '[Themes]', case when mode not like 'vector%' then a.l end), concat_ws(chr(10), '[Entities]', case when mode not like 'vector%' then b.l end),
  concat_ws(chr(10), '[Relations]', case when mode not like 'vector%' then p.l end), concat_ws(chr(10), '[Text chunks]', coalesce(case when mode <> 'keyword' then c.l end, '• (none)'))) context
  from prompts cross join {_modes} left join a using (query_id) left join b using (query_id) left join p using (query_id) left join c using (query_id) left join rb using (query_id) left join kb using (query_id))
select query_id::bigint query_id, mode, md5(context) context_md5, (length(context) + length(prompt) + 21)::varchar synthesis, null::varchar synthesis_error, true llm_used from made"""
