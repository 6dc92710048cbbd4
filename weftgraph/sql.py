"""DuckDB SQL of the queries in `catalogue`, written independently of the expressions that these are made of."""

from __future__ import annotations

import re

from weftgraph.catalogue import BUDGETS, LIST_SIZES, QUERY_VECTOR, SEEDS, WALK_QUESTION
from weftgraph.functions.text import STOP_CJK, STOP_ENGLISH

WS = r"[\s\x0b\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0b\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"replace(lower(regexp_replace({x}, '{WS}+', '', 'g')), 'ß', 'ss')"


def _tokens(x: str) -> str:
    cjk, words = f"len(regexp_extract_all({x}, '[一-鿿]'))", f"len(regexp_extract_all({x}, '{NOT_WS}+'))"
    return f"cast(case when length({x}) = 0 then 0 when {cjk} >= greatest(1, floor(length({x}) / 4)) then length({x}) else greatest(1, {words}) end as bigint)"


def _hash(x: str, length: int, prefix: str) -> str:
    return f"'{prefix}' || substring(sha1({x}), 1, {length})"


def _relation(a: str, b: str, separator: str) -> str:
    return _hash(f"least({a}, {b}) || '{separator}' || greatest({a}, {b})", 16, "rel_")


def _quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


UNITS = f"""docs as (
  select cast(doc_id as varchar) as id, {_strip("text")} as text, doc_id as ord from documents where {_strip("text")} <> ''
), cut as (
  select id, ord, text, case when length(text) <= 1200 then [text] else list_filter(list_transform(
    range(0, cast(least(ceil((length(text) - 1200) / 1100), 10000) as bigint) + 1), lambda i: {_strip("substring(text, i * 1100 + 1, 1200)")}), lambda p: p <> '') end as ps from docs
), pieces as (
  select id as document_id, ord, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from cut
), units as (
  select {_hash("document_id || '|' || chunk_index || '|' || substring(text, 1, 64)", 12, "tu_")} as id, text, document_id, chunk_index, {_tokens("text")} as n_tokens, ord::hugeint * 1000000000 + chunk_index as unit_ord from pieces
)"""

# RE2 has no word boundaries beyond ASCII, so other letters become a marker of word characters first
_FOUND = f"""list_concat(list_concat(
    list_filter(regexp_extract_all(text, '[一-鿿]{{2,8}}'), lambda p: p not in ({_quoted(STOP_CJK)})),
    list_filter(regexp_extract_all(m, '\\b(?:[A-Z][a-z0-9]+(?:\\s+[A-Z][a-z0-9]+)+)\\b'), lambda p: not contains(p, '0_0_0'))),
    list_filter(regexp_extract_all(m, '\\b[A-Za-z][A-Za-z0-9_\\-]{{3,}}\\b'), lambda p: not contains(p, '0_0_0') and lower(p) not in ({_quoted(STOP_ENGLISH)})))"""
PHRASES = f"""{UNITS}, marked as (
  select id, unit_ord, text, regexp_replace(text, '[^\\P{{L}}\\x00-\\x7F]', '0_0_0', 'g') as m from units
), found as (
  select id, unit_ord, text, {_FOUND} as f from marked
), each_one as (
  select id, unit_ord, text, unnest(f) as p, generate_subscripts(f, 1) as pos from found
), counted as (
  select id, unit_ord, any_value(text) as text, p, {_norm("p")} as k, count(*) as n, min(pos) as pos from each_one group by id, unit_ord, p
), firsts as (
  select * from counted where k <> '' qualify row_number() over (partition by id, k order by n desc, length(p) desc, pos) = 1
), ranked as (
  select *, row_number() over (partition by id order by n desc, length(p) desc, pos) - 1 as phrase_rank from firsts
), phrases as (
  select id as unit_id, unit_ord, phrase_rank, p as title, k as norm_title, replace(substring(text, 1, 180), chr(10), ' ') as snippet from ranked where phrase_rank < 24
)"""


def _graph(p: str = "") -> str:
    """Entities and relationships of the phrases with a prefix."""
    return f"""{p}entities as (
  select {_hash("norm_title", 16, "ent_")} as id, arg_min(title, unit_ord * 1000000 + phrase_rank) as title, 'NOUN_PHRASE' as type,
    substring(array_to_string(list(snippet order by unit_ord)[1:3], ' | '), 1, 500) as description, string_agg(unit_id, ',' order by unit_ord) as text_unit_ids, cast(count(*) as double) as rank,
    norm_title, min(unit_ord * 1000000 + phrase_rank) as ord
  from {p}phrases group by norm_title
), {p}pairs as (
  select a.unit_id, a.unit_ord, least(a.norm_title, b.norm_title) as x, greatest(a.norm_title, b.norm_title) as y, row_number() over (partition by a.unit_id order by a.phrase_rank, b.phrase_rank) - 1 as place
  from {p}phrases a join {p}phrases b on a.unit_id = b.unit_id and a.phrase_rank < b.phrase_rank
), {p}summed as (
  select x, y, count(*) as n, string_agg(unit_id, ',' order by unit_ord) as text_unit_ids, min(unit_ord * 1000000 + place) as ord from {p}pairs group by x, y
), {p}relationships as (
  select {_relation("x", "y", "|")} as id, a.title as source, b.title as target, 'together in a text unit, ' || n || ' times' as description, cast(n as double) as weight, s.text_unit_ids, cast(n as double) as rank,
    x as norm_source, y as norm_target, s.ord
  from {p}summed s join {p}entities a on a.norm_title = x join {p}entities b on b.norm_title = y
)"""


ENTITIES = f"{PHRASES}, {_graph()}"
ORD = "cast(ord as varchar) as ord"
ENTITY_COLUMNS = f"id, title, type, description, text_unit_ids, rank, norm_title, {ORD}"
RELATION_COLUMNS = f"id, source, target, description, weight, text_unit_ids, rank, norm_source, norm_target, {ORD}"


def _trade(p: str = "", where: str = "true") -> str:
    return f"""{p}units as (
  select 'o' || o_orderkey as id, 'Order ' || o_orderkey || ', ' || o_orderpriority as text, 'c' || o_custkey as document_id, o_orderkey::hugeint as unit_ord from orders where {where}
), {p}lines as (
  select l_orderkey, l_partkey, min(struct_pack(a := l_linenumber, b := l_partkey)) as first from lineitem group by l_orderkey, l_partkey
), {p}phrases as (
  select u.id as unit_id, u.unit_ord, row_number() over (partition by u.id order by first) - 1 as phrase_rank, 'Part ' || l_partkey as title, 'part' || l_partkey as norm_title, u.text as snippet
  from {p}lines join {p}units u on u.unit_ord = l_orderkey
), {_graph(p)}"""


TRADE = _trade()
CLAIMS = f"""claims as (
  select {_hash("'part ' || user_id || '|' || event_type", 16, "cov_")} as id, 'Part ' || user_id as subject, '' as object, 'claim' as type, arg_min(case when value > 50 then 'SUSPECTED' else 'TRUE' end, event_id) as status,
    event_type as description, '' as start_date, '' as end_date, string_agg('o' || event_id, ',' order by event_id) as text_unit_ids, 'part' || user_id as norm_subject, min(event_id)::hugeint * 1000000 as ord
  from events group by user_id, event_type
)"""
LINKED = f"""{TRADE}, {CLAIMS}, unit_entities as (
  select p.unit_id, e.id, e.title, e.norm_title, row_number() over (partition by p.unit_id order by e.ord, e.id) - 1 as place from phrases p join entities e using (norm_title)
), unit_relations as (
  select p.unit_id, r.id, r.source, r.target, row_number() over (partition by p.unit_id order by r.ord, r.id) - 1 as place from pairs p join relationships r on r.norm_source = p.x and r.norm_target = p.y
), unit_claims as (
  select u.id as unit_id, c.id, c.subject, row_number() over (partition by u.id order by c.ord, c.id) - 1 as place from events join units u on u.unit_ord = event_id join claims c on c.norm_subject = 'part' || user_id and c.description = event_type
), linked_documents as (
  select 'c' || c_custkey as id, c_name as title, c_mktsegment as text from customer where c_acctbal >= 0
  union all
  select document_id, document_id, substring(arg_min(text, unit_ord), 1, 200) from units where document_id not in (select 'c' || c_custkey from customer where c_acctbal >= 0) group by document_id
)"""
TREE = """own as (
  select 'c' || c_custkey as id, c_name as title, c_mktsegment as type, floor(c_acctbal / 1000) as rank, c_custkey as ord, n_nationkey, n_regionkey from customer join nation on c_nationkey = n_nationkey
), members as (
  select 'comm_L1_' || n_nationkey as community_id, 1 as level, 100 + n_nationkey as c_ord, * from own union all select 'comm_L0_' || n_regionkey, 0, n_regionkey, * from own
), placed as (
  select *, row_number() over (partition by community_id order by ord) as place from members
)"""
EXTRACTED = """lined as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 as i from lineitem
), said as (
  select 'o' || l_orderkey as unit_id, l_orderkey as unit_ord, 2 * i as place, 'Part ' || l_partkey as title, 'part' as type, 'flag ' || l_returnflag as said, 'part' || l_partkey as norm_title from lined
  union all select 'o' || l_orderkey, l_orderkey, 2 * i + 1, 'Supplier ' || l_suppkey, 'supplier', null, 'supplier' || l_suppkey from lined
)"""
_VECTOR = "[" + ", ".join(repr(x) for x in QUERY_VECTOR) + "]::double[]"


def _nearest(score: str) -> str:
    return f"select vec_id as id, round({score}, 6) as score from embeddings order by {score} desc, vec_id limit 20"


_sums = ", ".join(f"coalesce(sum(s) filter (where d = {i}), 0) as x{i}" for i in range(8))
_norm8 = "sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(8)) + ")"
_HASHED = f"""w as (select item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) as w from benchmark),
  h as (select item_id, cast('0x' || substring(sha1(w), 1, 4) as int) % 8 as d, case when substring(sha1(w), 5, 1) < '8' then 1.0::double else -1.0::double end as s from w where w <> ''),
  x as (select item_id as id, {_sums} from h group by item_id)"""


def _cast(x: str) -> str:
    return f"cast({x} as bigint)"


def _values(rows: tuple[tuple, ...]) -> str:
    return ", ".join(f"({i}, {', '.join(map(str, row))})" for i, row in enumerate(rows))


SQL = {
    "chunk_documents": f"with {UNITS} select id, text, document_id, chunk_index, n_tokens, cast(unit_ord as varchar) as unit_ord from units",
    "chunk_string_ids": f"with {UNITS.replace('cast(doc_id as varchar) as id', repr('doc-') + ' || doc_id as id')} select id, text, document_id, chunk_index, n_tokens from units",
    "unit_metadata": f"""with {UNITS} select units.id, units.id as doc_id, document_id, cast(chunk_index as varchar) as chunk_index, lang, source, cast(n_chars as varchar) as n_chars
        from units join documents on cast(doc_id as varchar) = document_id""",
    "chunk_statistics": f"with {UNITS} select count(distinct document_id) as documents, count(*) as text_units, {_cast('sum(n_tokens)')} as tokens, max(n_tokens) as longest from units",
    "document_units": f"""with {UNITS}, listed as (select document_id, string_agg(id, ',' order by chunk_index) as text_unit_ids from units group by document_id)
        select id, substring(text, 1, 2000) as text, id as title, text_unit_ids, ord from docs join listed on id = document_id""",
    "token_counts": f"""with t as (select doc_id, text, {_tokens("text")} as n_tokens from documents)
        select doc_id, n_tokens, case when n_tokens <= 100 then text else substring(text, 1, greatest(1, cast(floor(length(text) * 100 / n_tokens) as bigint))) end as first_100 from t""",
    "content_hash_ids": f"select doc_id, {_hash(_strip('text'), 16, 'tu_')} as id, sha1({_norm('text')}) as norm_hash, replace(substring(text, 1, 180), chr(10), ' ') as snippet from documents",
    "norm_text_keys": f"""with k as (select *, {_norm("p_name")} as n, {_norm("p_type")} as t from part)
        select p_partkey, n as norm, {_hash("n", 16, "ent_")} as entity_id, {_hash("n || '|' || lower(p_type)", 16, "ent_")} as typed_id, {_relation("n", "t", "|")} as relation_id,
          substring(regexp_replace(p_name || '/' || p_type, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 1, 64) as safe_key from k""",
    "keyword_lists": r"""with k as (select p_partkey, regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '\w{2,}') as l from part)
        select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ',') as keywords from k""",
    "noun_phrases_topn": f"with {PHRASES} select unit_id, cast(unit_ord as varchar) as unit_ord, phrase_rank, title, norm_title from phrases",
    "fast_entities": f"with {ENTITIES} select {ENTITY_COLUMNS} from entities",
    "fast_entities_frequent": f"with {ENTITIES} select {ENTITY_COLUMNS} from entities where rank >= 3",
    "fast_relationships": f"with {ENTITIES} select {RELATION_COLUMNS} from relationships",
    "parts_in_orders": f"with {TRADE} select {ENTITY_COLUMNS} from entities",
    "cooccur_parts_in_orders": f"with {TRADE} select {RELATION_COLUMNS} from relationships",
    "entity_graph": f"with {TRADE} select least(a.id, b.id) as src, greatest(a.id, b.id) as dst, sum(weight) as weight from relationships r join entities a on a.norm_title = norm_source join entities b on b.norm_title = norm_target where a.id <> b.id group by 1, 2",
    "entity_weighted_degree": f"with {TRADE}, d as (select t, sum(weight) as w from (select norm_source as t, weight from relationships union all select norm_target, weight from relationships) group by t) select id, w as degree from entities join d on t = norm_title",
    "entity_rank": f"with {TRADE}, d as (select t, sum(weight) as w from (select norm_source as t, weight from relationships union all select norm_target, weight from relationships) group by t) select id, title, coalesce(w, 0) + rank as rank from entities left join d on t = norm_title",
    "edge_canonicalize": f"with {TRADE} select a.id as src_id, b.id as dst_id, r.description, weight from relationships r join entities a on a.norm_title = norm_source join entities b on b.norm_title = norm_target",
    "neighborhood_1hop": f"""with {TRADE}, ends as (select unnest([norm_source, norm_target]) as t from relationships where norm_source in ({_quoted(SEEDS)}) or norm_target in ({_quoted(SEEDS)}))
        select id, title, rank from entities where norm_title in (select t from ends) and norm_title not in ({_quoted(SEEDS)})""",
    "subgraph_slice": f"""with {TRADE}, {CLAIMS}, ends as (select unnest([norm_source, norm_target]) as t from relationships where norm_source in ({_quoted(SEEDS)}) or norm_target in ({_quoted(SEEDS)})),
        e as (select * from entities where norm_title in (select t from ends) or norm_title in ({_quoted(SEEDS)})), t as (select norm_title from e),
        r as (select * from relationships where norm_source in (select * from t) or norm_target in (select * from t)),
        u as (select distinct unit_id from phrases where norm_title in (select * from t) union select p.unit_id from pairs p join r on p.x = r.norm_source and p.y = r.norm_target)
        select 'entities' as part, id from e union all select 'relationships', id from r union all select 'chunks', unit_id from u
        union all select 'covariates', id from claims where norm_subject in (select * from t)
        union all select 'documents', 'c' || c_custkey from customer where c_acctbal >= 0 and 'c' || c_custkey in (select document_id from units where id in (select unit_id from u))
        union all select 'communities', 'comm_' || b from (select distinct p_brand as b from part where 'part' || p_partkey in (select * from t))
        union all select 'reports', 'report_comm_' || b from (select distinct p_brand as b from part where 'part' || p_partkey in (select * from t))""",
    "provenance_link": f"""with {LINKED}, e as (select unit_id, string_agg(id, ',' order by place) as l from unit_entities group by 1), r as (select unit_id, string_agg(id, ',' order by place) as l from unit_relations group by 1),
        c as (select unit_id, string_agg(id, ',' order by place) as l from unit_claims group by 1)
        select u.id, document_id, coalesce(e.l, '') as entity_ids, coalesce(r.l, '') as relationship_ids, coalesce(c.l, '') as covariate_ids from units u left join e on e.unit_id = u.id left join r on r.unit_id = u.id left join c on c.unit_id = u.id""",
    "provenance_documents": f"with {LINKED}, l as (select document_id, string_agg(id, ',' order by unit_ord) as ids from units group by 1) select d.id, title, d.text, coalesce(ids, '') as text_unit_ids from linked_documents d left join l on document_id = d.id",
    "provenance_orphans": f"""with {LINKED}, n as (select count(*) as u, count(*) filter (where id in (select unit_id from phrases)) as w from units)
        select (select count(*) from entities) as entities_with_sources, 0::bigint as orphan_entities, w as text_units_with_entities, u - w as orphan_text_units, (select count(*) from linked_documents) as documents from n""",
    "resolve_entity": f"with {TRADE} select id, title, {ORD} from entities where norm_title = 'part7'",
    "entity_to_sources": f"""with {LINKED} select row_number() over (order by u.unit_ord) - 1 as place, u.id as text_unit_id, document_id, d.title as document_title, {_tokens("u.text")} as n_tokens, u.text, substring(u.text, 1, 240) as preview
        from phrases p join units u on u.id = p.unit_id join linked_documents d on d.id = document_id where p.norm_title = 'part7'""",
    "entity_to_relationships": f"""with {TRADE}, found as (select distinct x, y from pairs where x = 'part7' or y = 'part7' or unit_id in (select unit_id from phrases where norm_title = 'part7'))
        select id, source, target, weight from relationships join found on x = norm_source and y = norm_target order by ord, id limit 40""",
    "unit_to_graph": f"""with {LINKED} select 'entity' as kind, place, id, title from unit_entities where unit_id = 'o7' union all select 'relationship', place, id, source || ' -> ' || target from unit_relations where unit_id = 'o7'
        union all select 'covariate', place, id, subject from unit_claims where unit_id = 'o7'""",
    "document_to_graph": f"""with {LINKED}, f as (select e.id, any_value(e.title) as title, min(struct_pack(a := unit_ord, b := place)) as first from unit_entities e join units u on u.id = e.unit_id where document_id = 'c7' group by e.id)
        select row_number() over (order by first) - 1 as place, id, title from f""",
    "citations": f"""with {LINKED}, s as (select unit_id, string_agg(title, ',' order by place) as l from unit_entities where norm_title in ({_quoted(SEEDS)}) group by 1)
        select cast(unit_ord as bigint) as place, u.id as text_unit_id, document_id, d.title as document_title, coalesce(l, '') as supports_entities, substring(u.text, 1, 280) as preview
        from units u join linked_documents d on d.id = document_id left join s on s.unit_id = u.id""",
    "source_lines": f"""with {LINKED}, s as (select unit_id, string_agg(title, ', ' order by place) as l from unit_entities where place < 8 group by 1)
        select cast(unit_ord as bigint) as place, u.id, '[' || u.id || '] document=' || d.title || coalesce('; entities: ' || l, '') || chr(10) || u.text as line from units u join linked_documents d on d.id = document_id left join s on s.unit_id = u.id""",
    "index_merge_entities": f"""with {_trade("o", "o_orderstatus = 'F'")}, {_trade("n", "o_orderstatus <> 'F'")}
        select coalesce(o.id, n.id) as id, coalesce(o.title, n.title) as title, 'NOUN_PHRASE' as type, case when o.id is null then n.description when n.id is null then o.description else substring(o.description || '；' || n.description, 1, 500) end as description,
          concat_ws(',', o.text_unit_ids, n.text_unit_ids) as text_unit_ids, greatest(o.rank, n.rank) as rank, coalesce(o.norm_title, n.norm_title) as norm_title, cast(coalesce(o.ord, n.ord) as varchar) as ord from oentities o full join nentities n on o.id = n.id""",
    "index_merge_relationships": f"""with {_trade("o", "o_orderstatus = 'F'")}, {_trade("n", "o_orderstatus <> 'F'")}
        select coalesce(o.id, n.id) as id, coalesce(o.source, n.source) as source, coalesce(o.target, n.target) as target,
          case when o.id is null then n.description when n.id is null or contains(o.description, n.description) then o.description else substring(o.description || '；' || n.description, 1, 500) end as description,
          coalesce(o.weight, 0) + coalesce(n.weight, 0) as weight, concat_ws(',', o.text_unit_ids, n.text_unit_ids) as text_unit_ids, coalesce(o.rank, n.rank) as rank, coalesce(o.norm_source, n.norm_source) as norm_source,
          coalesce(o.norm_target, n.norm_target) as norm_target, cast(coalesce(o.ord, n.ord) as varchar) as ord from orelationships o full join nrelationships n on o.id = n.id""",
    "index_upsert": "select cast(p_partkey as varchar) as id, p_name as title from part where p_partkey not in (select s_suppkey from supplier) union all select cast(s_suppkey as varchar), s_name from supplier",
    "merge_extractions_entities": f"""with {EXTRACTED}, u as (select distinct norm_title, unit_ord, unit_id from said), l as (select norm_title, string_agg(unit_id, ',' order by unit_ord) as ids, count(*) as n from u group by 1)
        select {_hash("norm_title || '|' || any_value(type)", 16, "ent_")} as id, any_value(title) as title, any_value(type) as type,
          coalesce(array_to_string((list(said order by unit_ord, place) filter (where said is not null))[1:3], '; '), any_value(title)) as description, any_value(ids) as text_unit_ids, cast(any_value(n) as double) as rank, norm_title,
          cast(min(unit_ord::hugeint * 1000000 + place) as varchar) as ord from said join l using (norm_title) group by norm_title""",
    "merge_extractions_relationships": f"""with {EXTRACTED}, r as (select 'o' || l_orderkey as unit_id, l_orderkey as unit_ord, i as place, l_suppkey as s, l_partkey as p, l_quantity as q from lined),
        l as (select s, p, string_agg(unit_id, ',' order by unit_ord) as ids from (select distinct s, p, unit_id, unit_ord from r) group by 1, 2)
        select {_relation("'supplier' || s", "'part' || p", "->")} as id, 'Supplier ' || s as source, 'Part ' || p as target, array_to_string(list_transform(range(0, least(3, count(*))), lambda x: 'supplies'), '; ') as description,
          sum(q) as weight, any_value(ids) as text_unit_ids, 1.0::double as rank, 'supplier' || s as norm_source, 'part' || p as norm_target, cast(min(unit_ord::hugeint * 1000000 + place) as varchar) as ord from r join l using (s, p) group by s, p""",
    "claims_dedupe": f"with {CLAIMS} select * replace (cast(ord as varchar) as ord) from claims",
    "claims_for_entities": f"with {TRADE}, {CLAIMS} select id, subject, description, status from claims where norm_subject in (select norm_title from entities)",
    "vector_missing_guard": f"select vec_id as id, case when label <= 2 then -1.0::double else round(list_cosine_similarity(embedding::double[], {_VECTOR}), 6) end as score, label = 0 as missing from embeddings",
    "embed_texts": f"with {_HASHED} select id, " + ", ".join(f"round(cast(cast(x{i} / {_norm8} as float) as double), 4) as v{i}" for i in range(8)) + " from x",
    "choose_lists": f"""with g as (select n, configured, cast(case when n <= 0 then 1 when configured > 0 then least(configured, n) when n < 50 then greatest(1, n // 2) else least(100, greatest(10, floor(sqrt(n)))) end as bigint) as lists
        from (values {_values(LIST_SIZES)}) v(i, n, configured)) select cast(n as bigint) as n, cast(configured as bigint) as configured, lists, least(greatest(1, lists), 10) as probes from g""",
    "allocate_budget": f"""with g as (select i, greatest(256, t) as t, least(greatest(a::double, 0), 0.9::double) as a, least(greatest(b::double, 0), 0.9::double) as b from (values {_values(BUDGETS)}) v(i, t, a, b)),
        s as (select i, t, case when a + b > 0.95 then a * 0.95::double / (a + b) else a end as a, case when a + b > 0.95 then b * 0.95::double / (a + b) else b end as b from g)
        select cast(i as bigint) as i, cast(t as bigint) as total, {_cast("trunc(t * a)")} as text_units, {_cast("trunc(t * b)")} as community_reports, greatest(64, t - {_cast("trunc(t * a)")} - {_cast("trunc(t * b)")}) as graph from s""",
    "pack_under_budget": f"""with {UNITS}, s as (select *, sum(n_tokens + 1) over (partition by document_id order by chunk_index) - 1 as c from units), b as (select *, coalesce(lag(c) over (partition by document_id order by chunk_index), 0) as before from s),
        r as (select *, case when c > 500 and before <= 500 then 500 - before - (before > 0)::int end as room from b)
        select id, document_id, case when room is null then text else substring(text, 1, greatest(1, cast(floor(length(text) * room / n_tokens) as bigint))) end as packed, {_cast("case when room is null then c else 500 end")} as used from r where c <= 500 or room >= 24""",
    "pack_sections": f"""with n as (select n_name as title, repeat(n_name || ' trades ', 40) as body, n_nationkey as ord from nation), k as (select *, '## ' || title || chr(10) || rtrim(body) as block from n),
        s as (select *, sum({_tokens("block")} + 2) over (order by ord) as c from k), b as (select *, coalesce(lag(c) over (order by ord), 0) as before from s), r as (select *, case when c > 250 and before <= 250 then 250 - before - 2 - 2 end as room from b)
        select title, body, cast(ord as bigint) as ord, case when room is null then block else '## ' || title || chr(10) || substring(body, 1, cast(floor(length(body) * room / {_tokens("body")}) as bigint)) end as packed from r where c <= 250 or room >= 32""",
    "batch_reports_next_fit": f"""with recursive t as (select source, doc_id, {_tokens("text")} as n, row_number() over (partition by source order by doc_id) as i from documents),
        f as (select source, doc_id, i, n as used, 0 as batch from t where i = 1
          union all select t.source, t.doc_id, t.i, case when used + n > 4000 then n else used + n end, case when used + n > 4000 then batch + 1 else batch end from f join t on t.source = f.source and t.i = f.i + 1)
        select source, doc_id, cast(batch as bigint) as batch from f""",
    "report_level_select": "select 'report_comm_L1_' || n_nationkey as id, 1::bigint as level, n_name as title from nation",
    "community_report_rank": f"""with {TREE}, counted as (select community_id, cast(any_value(level) as bigint) as level, coalesce(nullif(sum(rank), 0), count(*)) as rank, count(*) as n_entities,
        string_agg('- ' || title || ' (' || type || '): buys', chr(10) order by place) filter (where place <= 40) as entities from placed group by community_id),
        f as (select c_custkey as k, c_custkey // 2 as t, c_custkey % 5 + 1 as w from customer where c_custkey >= 2),
        touching as (select distinct m.community_id, k, t, w from f join members m on m.ord in (k, t)),
        rels as (select community_id, string_agg('- Customer#' || lpad(k::varchar, 9, '0') || ' -> Customer#' || lpad(t::varchar, 9, '0') || ': follows (w=' || w || '.0)', chr(10) order by n) filter (where n <= 60) as relations, count(*) as n_relations
          from (select *, row_number() over (partition by community_id order by k) as n from touching) group by 1),
        said as (select m.community_id, e.*, row_number() over (partition by m.community_id order by event_id) as n from events e join members m on m.ord = user_id),
        told as (select community_id, string_agg('- [' || case when value > 50 then 'SUSPECTED' else 'TRUE' end || '] Customer#' || lpad(user_id::varchar, 9, '0') || ': ' || event_type || case when event_id % 3 = 0 then ' (2024~)' else '' end, chr(10) order by n) as claims from said where n <= 40 group by 1),
        bought as (select *, row_number() over (partition by o_custkey order by o_orderkey) as m from orders),
        read as (select p.community_id, b.o_orderkey, b.o_orderpriority, row_number() over (partition by p.community_id order by place, m) as n from placed p join bought b on b.o_custkey = p.ord where place <= 20 and m <= 2),
        lines as (select community_id, string_agg('- [o' || o_orderkey || '] Order ' || o_orderkey || ', ' || o_orderpriority, chr(10) order by n) as sources from read where n <= 12 group by 1)
        select c.community_id, level, rank, n_entities, n_relations, entities, relations, claims, sources from counted c left join rels r on r.community_id = c.community_id left join told t on t.community_id = c.community_id left join lines l on l.community_id = c.community_id""",
    "community_members": f"with {TREE} select id, string_agg(community_id, ',' order by c_ord) as community_ids from members group by id",
    "hierarchy_walk": f"""with asked as (select [{_quoted(re.findall(r"[a-z0-9_]{4,}", WALK_QUESTION.lower()))}] as q), r as (select r_regionkey, r_name from region, asked where list_has_any(string_split(lower(r_name), ' '), q)),
        n as (select n_nationkey, n_name, n_regionkey from nation join r on r_regionkey = n_regionkey, asked where list_has_any(string_split(lower(n_name), ' '), q))
        select 'report_comm_L1_' || n_nationkey as id, 'comm_L1_' || n_nationkey as community_id, 1::bigint as level, n_name as title from n
        union all select 'report_comm_L0_' || r_regionkey, 'comm_L0_' || r_regionkey, 0, r_name from r where r_regionkey not in (select n_regionkey from n)""",
    "community_reports": f"with {TREE} select 'report_' || community_id as id, cast(any_value(level) as bigint) as level, arg_min(title, place) as title, coalesce(nullif(sum(rank), 0), count(*)) as rank from placed group by community_id",
    "followups_dedupe": f"""with q as (select text as question, length(text) as score, conv_id * 1000 + turn as ord from conversations where length(text) >= 40 qualify row_number() over (partition by {_norm("text")} order by length(text) desc, conv_id * 1000 + turn) = 1)
        select question, score, ord from q order by score desc, ord limit 20""",
    "distinct_records": """select 'supplier' as kind, cast(s_suppkey as varchar) as id, s_name as title from supplier union all select 'nation', cast(n_nationkey as varchar), n_name from nation where n_nationkey not in (select s_suppkey from supplier)
        union all select 'part', cast(p_partkey as varchar), p_name from part where p_partkey not in (select s_suppkey from supplier) and p_partkey not in (select n_nationkey from nation)""",
    "history_blocks": f"select conv_id, 'Conversation so far:' || chr(10) || {_strip('''string_agg(coalesce(role, 'unknown') || ': ' || coalesce(text, ''), chr(10) order by turn)''')} || chr(10) || chr(10) as block from conversations group by conv_id",
    "parse_reports": "select n_name, n_name as title, 'first of ' || n_name || chr(10) || 'second line' as body from nation",
    "parse_answers": "select event_id, props as payload, 'TRUE' as status, coalesce(nullif(cast(trunc(value) as bigint), 0), 50) as score from events",
    "index_statistics": f"""with {LINKED} select (select count(*) from units) as text_units, (select count(distinct unit_id) from phrases) as text_units_with_entities, (select count(*) from entities) as entities, (select count(*) from entities) as entities_with_sources,
        (select count(*) from relationships) as relationships, (select count(*) from claims) as covariates, (select count(*) from linked_documents) as documents, (select count(*) from nation) + (select count(*) from region) as communities,
        2::bigint as community_levels, (select count(*) from nation) + (select count(*) from region) as community_reports""",
    "vector_topk_cosine": _nearest(f"list_cosine_similarity(embedding::double[], {_VECTOR})"),
    "vector_topk_l2": _nearest(f"-list_distance(embedding::double[], {_VECTOR})"),
    "vector_topk_dot": _nearest(f"list_inner_product(embedding::double[], {_VECTOR})"),
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
