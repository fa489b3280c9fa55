"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
with digests as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages
)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from digests
"""

OP6 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""

OP7 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from words
), tokens as (
  select doc_id, len(s) as n, unnest(s) as t from sets
), held as (
  select *, count(*) over (partition by t) as df from tokens
), links as (
  select a.doc_id as a, b.doc_id as b from held a join held b on a.t = b.t and a.doc_id <> b.doc_id where a.df > 1
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id from sets s join (select a, min(b) as component_id from reach group by a) c on c.a = s.doc_id
"""

OP12 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ts from documents where text is not null
), stats as (
  select count(*) as n_docs, sum(len(ts))::bigint as n_terms from d where len(ts) > 0
), postings as (
  select doc_id, n, t, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as t from d) group by all
), weights as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*) as df from postings group by t), stats
), asked as (
  select item_id, t, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as t from benchmark where text is not null) group by all
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
  from asked join postings using (t) join weights using (t), stats group by item_id, doc_id
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

SQL = {"op1_warc_round_trip": OP1, "op6_exact_top_k": OP6, "op7_jaccard_join": OP7, "op12_tiered_search": OP12}
