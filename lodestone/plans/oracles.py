"""Pieces of DuckDB SQL that several queries share."""

_RAW = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_CAMEL = r"string_split(regexp_replace(regexp_replace(w, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ')"
_DIGITS = r"string_split(regexp_replace(regexp_replace(w, '(\p{L})([0-9])', '\1 \2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g'), ' ')"


def tokens(text: str) -> str:
    """Distinct code tokens as a list, in no order."""
    return f"list_distinct(list_transform(flatten(list_transform({_RAW.format(text)}, lambda w: list_concat([w], list_concat({_CAMEL}, {_DIGITS})))), lambda t: lower(t)))"


def lines(text: str) -> str:
    return rf"case when coalesce({text}, '') = '' then []::varchar[] else regexp_split_to_array(regexp_replace({text}, '\r?\n$', ''), '\r?\n') end"


CHUNKS = f"""chunks as (
  select doc_id as chunk_id, lang as index_id, source || '/' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.rs' else '.txt' end as file,
    1 as start_line, len({lines('text')}) as end_line, text as content from documents
)"""

POSTINGS = f"""posted as (select doc_id, lang, {tokens('text')} as ts from documents),
postings as (select doc_id, lang, len(ts) as dl, unnest(ts) as term from posted),
stats as (select count(*) as n, avg(len(ts)) as avgdl from posted)"""


def bm25(queries: str) -> str:
    """CTEs that end in lexical(query_id, chunk_id, score, rank) for a relation of (query_id, text)."""
    return f"""{POSTINGS},
asked as (select query_id, unnest({tokens('text')}) as term from ({queries})),
df as (select term, count(*) as df from postings group by term),
lexical_scores as (
  select query_id, doc_id as chunk_id, sum(ln((n - df.df + 0.5) / (df.df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) as score
  from asked join postings using (term) join df using (term) cross join stats group by query_id, doc_id
),
lexical as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from lexical_scores)"""


COSINE = "list_cosine_similarity({0}::double[], {1}::double[])"

VECTORS = f"""vector_scores as (
  select q.item_id as query_id, c.vec_id as chunk_id, {COSINE.format('qe.embedding', 'c.embedding')} as score
  from benchmark q join embeddings qe on qe.vec_id = q.item_id cross join embeddings c
),
vectors as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from vector_scores)"""

SYMBOLS = """symbol_chunks as (
  select 'part:' || p_partkey as chunk_id, p_brand || '.rs' as file, p_partkey + 1 as start_line, 'p' || p_partkey as name, 'Function' as kind, coalesce(calls, []) as calls, []::varchar[] as bases
  from part left join (select l_partkey, list(distinct 's' || l_suppkey) as calls from lineitem group by l_partkey) on p_partkey = l_partkey
  union all
  select 'supp:' || s_suppkey, 'nation' || s_nationkey || '.rs', s_suppkey + 1, 'mod::s' || s_suppkey, 'Class', ['s' || (s_suppkey + 1)], ['p' || s_suppkey] from supplier
),
nodes as (select name as symbol, chunk_id, file from symbol_chunks),
mentions as (
  select name as src, unnest(calls) as dst, 'CallsFunction' as kind from symbol_chunks union all select name, unnest(bases), 'Implements' from symbol_chunks
),
edges as (
  select src, coalesce(x.symbol, y.symbol) as dst, kind from mentions m
  left join nodes x on x.symbol = m.dst left join nodes y on y.symbol = 'mod::' || m.dst
  where coalesce(x.symbol, y.symbol) is not null and src <> coalesce(x.symbol, y.symbol)
)"""


def word(pattern: str) -> str:
    """A pattern between borders of words, for an engine whose own borders know ASCII alone."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])"


def intent(text: str) -> str:
    # The patterns and their order, in this engine's syntax.
    chain = (
        ("Usage", "tested by|co-occurs"), ("Definition", "implements|derives from|aliased as"), ("BugDebt", "raises|documented by"),
        ("Definition", r"definition|interface|schema|model|enum|[A-Za-z][a-zA-Z0-9]+\s+(definition|struct|class|interface|type|schema|enum|trait|model)"),
        ("BugDebt", r"error\s+handling|deprecated|legacy|missing\s+validation|hardcoded"), ("Usage", "where is|callers of|who calls|uses of|usages|called by"),
    )
    cases = [f"when regexp_matches({text}, '{word(p)}') then '{label}'" for label, p in chain]
    cases.append(rf"when regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])((fn |struct |impl |trait |enum |type |def |class |function )[\p{{L}}\p{{N}}_]|define($|[^\p{{L}}\p{{N}}_]))') then 'Definition'")
    cases.append(f"when regexp_matches({text}, '{word('how does|what is|explain|overview|architecture|design|why')}') then 'Conceptual'")
    cases.append(rf"when regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])((TODO|FIXME|HACK|bug|error|crash|fail)($|[^\p{{L}}\p{{N}}_])|(panic!|unwrap\(\))[\p{{L}}\p{{N}}_])') then 'BugDebt'")
    cases.append(rf"when regexp_matches(trim({text}), '^[^():_.]+(\s+[^():_.]+){{5,}}$') then 'Conceptual'")
    cases.append(rf"when regexp_matches(trim({text}), '(^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+[A-Z][a-zA-Z0-9]*|[A-Z]{{2,}}([0-9]+[A-Za-z][a-zA-Z0-9]*|[0-9]+|[A-Z][a-z][a-zA-Z0-9]*))($|[^\p{{L}}\p{{N}}_])') then 'Definition'")
    return f"case {' '.join(cases)} else 'Unknown' end"
