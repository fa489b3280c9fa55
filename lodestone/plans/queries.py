"""One registered query for each operator that the tables can feed, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import intent as intents
from lodestone.functions import sql as sql_functions
from lodestone.functions.text import code_tokens, doc_demotion, excluded, first_part_matches, fingerprint, snippet, token_estimate
from lodestone.operators import cells, concepts, fusion, graph, lexical, search, store, vectors
from lodestone.operators.inverted import LexicalIndex
from lodestone.operators.shared import shared_path
from lodestone.plans import oracles as o
from lodestone.plans.tables import benchmark_queries, document_chunks, document_index, document_vectors, kept_symbols, symbol_chunks, symbol_graph, table, vector_cells
from lodestone.sources import chunks as chunkers
from lodestone.sources.declarations import virtual_terms
from lodestone.sources.files import in_skipped_folder, language, skipped_path
from lodestone.streaming.changes import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _asked(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


LITERAL = ("the thanedble de", "of and ther", "éeaux le ouè", "geheit ungein", "ciónrauedo los")
INTENTS = (
    "fn search_hybrid", "struct CodeIndexer", "callers of search_hybrid", "where is CodeIndexer used", "how does the search work", "what is BM25",
    "TODO items in search", "FIXME authentication", "callers of fn search_hybrid", "which types implements Embedder", "structs that derives from Default",
    "authenticate tested by login_test", "functions that raises ConfigError", "RoomType definition", "schema for reservations", "legacy booking code",
    "a panic! b", "a panic!b", "the quick brown fox jumps over", "CodeIndexer", "HTTP2Client", "plain words", "why", "define", "defined", "unwrap()x",
)


def _values(texts: tuple[str, ...]) -> str:
    return "select * from (values " + ", ".join(f"({i}::bigint, '{t}')" for i, t in enumerate(texts)) + ") as t(query_id, text)"


# Lexical lane


@query(f"select doc_id, len(ts)::int as n_tokens, sha256(array_to_string(list_sort(ts), ' ')) as tokens_sha256 from (select doc_id, {o.tokens('text')} as ts from documents)")
def tokenize_code(spark, sf_dir):
    ts = code_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ts).alias("n_tokens"), F.sha2(F.array_join(ts, " "), 256).alias("tokens_sha256"))


@query(f"with {o.POSTINGS} select lang as index_id, count(*) as n, round(avg(len(ts)), 6) as avgdl from posted group by lang")
def bm25_corpus_stats(spark, sf_dir):
    found = document_index(spark, sf_dir).corpus_stats(("index_id",))
    return found.select("index_id", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {o.POSTINGS} select term, count(*) as df from postings group by term")
def bm25_term_stats(spark, sf_dir):
    return document_index(spark, sf_dir).term_stats()


@query(f"with {o.bm25(_values(LITERAL))} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from lexical where rank <= 10")
def bm25_topk(spark, sf_dir):
    found = document_index(spark, sf_dir).top(_asked(spark, LITERAL), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {o.bm25('select item_id as query_id, text from benchmark')} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from lexical where rank <= 20")
def bm25_batch_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = document_index(spark, sf_dir).top(asked, 20)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_UPDATED = "documents_now as (select doc_id, lang, case when source = 'src1' then text || ' fresh renewed' else text end as text from documents where source is null or source <> 'src2')"


def _updated(spark, sf_dir):
    """The index after an update that changes one folder's files and removes another's."""
    chunk = document_chunks(spark, sf_dir)
    index = LexicalIndex.build(chunk, shared_path(spark, "updated-index"))
    changed = chunk.where("file like 'src1/%'").withColumn("content", F.concat("content", F.lit(" fresh renewed")))
    index.update(1, chunk.where("file like 'src1/%' or file like 'src2/%'").select("file"), changed)
    return index


@query(f"with {_UPDATED}, {o.bm25('select item_id as query_id, text from benchmark').replace('from documents', 'from documents_now')} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from lexical where rank <= 10")
def bm25_after_update(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _updated(spark, sf_dir).top(asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_UPDATED}, {o.POSTINGS.replace('from documents', 'from documents_now')} select lang as index_id, term, count(*) as df from postings group by all")
def bm25_term_stats_after_update(spark, sf_dir):
    return _updated(spark, sf_dir).term_stats(("index_id",))


# Vector lane


@query(f"with {o.VECTORS} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from vectors where rank <= 10")
def vector_topk(spark, sf_dir):
    found = vectors.cosine_top(document_vectors(spark, sf_dir), benchmark_queries(spark, sf_dir).where("embedding is not null"), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""select chunk_id, round(score, 6) as score, row_number() over (order by round(score, 9) desc, chunk_id)::int as rank from (
  select c.vec_id as chunk_id, {o.COSINE.format('s.embedding', 'c.embedding')} as score from embeddings s cross join embeddings c where s.vec_id = 7 and c.vec_id <> 7) order by rank limit 10""")
def vector_similar_to_seed(spark, sf_dir):
    return vectors.similar_to(document_vectors(spark, sf_dir), 7, 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {o.VECTORS} select query_id, chunk_id, round(score, 6) as score, rank::int as rank from vectors where rank <= 10")
def vector_cells_exact(spark, sf_dir):
    """The same rows as vector_topk, from the cells that can hold them."""
    index = vector_cells(spark, sf_dir)
    return index.top(benchmark_queries(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_cells_recall(spark, sf_dir):
    """What a probe of a part of the cells finds of the exact best rows."""
    asked, index = benchmark_queries(spark, sf_dir), vector_cells(spark, sf_dir)
    probe = index.top(asked, 10, probe=max(1, len(index.cells) // 2))
    return cells.recall(probe, vectors.cosine_top(document_vectors(spark, sf_dir), asked.where("embedding is not null"), 10)).select("query_id", "hits", "wanted", "recall")


_GROUPS = "points as (select label, vec_id, embedding::double[] as e from embeddings), sized as (select label, greatest(1, least(20, count(*) // 2)) as k from points group by label)"


def _round(centres: str, out: str) -> str:
    """CTEs of one round of k-means: assignment to `centres`, and the means as `out`."""
    squared = "list_sum(list_transform(list_zip(p.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""{out}_near as (select p.label, p.vec_id, p.e, arg_min(c.cluster, (round({squared}, 12), c.cluster)) as cluster from points p join {centres} c using (label) group by p.label, p.vec_id, p.e),
{out} as (select label, cluster, list(x order by i) as e from (select label, cluster, i, avg(x) as x from (select label, cluster, unnest(e) as x, generate_subscripts(e, 1) as i from {out}_near) group by all) group by all)"""


@query(f"""with {_GROUPS}, m0 as (select label, (row_number() over (partition by label order by vec_id) - 1)::int as cluster, e from points join sized using (label) qualify cluster < k),
{_round('m0', 'm1')}, {_round('m1', 'm2')}, {_round('m2', 'm3')} select label, vec_id, cluster::int as cluster from m3_near""")
def concept_clusters_grouped(spark, sf_dir):
    """Clusters of all groups of vectors together, after two rounds."""
    found = concepts.grouped_kmeans(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", id="vec_id", most_rounds=2, tolerance=0.0)
    return found.select("label", "vec_id", F.col("cluster").cast("int").alias("cluster"))


# Fusion and search

_LANES = f"{o.bm25('select item_id as query_id, text from benchmark')}, {o.VECTORS}"


@query(f"""with {_LANES}, parts as (
  select query_id, chunk_id, 0.5 / (60 + rank) as part from lexical where rank <= 40 union all select query_id, chunk_id, 0.5 / (60 + rank) from vectors where rank <= 40
), fused as (select query_id, chunk_id, sum(part) as score from parts group by all)
select * from (select query_id, chunk_id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id)::int as rank from fused) where rank <= 10""")
def rrf_fuse(spark, sf_dir):
    asked = benchmark_queries(spark, sf_dir)
    words = document_index(spark, sf_dir).top(asked, 40)
    near = vectors.cosine_top(document_vectors(spark, sf_dir), asked.where("embedding is not null"), 40)
    found = fusion.fused([fusion.lane(words, 0.5), fusion.lane(near, 0.5)], 10)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"""with {_LANES}, {o.CHUNKS}, intents as (select item_id as query_id, {o.intent('text')} as intent from benchmark),
weights as (select *, case intent when 'Definition' then 0.3 when 'Usage' then 0.5 when 'Conceptual' then 0.8 when 'BugDebt' then 0.1 else 0.6 end as alpha from intents),
parts as (
  select query_id, chunk_id, (1 - alpha) / (60 + rank) as part from lexical join weights using (query_id) where rank <= 40
  union all select query_id, chunk_id, alpha / (60 + rank) from vectors join weights using (query_id) where rank <= 40
), fused as (select query_id, chunk_id, sum(part) as score from parts group by all),
first as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) as r from fused) where r <= 10),
scaled as (
  select query_id, chunk_id, file, content, score * case when intent = 'Definition' and regexp_matches(file, '\\.(md|txt)$') then 0.5 else 1 end * case when file like 'src1/%' then 1.5 else 1 end as score, file like 'src1/%' as on_branch
  from first join weights using (query_id) left join chunks using (chunk_id)
)
select * from (select s.query_id, s.chunk_id, file, round(s.score, 9) as score, row_number() over (partition by s.query_id order by round(s.score, 12) desc, s.chunk_id)::int as rank, on_branch,
  case when v.rank is not null and l.rank is not null then 'hybrid' when v.rank is not null then 'vector' when l.rank is not null then 'bm25' else 'fallback' end as match_reason
from scaled s left join (select * from vectors where rank <= 40) v using (query_id, chunk_id) left join (select * from lexical where rank <= 40) l using (query_id, chunk_id)) where file is not null""")
def hybrid_search(spark, sf_dir):
    chunk = document_chunks(spark, sf_dir)
    index = search.Index(chunk, document_vectors(spark, sf_dir), kept=document_index(spark, sf_dir))
    branch = chunk.where("file like 'src1/%'").select("file")
    found = search.search(index, benchmark_queries(spark, sf_dir), top=10, branch=branch, boost=1.5)
    return found.select("query_id", "chunk_id", "file", F.round("score", 9).alias("score"), "rank", "on_branch", "match_reason")


@query(f"""select query_id, intent, case intent when 'Definition' then 0.3 when 'Usage' then 0.5 when 'Conceptual' then 0.8 when 'BugDebt' then 0.1 else 0.6 end::double as alpha, intent = 'Usage' as use_graph
from (select query_id, {o.intent('text')} as intent from ({_values(INTENTS)}) union all select 1000 + conv_id * 100 + turn, {o.intent('text')} from conversations)""")
def intent_classify(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("query_id"), "text")
    found = _asked(spark, INTENTS).unionByName(turns).withColumn("intent", intents.intent(F.col("text")))
    return found.withColumn("w", intents.weights(F.col("intent"))).select("query_id", "intent", "w.alpha", "w.use_graph")


@query(f"""select query_id, case when intent = 'Unknown' and (contains(lower(text), 'plain') or contains(lower(text), 'the')) then 'Definition' else intent end as intent
from (select item_id as query_id, text, {o.intent('text')} as intent from benchmark union all select 100000 + query_id, text, {o.intent('text')} from ({_values(INTENTS)}))""")
def intent_with_domain_terms(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(_asked(spark, INTENTS).withColumn("query_id", F.col("query_id") + 100000))
    return asked.select("query_id", intents.domain_intent(F.col("text"), ["Plain ", "", "the"]).alias("intent"))


@query(f"with {o.CHUNKS} select chunk_id, file, case when regexp_matches(lower(file), '\\.(md|txt|toml|ya?ml|json)$') then 0.5 else 1 end::double as factor from chunks")
def doc_demotion_factor(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("chunk_id", "file", doc_demotion(F.col("file")).alias("factor"))


@query(f"""with {o.bm25(_values(LITERAL))}, hit as (select query_id, min(chunk_id) as chunk_id from lexical group by query_id), rest as (
  select l.query_id, l.chunk_id, l.rank from lexical l left join hit h on h.query_id = l.query_id and h.chunk_id = l.chunk_id where l.rank <= 20 and h.chunk_id is null
) select query_id, chunk_id, 1 as rank from hit union all select query_id, chunk_id, (1 + row_number() over (partition by query_id order by rank))::int from rest""")
def entity_promotion(spark, sf_dir):
    scored = document_index(spark, sf_dir).top(_asked(spark, LITERAL), 1_000_000_000)
    hits = scored.groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    return fusion.promoted(scored.where("rank <= 20"), hits).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


_BY_LANG = f"""{o.POSTINGS}, asked as (select query_id, unnest({o.tokens('text')}) as term from ({_values(LITERAL)})),
lang_stats as (select lang, count(*) as n, avg(len(ts)) as avgdl from posted group by lang),
df as (select lang, term, count(*) as df from postings group by lang, term),
scored as (
  select query_id, p.lang as index_id, p.doc_id as chunk_id, sum(ln((n - df.df + 0.5) / (df.df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) as score
  from asked join postings p using (term) join df on df.term = p.term and df.lang = p.lang join lang_stats s on s.lang = p.lang group by all
),
lanes as (select * from (select query_id, index_id, index_id || '::' || chunk_id as chunk_id, row_number() over (partition by query_id, index_id order by round(score, 9) desc, chunk_id) as rank from scored) where rank <= 10)"""


def _lanes_by_language(spark, sf_dir):
    return document_index(spark, sf_dir).top(_asked(spark, LITERAL), 10, by=("index_id",))


@query(f"with {_BY_LANG} select query_id, chunk_id, round(1.0 / (60 + rank), 9)::double as score, row_number() over (partition by query_id order by round(1.0 / (60 + rank), 12) desc, chunk_id)::int as rank from lanes qualify row_number() over (partition by query_id order by round(1.0 / (60 + rank), 12) desc, chunk_id) <= 10")
def fan_out_flat(spark, sf_dir):
    found = search.fan_out(_lanes_by_language(spark, sf_dir), top=10)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _folded() -> str:
    ctes, before = [], None
    for i, lang in enumerate(("de", "en", "es", "fr")):
        own = f"select query_id, chunk_id, rank from lanes where index_id = '{lang}'"
        if before is None:
            ctes.append(f"m0 as ({own})")
        else:
            ctes.append(f"m{i} as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) as rank from (select query_id, chunk_id, sum(1.0 / (60 + rank))::double as score from (select query_id, chunk_id, rank from {before} union all {own}) group by all)) where rank <= 40)")
        before = f"m{i}"
    return f"with {_BY_LANG}, {', '.join(ctes)} select query_id, chunk_id, round(score, 9) as score, rank::int as rank from m3 where rank <= 10"


@query(_folded())
def fan_out_fold(spark, sf_dir):
    found = search.fan_out(_lanes_by_language(spark, sf_dir), top=10, mode="fold")
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""with {_BY_LANG} select query_id, index_id, split_part(id, '::', 2)::bigint as chunk_id, score, rank from (
  select query_id, index_id, chunk_id as id, round(1.0 / (60 + rank), 9)::double as score, row_number() over (partition by query_id order by round(1.0 / (60 + rank), 12) desc, chunk_id)::int as rank from lanes where index_id in ('de', 'en')
) where rank <= 10""")
def fan_out_search(spark, sf_dir):
    chunk = document_chunks(spark, sf_dir)
    indexes = {name: search.Index(chunk.where(F.col("index_id") == name)) for name in ("de", "en", "es", "fr")}
    found = search.search_all(indexes, _asked(spark, LITERAL), only=("en", "de", "absent"), top=10)
    return found.select("query_id", "index_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


_CENTRES = "centres as (select label, list(x order by i) as embedding from (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label)"
_ROUTES = f"with {_CENTRES}, weights as (select q.item_id as query_id, c.label as index_id, greatest(0, {o.COSINE.format('e.embedding', 'c.embedding')}) as weight from benchmark q join embeddings e on e.vec_id = q.item_id cross join centres c)"


def _routes(spark, sf_dir):
    contexts = concepts.centroids(table(spark, sf_dir, "embeddings"), "label").withColumnRenamed("label", "index_id")
    return vectors.routing_weights(benchmark_queries(spark, sf_dir).where("embedding is not null"), contexts)


@query(f"{_ROUTES} select query_id, index_id, round(weight, 6) as weight from weights")
def routing_all(spark, sf_dir):
    return _routes(spark, sf_dir).select("query_id", "index_id", F.round("weight", 6).alias("weight"))


@query(f"{_ROUTES} select query_id, index_id, 1::double as weight from weights qualify row_number() over (partition by query_id order by round(weight, 9) desc, index_id) <= 3")
def routing_top_n(spark, sf_dir):
    return vectors.routed(_routes(spark, sf_dir), "top_n", n=3)


@query(f"{_ROUTES} select query_id, index_id, round(weight, 6) as weight from weights where round(weight, 9) >= 0.3")
def routing_threshold(spark, sf_dir):
    return vectors.routed(_routes(spark, sf_dir), "threshold").select("query_id", "index_id", F.round("weight", 6).alias("weight"))


def _diverse(most: int) -> str:
    """CTEs of the greedy order: each step takes the candidate with the best balance of its score and its likeness to those taken."""
    steps = ["t0 as (select null::bigint as query_id, null::bigint as chunk_id, null::int as rank where false)"]
    for n in range(1, most + 1):
        steps.append(f"""n{n} as (select c.query_id, c.chunk_id, c.score, c.pos, greatest(0, coalesce(max(s.likeness), 0)) as near from candidates c left join t{n - 1} t on t.query_id = c.query_id
  left join alike s on s.query_id = c.query_id and s.a = c.chunk_id and s.b = t.chunk_id where (c.query_id, c.chunk_id) not in (select (query_id, chunk_id) from t{n - 1}) group by all),
t{n} as (select * from t{n - 1} union all select query_id, chunk_id, {n} from (select * from n{n} qualify row_number() over (partition by query_id order by round(0.5 * score - 0.5 * near, 12) desc, pos desc) = 1))""")
    return ",\n".join(steps)


@query(f"""with {o.VECTORS}, candidates as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as pos from vectors where rank <= 10),
alike as (select a.query_id, a.chunk_id as a, b.chunk_id as b, {o.COSINE.format('x.embedding', 'y.embedding')} as likeness from candidates a join candidates b using (query_id) join embeddings x on x.vec_id = a.chunk_id join embeddings y on y.vec_id = b.chunk_id where a.chunk_id <> b.chunk_id),
{_diverse(10)} select t.query_id, t.chunk_id, round(c.score, 6) as score, t.rank::int as rank from t10 t join candidates c using (query_id, chunk_id)""")
def mmr_rerank(spark, sf_dir):
    near = vectors.cosine_top(document_vectors(spark, sf_dir), benchmark_queries(spark, sf_dir).where("embedding is not null"), 10)
    return fusion.diverse(near.join(document_vectors(spark, sf_dir), "chunk_id")).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_CENTRES} select c.label, 'word' || v.vec_id as concept, round({o.COSINE.format('c.embedding', 'v.embedding')}, 6) as likeness from centres c cross join embeddings v where v.vec_id < 15
qualify row_number() over (partition by c.label order by round({o.COSINE.format('c.embedding', 'v.embedding')}, 9) desc, v.vec_id) = 1""")
def concept_label(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "embeddings").where("vec_id < 15").select(F.concat(F.lit("word"), F.col("vec_id").cast("string")).alias("word"), F.col("vec_id").alias("at"), "embedding")
    found = concepts.labelled(concepts.centroids(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "label_id"), "label_id"), vocabulary, "label_id")
    return found.select(F.col("label_id").alias("label"), F.col("label").alias("concept"), F.round("likeness", 6).alias("likeness"))


@query(f"""with {o.bm25("select item_id as query_id, text from benchmark")}, firsts as (
  select b.item_id as query_id, min(l.rank) as first from benchmark b join lexical l on l.query_id = b.item_id and l.rank <= 10 join documents d on d.doc_id = l.chunk_id and contains(d.text, b.text) group by b.item_id
) select case when b.item_id % 2 = 0 then 'even' else 'odd' end as intent, round(avg(case when first <= 5 then 1.0 / first else 0 end), 6)::double as mrr, round(avg(case when first <= 10 then 1.0 else 0 end), 6)::double as recall, count(*) as queries
from benchmark b left join firsts f on f.query_id = b.item_id group by all""")
def retrieval_quality(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunk = document_chunks(spark, sf_dir)
    results = document_index(spark, sf_dir).top(asked, 10).join(chunk.select("chunk_id", "content"), "chunk_id")
    expected = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("intent"), F.col("text").alias("needle"))
    found = fusion.retrieval_quality(results, expected)
    return found.select("intent", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"), "queries")


# Graph


@query(f"with {o.SYMBOLS} select symbol, chunk_id, file from nodes")
def symbol_nodes(spark, sf_dir):
    return graph.nodes(symbol_chunks(spark, sf_dir))


@query(f"with {o.SYMBOLS} select src, dst, kind from edges")
def symbol_edges(spark, sf_dir):
    return graph.edges(symbol_chunks(spark, sf_dir))


@query(f"with {o.SYMBOLS} select distinct a.name as src, b.name as dst, 'ModuleContains' as kind from symbol_chunks a join symbol_chunks b using (file) where a.kind = 'Class' and a.name <> b.name")
def module_contains(spark, sf_dir):
    return graph.contains(symbol_chunks(spark, sf_dir))


@query(f"with {o.SYMBOLS} select distinct dst as start, src as symbol, 1 as hop from edges where kind = 'CallsFunction'")
def callers_one_hop(spark, sf_dir):
    node, edge = symbol_graph(spark, sf_dir)
    return graph.reached(edge, node.select(F.col("symbol").alias("start")), 1, backwards=True)


@query(f"""with {o.SYMBOLS}, one as (select distinct src as start, dst as symbol from edges where kind = 'CallsFunction'),
two as (select distinct a.start, b.symbol from one a join one b on a.symbol = b.start where b.symbol <> a.start)
select start, symbol, 1 as hop from one union all select start, symbol, 2 from (select * from two except select * from one)""")
def callees_two_hops(spark, sf_dir):
    node, edge = symbol_graph(spark, sf_dir)
    return graph.reached(edge, node.select(F.col("symbol").alias("start")), 2)


@query(f"""with recursive {o.SYMBOLS}, step as (select distinct src, dst from edges where kind = 'CallsFunction'),
walk(start, symbol, hop) as (select src, dst, 1 from step union select w.start, s.dst, w.hop + 1 from walk w join step s on s.src = w.symbol where w.hop < 4)
select start, symbol, min(hop)::int as hop from walk where symbol <> start group by all""")
def callees_four_hops(spark, sf_dir):
    node, edge = symbol_graph(spark, sf_dir)
    return graph.reached(edge, node.select(F.col("symbol").alias("start")), 4)


@query(f"""with recursive {o.SYMBOLS}, one as (select src, dst from edges where kind in ('CallsFunction', 'Implements')), step as (select src, dst from one union select dst, src from one),
starts as (select symbol as start from nodes where symbol like 'mod::%')
select distinct start, a.dst as symbol, 1 as hop from starts join step a on a.src = start where a.dst <> start""")
def neighbours_of_suppliers(spark, sf_dir):
    node, edge = symbol_graph(spark, sf_dir)
    starts = node.where(F.col("symbol").startswith("mod::")).select(F.col("symbol").alias("start"))
    return graph.reached(edge, starts, 1, both=True, kinds=("CallsFunction", "Implements"))


@query(f"""with {o.SYMBOLS}, seeds as (select l_partkey % 50 as query_id, 'part:' || l_partkey as chunk_id, max(l_quantity) as score from lineitem group by l_partkey),
near as (select src, dst from edges where kind = 'CallsFunction' union select dst, src from edges where kind = 'CallsFunction')
select s.query_id, n.chunk_id, round(max(s.score * 0.7), 6) as score from seeds s join symbol_chunks c using (chunk_id) join near on near.src = c.name join nodes n on n.symbol = near.dst
where (s.query_id, n.chunk_id) not in (select (query_id, chunk_id) from seeds) group by s.query_id, n.chunk_id""")
def graph_expansion(spark, sf_dir):
    chunk = symbol_chunks(spark, sf_dir)
    item = table(spark, sf_dir, "lineitem")
    seeds = item.groupBy("l_partkey").agg(F.max("l_quantity").alias("score")).select((F.col("l_partkey") % 50).alias("query_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("chunk_id"), "score")
    found = graph.expanded(seeds, chunk.select("chunk_id", F.col("function_name").alias("symbol")), *symbol_graph(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"with {o.SYMBOLS} select src, dst, kind, case kind when 'CallsFunction' then 0.7 else 0.85 end::double as weight from edges where case kind when 'CallsFunction' then 0.7 else 0.85 end >= 0.8")
def graph_export(spark, sf_dir):
    chunk = symbol_chunks(spark, sf_dir)
    _, links = graph.exported(graph.nodes(chunk), graph.edges(chunk), node_kinds=("symbol",), edge_kinds=("callsfunction", "implements"), least=0.8)
    return links.select("src", "dst", "kind", "weight")


_ASKED_SYMBOLS = "select n_nationkey::bigint as query_id, case n_nationkey % 3 when 0 then 'callers of s' || n_nationkey when 1 then 'p' || n_nationkey else 'function p' || n_nationkey end as text from nation"


@query(f"""with {o.SYMBOLS}, texts as (select chunk_id, file, start_line, name, kind || ' ' || name || ' ' || array_to_string(calls, ' ') as content from symbol_chunks),
intents as (select *, {o.intent('text')} as intent from ({_ASKED_SYMBOLS})), posted as (select chunk_id, {o.tokens('content')} as ts from texts),
postings as (select chunk_id, len(ts) as dl, unnest(ts) as term from posted), stats as (select count(*) as n, avg(len(ts)) as avgdl from posted),
asked as (select query_id, unnest({o.tokens('text')}) as term from intents), df as (select term, count(*) as df from postings group by term),
scored as (select query_id, chunk_id, sum(ln((n - df.df + 0.5) / (df.df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) as score from asked join postings using (term) join df using (term) cross join stats group by all),
plain as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from scored qualify rank <= 40),
hit as (select query_id, arg_min(chunk_id, (t.file, t.start_line, t.chunk_id)) as chunk_id from intents i join texts t on lower(t.name) = lower(trim(i.text)) where intent in ('Definition', 'Unknown') and not contains(trim(i.text), ' ') group by query_id),
lane as (
  select query_id, chunk_id, 1 as rank from hit union all
  select p.query_id, p.chunk_id, row_number() over (partition by p.query_id order by p.rank) + (h.chunk_id is not null)::int from plain p left join hit h on h.query_id = p.query_id where h.chunk_id is null or h.chunk_id <> p.chunk_id
),
fused as (select query_id, chunk_id, case intent when 'Definition' then 0.7 when 'Usage' then 0.5 when 'Conceptual' then 0.2 when 'BugDebt' then 0.9 else 0.4 end::double / (60 + rank) as score, intent from lane join intents using (query_id)),
first as (select * from fused qualify row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) <= 10), seeds as (select * from first where intent = 'Usage'),
ways as (select src, dst from edges where kind = 'CallsFunction' union select dst, src from edges where kind = 'CallsFunction'),
near as (select s.query_id, n.chunk_id, max(s.score * 0.7) as score from seeds s join texts t using (chunk_id) join ways w on w.src = t.name join nodes n on n.symbol = w.dst where (s.query_id, n.chunk_id) not in (select (query_id, chunk_id) from seeds) group by all),
final as (select query_id, chunk_id, score, 'bm25' as match_reason from first union all select n.query_id, n.chunk_id, n.score, case when l.rank is null then 'hybrid+kg' else 'bm25' end from near n left join lane l using (query_id, chunk_id))
select query_id, chunk_id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id)::int as rank, match_reason from final qualify rank <= 10""")
def graph_search(spark, sf_dir):
    """Lexical lane, entities, intents and the symbol graph together."""
    symbols = kept_symbols(spark, sf_dir)
    chunk = symbols.withColumns({"content": F.concat_ws(" ", "chunk_type", "function_name", F.array_join("calls", " ")), "end_line": F.col("start_line")})
    entities = symbols.select(F.lit("NamedType").alias("entity_type"), F.col("function_name").alias("text"), "file", F.col("start_line").alias("line"))
    key = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("callers of s"), key)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("p"), key)).otherwise(F.concat(F.lit("function p"), key))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), text.alias("text"))
    found = search.search(search.Index(chunk, None, entities, *symbol_graph(spark, sf_dir)), asked, top=10)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank", "match_reason")


# Chunkers

_FILES = "files as (select source || '/' || doc_id || '.txt' as file, text as content from documents)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.col("text").alias("content"))


def _digest(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", "file", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.sha2("content", 256).alias("content_sha256"))


def _sliding(size: int, stride: int) -> str:
    return f"""with {_FILES}, rows as (select file, {o.lines('content')} as r from files),
spans as (select file, r, unnest(range(0, greatest(ceil((len(r) - {size}) / {stride}.0), 0)::int + 1)) * {stride} as s from rows where len(r) > 0)
select file || ':' || (s + 1) || ':' || least(s + {size}, len(r)) as chunk_id, file, (s + 1)::int as start_line, least(s + {size}, len(r))::int as end_line, sha256(array_to_string(r[s + 1 : s + {size}], chr(10))) as content_sha256 from spans"""


@query(_sliding(10, 4))
def chunk_sliding(spark, sf_dir):
    return _digest(chunkers.sliding(_files(spark, sf_dir), 10, 4))


_LINES = f"{_FILES}, rows as (select file, {o.lines('content')} as r from files), numbered as (select file, generate_subscripts(r, 1) as nr, unnest(r) as line from rows)"
_PUT = "sha256(string_agg(line, chr(10) order by nr)) as content_sha256"


@query(f"""with {_LINES}, marked as (select *, sum(case when trim(regexp_replace(line, '\\s', ' ', 'g')) = '' then 1 else 0 end) over (partition by file order by nr) as paragraph, trim(regexp_replace(line, '\\s', ' ', 'g')) = '' as blank from numbered),
kept as (select *, (row_number() over (partition by file, paragraph order by nr) - 1) // 50 as part from marked where not blank),
found as (select file, min(nr)::int as start_line, max(nr)::int as end_line, {_PUT} from kept group by file, paragraph, part)
select file || ':' || start_line || ':' || end_line as chunk_id, * from found""")
def chunk_plaintext(spark, sf_dir):
    return _digest(chunkers.plaintext(_files(spark, sf_dir)))


_HEADED = "select source || '/' || doc_id || '.md' as file, replace(text, '. ', '.' || chr(10) || case when doc_id % 2 = 0 then '# ' else '' end) as content from documents"


@query(f"""with files as ({_HEADED}), rows as (select file, {o.lines('content')} as r from files), numbered as (select file, generate_subscripts(r, 1) as nr, unnest(r) as line from rows),
marked as (select *, (starts_with(ltrim(line, ' '), '#'))::int as head from numbered), cut as (select *, sum(head) over (partition by file order by nr) as section from marked),
found as (select file, min(nr)::int as start_line, max(nr)::int as end_line, {_PUT}, max(case when head = 1 then nullif(trim(regexp_replace(ltrim(line, ' '), '^#+', '')), '') end) as name,
  bool_or(trim(regexp_replace(line, '\\s', ' ', 'g')) <> '') as visible from cut group by file, section)
select case when name is null then file || ':' || start_line || ':' || end_line else file || '::Docstring::' || name || '::' || start_line end as chunk_id, file, start_line, end_line, content_sha256 from found where visible""")
def chunk_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 2 == 0, "# ").otherwise("")
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), mark)).alias("content"))
    return _digest(chunkers.markdown(files))


@query(f"""with {_FILES}, rows as (select file, {o.lines('content')} as r from files), whole as (select file, r, file || ':1:' || len(r) as id from rows where len(r) > 0),
spans as (select *, unnest(range(0, greatest(ceil((len(r) - 6) / 3.0), 0)::int + 1)) as i from whole where len(r) > 8)
select id as chunk_id, file, 1 as start_line, len(r)::int as end_line, sha256(array_to_string(r, chr(10))) as content_sha256 from whole
union all select id || '::sub::' || i, file, (i * 3 + 1)::int, least(i * 3 + 6, len(r))::int, sha256(array_to_string(r[i * 3 + 1 : i * 3 + 6], chr(10))) from spans""")
def split_oversized(spark, sf_dir):
    return _digest(chunkers.split_oversized(chunkers.whole(_files(spark, sf_dir)), 8, 6, 3))


@query(f"with {o.CHUNKS} select chunk_id, sha256(case when end_line <= 7 then content else array_to_string(({o.lines('content')})[1:7], chr(10)) end) as snippet_sha256 from chunks")
def compact_snippet(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("chunk_id", F.sha2(snippet(F.col("content")), 256).alias("snippet_sha256"))


@query(f"with {o.CHUNKS} select chunk_id, file, (select count(*) from chunks) as total from chunks order by file, start_line, end_line, chunk_id limit 100 offset 50")
def enumerate_page(spark, sf_dir):
    rows, total = search.counted_page(document_chunks(spark, sf_dir), 50, 100)
    return rows.select("chunk_id", "file", F.lit(total).cast("long").alias("total"))


@query(f"with {o.CHUNKS} select chunk_id, file from chunks where file like '%7.rs' order by start_line, file, chunk_id limit 1")
def find_seed(spark, sf_dir):
    return search.seed(document_chunks(spark, sf_dir), "7.rs").select("chunk_id", "file")


@query(f"""with {_sliding(10, 4)[5:]}""".replace("select file || ':' ||", ", spanned as (select file || ':' ||", 1) + """),
names as (select distinct d.source || '/' || d.doc_id || '.txt' as file, 1 + l.quality + 5 * l.toxic as line, 'name' || l.quality as text from labels l join documents d using (doc_id))
select chunk_id, count(*) as n_terms, string_agg(text, ',' order by line, text) as terms from (select chunk_id, text, min(line) as line from spanned s join names n on n.file = s.file and n.line between s.start_line and s.end_line group by chunk_id, text) group by chunk_id""")
def virtual_terms_in_chunks(spark, sf_dir):
    names = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), (1 + F.col("quality") + 5 * F.col("toxic")).alias("line"), F.concat(F.lit("name"), F.col("quality").cast("string")).alias("text")).distinct()
    found = virtual_terms(chunkers.sliding(_files(spark, sf_dir), 10, 4), names).where(F.size("virtual_terms") > 0)
    return found.select("chunk_id", F.size("virtual_terms").cast("long").alias("n_terms"), F.array_join("virtual_terms", ",").alias("terms"))


# The same by SQL


@query(SQL["tokenize_code"])
def sql_code_tokenize(spark, sf_dir):
    sql_functions.register(spark)
    return spark.sql("select doc_id, size(ts) as n_tokens, sha2(array_join(ts, ' '), 256) as tokens_sha256 from (select doc_id, code_tokenize(text) as ts from {docs})", docs=table(spark, sf_dir, "documents"))


@query(f"select conv_id, turn, {o.intent('text')} as intent from conversations")
def sql_query_intent(spark, sf_dir):
    sql_functions.register(spark)
    return spark.sql("select conv_id, turn, query_intent(text) as intent from {turns}", turns=table(spark, sf_dir, "conversations"))


@query(f"select c.vec_id as chunk_id, round({o.COSINE.format('s.embedding', 'c.embedding')}, 6) as score from embeddings s cross join embeddings c where s.vec_id = 3")
def sql_cosine(spark, sf_dir):
    sql_functions.register(spark)
    held = table(spark, sf_dir, "embeddings")
    seed = [float(x) for x in held.where("vec_id = 3").first().embedding]
    return spark.sql("select vec_id as chunk_id, round(cosine_sim(embedding, :seed), 6) as score from {held}", {"seed": F.array(*map(F.lit, seed))}, held=held)


@query(_sliding(10, 4))
def sql_lateral_chunks(spark, sf_dir):
    sql_functions.register(spark)
    return _digest(spark.sql("select f.file, c.* from {files} f, lateral chunk_lines(f.file, f.content, 10, 4) c", files=_files(spark, sf_dir)))


# Maintenance


@query("select doc_id as file, sha256(text) as content_sha256 from documents where doc_id % 7 in (0, 3)")
def incremental_changed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    now = docs.select(F.col("doc_id").alias("file"), fingerprint(F.col("text")).alias("content_sha256"))
    known = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("file"), fingerprint(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_sha256"))
    return store.changed(now, known)


@query("select doc_id as chunk_id, case when doc_id in (select doc_id from labels) then upper(lang) else lang end as lang from documents union all select 1000000000 + conv_id, min(role) from conversations group by conv_id")
def upsert_chunks(spark, sf_dir):
    """All documents, then the labelled ones again with a change, and conversations as new ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    changed = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").withColumn("lang", F.upper("lang"))
    fresh = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") + 1_000_000_000).alias("chunk_id")).agg(F.min("role").alias("lang"))
    return store.upserted(docs, changed.unionByName(fresh))


@query("select doc_id as chunk_id, source as file from documents where source not in ('src1', 'src7')")
def remove_files(spark, sf_dir):
    return store.without_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file")), ["src1", "src7"])


@query(f"with {o.CHUNKS} select index_id, chunk_id from chunks qualify row_number() over (partition by index_id order by file, start_line, chunk_id) <= 25")
def chunk_cap(spark, sf_dir):
    return graph.capped(document_chunks(spark, sf_dir), 25, ("index_id",)).select("index_id", "chunk_id")


@query(f"with {o.CHUNKS} select index_id, count(*) as chunks, count(distinct file) as files, sum(end_line)::bigint as lines from chunks group by index_id")
def index_status(spark, sf_dir):
    return store.status(document_chunks(spark, sf_dir))


_PATHS = """paths as (select page_id, regexp_replace(url, '[?#].*', '') || case page_id % 8 when 0 then '/app-1a2b3c4d.js' when 1 then '/node_modules/a.py' when 2 then '/Cargo.lock' when 3 then '/x.min.css' when 4 then '/a.PNG' when 5 then '/m.rs' when 6 then '/t.cc' else '/n.md' end as path, strlen(html) * 100 as n_bytes from pages)"""


@query(f"""with {_PATHS} select page_id, path, page_id % 8 in (0, 2, 3, 4) or n_bytes > 1048576 as skipped, page_id % 8 = 1 as in_folder, case page_id % 8 when 0 then 'javascript' when 1 then 'python' when 5 then 'rust' when 6 then 'cpp' end as language from paths""")
def path_skip(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, ("/app-1a2b3c4d.js", "/node_modules/a.py", "/Cargo.lock", "/x.min.css", "/a.PNG", "/m.rs", "/t.cc", "/n.md"))), (F.col("page_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*", ""), ends).alias("path"), (F.octet_length("html") * 100).alias("n_bytes"))
    path = F.col("path")
    return rows.select("page_id", "path", skipped_path(path, F.col("n_bytes")).alias("skipped"), in_skipped_folder(path).alias("in_folder"), language(path).alias("language"))


@query("select doc_id, source in ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') as matches, doc_id % 10 = 3 as dropped from documents")
def path_filter(spark, sf_dir):
    path = F.concat(F.lit("/root/"), F.col("source"), F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return table(spark, sf_dir, "documents").select("doc_id", first_part_matches(path, "/root", ["src1*"]).alias("matches"), excluded(path, ["*3.rs"]).alias("dropped"))


# Streams and what follows a search


@query("""with gaps as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minutes then 0 else 1 end as fresh from events),
sessions as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from gaps)
select user_id as file, count(*) as events, min(ts) as first_ts, max(ts) as last_ts, arg_max(event_type, ts) as op from sessions group by user_id, s""")
def debounce_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("file"), F.col("event_type").alias("op"))
    return debounced(rows, gap="30 minutes")


_WINDOWED = f"""files as (select source || '/' || doc_id || '.txt' as file, text as content from documents), rows as (select file, {o.lines('content')} as r from files),
spans as (select file, r, unnest(range(0, greatest(ceil((len(r) - 10) / 4.0), 0)::int + 1)) * 4 as s from rows where len(r) > 0),
windowed as (select file || ':' || (s + 1) || ':' || least(s + 10, len(r)) as doc_id, '' as lang, file, (s + 1)::int as start_line, least(s + 10, len(r))::int as end_line, array_to_string(r[s + 1 : s + 10], chr(10)) as text from spans)"""


@query(f"""with recursive {_WINDOWED}, {o.bm25(_values(LITERAL)).replace('from documents', 'from windowed')},
items as (select l.query_id, l.rank, {{'chunk_id': w.doc_id, 'file': w.file, 'start_line': w.start_line, 'end_line': w.end_line, 'score': round(l.score, 6)}} as x from lexical l join windowed w on w.doc_id = l.chunk_id where l.rank <= 20),
walk as (
  select query_id, 1::bigint as n, [x] as found from items where rank = 1
  union all
  select query_id, rank, case when into_ is null then list_append(found, x) else list_transform(found, lambda m, k: case when k <> into_ then m else {{
    'chunk_id': case when x.score > m.score then x.chunk_id else m.chunk_id end, 'file': m.file, 'start_line': least(m.start_line, x.start_line), 'end_line': greatest(m.end_line, x.end_line), 'score': greatest(m.score, x.score)}} end) end
  from (select w.query_id, i.rank, w.found, i.x, list_position(list_transform(w.found, lambda m: m.file = i.x.file and m.start_line <= i.x.end_line and i.x.start_line <= m.end_line), true) as into_ from walk w join items i on i.query_id = w.query_id and i.rank = w.n + 1)
), last as (select query_id, arg_max(found, n) as found from walk group by query_id),
flat as (select query_id, unnest(range(1, len(found) + 1)) as rank, found from last)
select query_id, rank::int as rank, found[rank].chunk_id as chunk_id, found[rank].file as file, found[rank].start_line as start_line, found[rank].end_line as end_line, found[rank].score as score from flat""")
def overlaps_merged(spark, sf_dir):
    asked = _asked(spark, LITERAL)
    chunk = chunkers.sliding(_files(spark, sf_dir), 10, 4)
    found = lexical.bm25_top(chunk, asked, 20).join(chunk, "chunk_id")
    return fusion.merged_overlaps(found.select("query_id", "rank", "chunk_id", "file", "start_line", "end_line", F.round("score", 6).alias("score"), "content")).drop("content")


@query(f"""with recursive {o.bm25(_values(LITERAL))}, {o.CHUNKS},
items as (select query_id, rank, chunk_id, ((least(strlen(content), 560) + strlen(file) + 80) // 4)::bigint as tokens from lexical join chunks using (chunk_id) where rank <= 20),
walk as (
  select query_id, rank, chunk_id, tokens, tokens as used, true as kept from items where rank = 1
  union all select i.query_id, i.rank, i.chunk_id, i.tokens, w.used + case when w.used + i.tokens <= 1500 then i.tokens else 0 end, w.used + i.tokens <= 1500
  from walk w join items i on i.query_id = w.query_id and i.rank = w.rank + 1
), flagged as (select *, bool_or(not kept) over (partition by query_id) as truncated from walk)
select query_id, rank::int as rank, chunk_id, tokens, truncated from flagged where kept""")
def token_budget(spark, sf_dir):
    chunk = document_chunks(spark, sf_dir)
    found = document_index(spark, sf_dir).top(_asked(spark, LITERAL), 20).join(chunk.select("chunk_id", "file", "content"), "chunk_id")
    return fusion.within_budget(found.select("query_id", "rank", "chunk_id", token_estimate(F.col("file"), F.col("content")).alias("tokens")), 1500, flag=True)


@query(f"""with {o.bm25(_values(LITERAL))}, {o.CHUNKS} select query_id, sha256(string_agg('### ' || file || ':' || start_line || '-' || end_line || chr(10) || content, chr(10) || chr(10) order by rank)) as context_sha256
from lexical join chunks using (chunk_id) where rank <= 5 group by query_id""")
def chat_context(spark, sf_dir):
    chunk = document_chunks(spark, sf_dir)
    found = document_index(spark, sf_dir).top(_asked(spark, LITERAL), 5).join(chunk, "chunk_id").withColumn("compact_snippet", F.lit(None).cast("string"))
    return search.chat_context(found).select("query_id", F.sha2("context", 256).alias("context_sha256"))

