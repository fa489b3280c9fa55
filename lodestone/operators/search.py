"""Hybrid search over index tables: both lanes, fusion, graph expansion and adjustments as one batch plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import intent as intents
from lodestone.functions.text import match_reason, snippet
from lodestone.operators import fusion, graph, lexical, vectors
from lodestone.operators.intervals import points_in_ranges
from lodestone.operators.inverted import LexicalIndex
from lodestone.operators.joins import broadcast_if_small
from lodestone.operators.shared import cut

#: Candidates that a lane hands to fusion, for each wanted result.
OVERSAMPLE = 4


@dataclass
class Index:
    """The tables of one or more named indexes. Lanes are empty where their table is None."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    domain_terms: tuple[str, ...] = ()
    kept: LexicalIndex | None = None
    postings: DataFrame | None = field(default=None)

    def __post_init__(self) -> None:
        self._source = None
        if self.postings is None and self.kept is None:
            text = lexical.document_text() if "virtual_terms" in self.chunks.columns else F.col("content")
            source = self._source = self.chunks.withColumn("_text", text)
            self.postings, self.stats = lexical.postings(source, text="_text"), lexical.corpus_stats(source, text="_text")

    def lexical_scores(self, queries: DataFrame) -> DataFrame:
        """From the kept index if there is one; else the chunks are tokenized at the first use."""
        if self.kept is not None:
            return self.kept.scores(queries)
        if self._source is not None:
            self.postings, sized = lexical.tokenized(self._source, text="_text")
            self.stats, self._source = lexical.sized_stats(sized), None
        return lexical.scores(self.postings, self.stats, queries)


def exact_entities(queries: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) where a one-word definition or unknown query is the name of an entity: the first by file and lines."""
    asked = queries.where(F.col("intent").isin("Definition", "Unknown")).select("query_id", F.trim("text").alias("_t")).where("_t <> '' and not contains(_t, ' ')")
    named = entities.where(F.col("entity_type").isin("NamedType", "ModulePath")).select(F.col("text").alias("_name"), "file", "line")
    lines = chunks.select("chunk_id", "file", "start_line", "end_line")
    hit = points_in_ranges(named.join(broadcast_if_small(asked), F.lower("_name") == F.lower("_t")), lines, "file")
    return hit.groupBy("query_id").agg(F.min(F.struct("file", "line", "start_line", "chunk_id")).alias("at")).select("query_id", "at.chunk_id")


def search(index: Index, queries: DataFrame, *, top: int = 10, expand: bool = True, compact: bool = True, branch: DataFrame | None = None, boost: float = 1.5, diversify: bool = False) -> DataFrame:
    """The best chunks of every query (query_id, text, and embedding if there is a vector lane), by rank.

    Every stage works on all queries at once. Results carry the chunk's columns without its vector, which are
    joined last, when only `top` rows for each query are left. Lanes are written to the shared folder, as they are used several times.
    """
    asked = queries.withColumn("intent", intents.domain_intent(F.col("text"), index.domain_terms))
    asked = asked.withColumns({"w": intents.weights(F.col("intent"))}).select("*", "w.*").drop("w")
    deep = OVERSAMPLE * top
    lexical_lane = lexical.ranked(index.lexical_scores(asked), deep).select("query_id", "chunk_id", "rank")
    if index.entities is not None:
        lexical_lane = fusion.promoted(lexical_lane, exact_entities(asked, index.entities, index.chunks))
    # What is used more than once is written: a lane has `deep` rows for each query at most.
    lexical_lane = cut(lexical_lane, "lexical-lane")
    weights = cut(asked.select("query_id", "alpha", "beta", "use_graph", "intent"), "intents")
    lanes = [fusion.lane(lexical_lane.join(weights, "query_id"), F.col("beta"))]
    vector_lane = None
    if index.vectors is not None:
        vector_lane = vectors.cosine_top(index.vectors, asked.where("embedding is not null"), deep).select("query_id", "chunk_id", "rank")
        vector_lane = cut(vector_lane, "vector-lane")
        lanes.append(fusion.lane(vector_lane.join(weights, "query_id"), F.col("alpha")))
    results = fusion.fused(lanes, top).select("query_id", "chunk_id", "score")
    if diversify and index.vectors is not None:
        with_vectors = results.join(index.vectors, "chunk_id", "left")
        results = fusion.diverse(with_vectors).select("query_id", "chunk_id", (1.0 / F.col("rank")).alias("score"))
    near = None
    if expand and index.edges is not None:
        results = cut(results, "fused")
        seeds = results.join(weights.where("use_graph"), "query_id").select("query_id", "chunk_id", "score", "intent")
        symbols = index.chunks.where("function_name <> ''").select("chunk_id", F.col("function_name").alias("symbol"))
        near = graph.expanded(seeds, symbols, index.nodes, index.edges)
        near = cut(near, "near")
        results = results.unionByName(near)
    files = results.join(index.chunks.select("chunk_id", "file"), "chunk_id", "left")
    files = files.join(weights.select("query_id", "intent"), "query_id")
    scored = fusion.adjusted(files, boost=boost, branch=branch, definition=F.col("intent") == "Definition")
    final = fusion.best(scored, top)

    def flag(found: DataFrame | None, name: str) -> DataFrame:
        if found is None:
            return final.select("query_id", "chunk_id", F.lit(False).alias(name)).limit(0)
        return found.select("query_id", "chunk_id", F.lit(True).alias(name))

    key = ["query_id", "chunk_id"]
    final = final.join(flag(vector_lane, "_v"), key, "left").join(flag(lexical_lane, "_l"), key, "left").join(flag(near, "_g"), key, "left")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("_v", "_l", "_g")]
    final = final.withColumn("match_reason", match_reason(*flags)).drop("_v", "_l", "_g", "file")
    out = final.join(index.chunks, "chunk_id")
    return out.withColumn("compact_snippet", snippet(F.col("content")) if compact else F.lit(None).cast("string"))


def fan_out(lanes: DataFrame, *, top: int = 10, mode: str = "flat", ids: Sequence[str] | None = None) -> DataFrame:
    """Merge the ranked lanes (query_id, index_id, chunk_id, rank) of many indexes into (query_id, chunk_id, score, rank).

    `flat` fuses all lanes at once. `fold` fuses them pairwise in the order of index_id: each step ranks what is
    merged so far, keeps max(4 top, top, 10) of it, and fuses it with the next lane; its lanes are few. Their `ids` are
    looked up if they aren't given.
    """
    named = lanes.select("query_id", "index_id", F.concat_ws("::", "index_id", "chunk_id").alias("chunk_id"), "rank")
    if mode == "flat":
        return fusion.fused([fusion.lane(named, 1.0)], top)
    if mode != "fold":
        raise ValueError(f"no fan-out mode {mode}")
    deep = max(OVERSAMPLE * top, 10)
    if ids is None:
        ids = [r.index_id for r in named.select("index_id").distinct().collect()]
    merged = None
    for i in sorted(ids):
        own = named.where(F.col("index_id") == i)
        merged = own.select("query_id", "chunk_id", "rank", (1.0 / (fusion.K + F.col("rank"))).alias("score")) if merged is None else fusion.fused([fusion.lane(merged, 1.0), fusion.lane(own, 1.0)], deep)
    return merged.select("query_id", "chunk_id", "score", "rank").where(F.col("rank") <= top) if merged is not None else fusion.fused([fusion.lane(named, 1.0)], top)


def search_all(indexes: Mapping[str, Index], queries: DataFrame, *, only: Sequence[str] | None = None, routes: DataFrame | None = None, top: int = 10, mode: str = "flat", **options) -> DataFrame:
    """`search` in each named index, with its own lanes and the weights of each query's intent, merged as by `fan_out`.

    Results carry their chunk's columns, index_id, and the merged score and rank. `only` restricts the indexes (names that
    there are none of are passed over; where none is left, there is no result); `routes` (query_id, index_id) those that
    a query is sent to. The plan has a part for each index.
    """
    names = sorted(n for n in indexes if only is None or n in only)

    def own(name: str) -> DataFrame:
        asked = queries if routes is None else queries.join(routes.where(F.col("index_id") == name).select("query_id"), "query_id", "left_semi")
        return search(indexes[name], asked, top=top, **options).withColumn("index_id", F.lit(name))

    if not names:
        return own(min(indexes)).limit(0)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(own, names))
    named = found.withColumns({"_own": F.col("chunk_id"), "chunk_id": F.concat_ws("::", "index_id", "chunk_id")})
    if mode == "flat":
        merged = fusion.best(named.withColumn("score", 1.0 / (fusion.K + F.col("rank"))), top)
    else:
        ranks = fan_out(found.select("query_id", "index_id", "chunk_id", "rank"), top=top, mode=mode, ids=names)
        merged = named.drop("score", "rank").join(ranks, ["query_id", "chunk_id"])
    return merged.withColumn("chunk_id", F.col("_own")).drop("_own")


def page(chunks: DataFrame, offset: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    """A page of the chunks by file and lines."""
    return chunks.orderBy("file", "start_line", "end_line", "chunk_id").offset(max(0, offset)).limit(max(0, min(limit, most)))


def counted_page(chunks: DataFrame, offset: int = 0, limit: int = 100, most: int = 1000) -> tuple[DataFrame, int]:
    """A page and the number of all chunks."""
    return page(chunks, offset, limit, most), chunks.count()


def seed(chunks: DataFrame, file_end: str, name: str | None = None) -> DataFrame:
    """The first chunk of a file (by the end of its path) and function."""
    found = chunks.where(F.col("file").endswith(file_end))
    if name is not None:
        found = found.where(F.col("function_name") == name)
    return found.orderBy("start_line", "file", "chunk_id").limit(1)


def chat_context(results: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, context): the first results of each query as one text for a language model's prompt."""
    part = F.struct("rank", F.concat(F.lit("### "), F.col("file"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("\n"), F.coalesce("compact_snippet", "content")).alias("text"))
    kept = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return kept.select("query_id", F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("context"))

