"""Lexical lane: postings, corpus statistics and BM25 over code tokens.

A chunk's tokens are distinct, so a term counts once in a chunk and a chunk's length is its number of distinct
tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens
from lodestone.operators.joins import BROADCAST_ROWS
from lodestone.operators.shared import cut

K1, B = 1.5, 0.75


def document_text(content: str = "content", virtual_terms: str = "virtual_terms") -> Column:
    """What a chunk is searched by: its content and the names of the entities in it."""
    return F.concat_ws(" ", F.col(content), F.array_join(F.coalesce(F.col(virtual_terms), F.array().cast("array<string>")), " "))


def postings(chunks: DataFrame, *, id: str = "chunk_id", text: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, dl, *keep): one row per chunk and distinct token, with the chunk's length beside it, so ranking needs no second join."""
    tokens = chunks.select(F.col(id).alias("chunk_id"), *keep, code_tokens(F.col(text)).alias("tokens"))
    return tokens.select("chunk_id", *keep, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))


def tokenized(chunks: DataFrame, *, id: str = "chunk_id", text: str = "content", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The postings of chunks, and (*keep, dl) of each, from tokens that are made once and written to the shared folder."""
    made = cut(chunks.select(F.col(id).alias("chunk_id"), *keep, code_tokens(F.col(text)).alias("tokens")), "tokens").withColumn("dl", F.size("tokens").cast("long"))
    return made.select("chunk_id", *keep, "dl", F.explode("tokens").alias("term")), made.select(*keep, "dl")


def sized_stats(sized: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of chunks and their mean length, from their lengths (*by, dl)."""
    return sized.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posting: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return posting.groupBy(*by, "term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, *, text: str = "content", by: tuple[str, ...] = ()) -> DataFrame:
    """Number of chunks and their mean length; chunks without tokens count too."""
    sized = chunks.select(*by, F.size(code_tokens(F.col(text))).cast("long").alias("dl"))
    return sized_stats(sized, by)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_weight(dl: Column, avgdl: Column) -> Column:
    """Saturation of a term that occurs once."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def scores(posting: DataFrame, stats: DataFrame, queries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *by, chunk_id, score) of every chunk that shares a term with a query (query_id, text).

    Query terms select postings before anything is counted: document frequencies are needed of those alone.
    `stats` is one row (for each value of `by`).
    """
    terms = queries.select("query_id", F.explode(code_tokens(F.col("text"))).alias("term"))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = terms.select("term").distinct()
    hit = posting.join(F.broadcast(words) if few else words, "term", "left_semi")
    return weighed(hit, hit.groupBy(*by, "term").agg(F.count("*").alias("df")), stats, terms, by, few)


#: Scores of a task, about.
PAIRS = 2_000_000


def weighed(hit: DataFrame, dfs: DataFrame, stats: DataFrame, terms: DataFrame, by: tuple[str, ...], few: bool) -> DataFrame:
    """Summed weights of the postings (chunk_id, *by, term, dl) that queries ask for by `terms` (query_id, term), broadcast if they are `few`.

    Then postings are dealt by chunk before the queries that share a term multiply them, so only postings are shuffled, and
    a chunk's scores are summed where they are. The number of tasks goes by that of the scores.
    """
    weights = dfs.crossJoin(F.broadcast(stats)) if not by else dfs.join(stats, list(by))  # one row without `by`
    weights = weights.select(*by, "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    matched = hit.join(weights, [*by, "term"]).select("chunk_id", *by, "term", (F.col("idf") * term_weight(F.col("dl"), F.col("avgdl"))).alias("w"))
    if few:
        chunks = stats.agg(F.sum("n")).first()[0] or 0
        pairs = chunks * terms.select("query_id").distinct().count()
        least = int(hit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        matched, terms = matched.repartition(max(least, -(-pairs // PAIRS)), "chunk_id"), F.broadcast(terms)
    return matched.join(terms, "term").groupBy("query_id", *by, "chunk_id").agg(F.sum("w").alias("score")).where("score > 0")


def ranked(scored: DataFrame, top: int | Column, *, by: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """With 1-based ranks within a query (and `by`): score descending, then chunk_id."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def bm25_top(chunks: DataFrame, queries: DataFrame, top: int, *, id: str = "chunk_id", text: str = "content", by: tuple[str, ...] = ()) -> DataFrame:
    """The whole lane from a chunk table: (query_id, *by, chunk_id, score, rank)."""
    posting, sized = tokenized(chunks, id=id, text=text, keep=by)
    return ranked(scores(posting, sized_stats(sized, by), queries, by=by), top, by=by)
