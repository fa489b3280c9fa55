"""The driver's tables in the shape of an index: documents and vectors as chunks, parts and suppliers as a symbol graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import lines
from lodestone.operators import graph
from lodestone.operators.cells import VectorCells
from lodestone.operators.inverted import LexicalIndex
from lodestone.operators.shared import cut, shared_path

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: doc_id is the id, lang the index, source the folder; the extension goes by the id."""
    docs = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".rs").otherwise(".txt")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("index_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("file"), F.lit(1).alias("start_line"), F.size(lines(F.col("text"))).alias("end_line"), F.col("text").alias("content"), F.lit(None).cast("string").alias("function_name"))


_kept: dict[tuple[str, str, str], tuple] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, names: tuple[str, ...], make: Callable[[], T]) -> T:
    """What `make` writes from some tables: once in a session, and anew only if a file of theirs has changed."""
    files = [table(spark, sf_dir, n).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for n in names]
    state = tuple(sorted(tuple(map(str, r)) for r in reduce(DataFrame.unionByName, files).collect()))
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _kept or _kept[key][0] != state:
        _kept[key] = state, make()
    return _kept[key][1]


def document_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The lexical index of the document chunks."""
    return _once(spark, sf_dir, "index", ("documents",), lambda: LexicalIndex.build(document_chunks(spark, sf_dir), shared_path(spark, "documents-index")))


def vector_cells(spark: SparkSession, sf_dir: str) -> VectorCells:
    """The vectors of the documents, in cells."""
    return _once(spark, sf_dir, "cells", ("embeddings",), lambda: VectorCells.build(document_vectors(spark, sf_dir), shared_path(spark, "vector-cells"), cells=32))


def kept_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written symbol chunks."""
    return _once(spark, sf_dir, "symbols", ("lineitem", "part", "supplier"), lambda: cut(symbol_chunks(spark, sf_dir), "symbol-chunks"))


def symbol_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written nodes and edges of the symbol chunks."""

    def make() -> tuple[DataFrame, DataFrame]:
        chunk = kept_symbols(spark, sf_dir)
        node = cut(graph.nodes(chunk), "symbol-nodes")
        return node, cut(graph.edges(chunk, node), "symbol-edges")

    return _once(spark, sf_dir, "graph", ("lineitem", "part", "supplier"), make)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, with the vector of the same number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts call the suppliers that supply them, and each supplier calls the next one."""
    # Dealt by part first: pairs are made distinct and gathered where they are.
    calls = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    calls = calls.groupBy("l_partkey").agg(F.array_sort(F.transform(F.collect_list("l_suppkey"), lambda n: F.concat(F.lit("s"), n.cast("string")))).alias("calls"))
    none = F.array().cast("array<string>")
    part = table(spark, sf_dir, "part").join(calls, F.col("p_partkey") == F.col("l_partkey"), "left")
    parts = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat("p_brand", F.lit(".rs")).alias("file"), (F.col("p_partkey") + 1).cast("int").alias("start_line"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("function_name"), F.lit("Function").alias("chunk_type"), F.coalesce("calls", none).alias("calls"), none.alias("inherits_from"))
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    suppliers = supplier.select(F.concat(F.lit("supp:"), key).alias("chunk_id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit(".rs")).alias("file"), (F.col("s_suppkey") + 1).cast("int").alias("start_line"), F.concat(F.lit("mod::s"), key).alias("function_name"), F.lit("Class").alias("chunk_type"), F.array(F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string"))).alias("calls"), F.array(F.concat(F.lit("p"), key)).alias("inherits_from"))
    return parts.unionByName(suppliers)
