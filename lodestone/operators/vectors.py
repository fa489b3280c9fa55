"""Vector lane: exact cosine ranking, seeds, routing weights and a deterministic stand-in for an embedding model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens
from lodestone.operators.joins import broadcast_if_small

#: Query vectors that are sent to the tasks at once; more are taken in blocks.
BLOCK = 1024


class Embedder(Protocol):
    """Anything that adds an `embedding` column to a frame with a `text` column."""

    def embed(self, df: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """Signed hashes of code tokens, normalised: needs no model, and equal texts get equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, df: DataFrame) -> DataFrame:
        tokens = code_tokens(F.col("text"))
        sparse = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(self.dim)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.aggregate(sparse, F.lit(0.0), lambda acc, x: acc + F.when(x["at"] == i, x["sign"]).otherwise(0.0)))
        return df.withColumn("_raw", raw).withColumn("embedding", normalised(F.col("_raw"))).drop("_raw")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length, empty ones and those without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int, *, by: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """(query_id, *by, chunk_id, score, rank) of the nearest rows of (chunk_id, embedding) for (query_id, embedding).

    Exact. Queries go out in blocks of bounded size; each task keeps its own best of every query, so only those
    are shuffled.
    """
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = -(-max(1, queries.count()) // BLOCK)
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    rows = vectors.select(*by, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *queries.schema.fields]}
    names = ["query_id", *by, "chunk_id", "score"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:-1]) + ", score double"
    found = None
    for b in range(blocks):
        own = queries.where(number == b).collect()
        part = rows.mapInArrow(_nearest([r.query_id for r in own], [r.embedding for r in own], top, len(by), names, rows.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()), schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _nearest(ids: list, vectors: list, top: int, n_by: int, names: list[str], id_kind: str, query_kind: str):
    def unit(rows: list) -> np.ndarray:
        m = np.array(rows, float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v or ()), []).append(i)
        for batch in batches:
            rows = batch.column(n_by + 1).to_pylist()
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(n_by)), strict=True)) if n_by else [()] * len(rows)
            keys, chunk = batch.column(n_by).to_pylist(), []
            for group in dict.fromkeys(groups):
                for dim, own in by_dim.items():
                    at = [i for i, v in enumerate(rows) if groups[i] == group and v is not None and len(v) == dim and dim]
                    if not at:
                        continue
                    scores = unit([vectors[i] for i in own]) @ unit([rows[i] for i in at]).T
                    # Ties at the edge are kept whole, as the exact order is settled over all tasks.
                    edge = np.partition(-scores, min(top, len(at)) - 1, axis=1)[:, min(top, len(at)) - 1]
                    for q, j in zip(*np.nonzero(-scores <= edge[:, None] + 1e-9), strict=True):
                        chunk.append((ids[own[q]], *group, keys[at[j]], float(scores[q, j])))
            if chunk:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunk, strict=True)], names)

    return run


def similar_to(vectors: DataFrame, seed_id, top: int) -> DataFrame:
    """The nearest rows to a stored one, without itself; nothing if it isn't there."""
    seed = vectors.where(F.col("chunk_id") == seed_id).select(F.col("chunk_id").alias("query_id"), "embedding")
    found = cosine_top(vectors, seed, top + 1).where(F.col("chunk_id") != seed_id)
    return ranked_again(found, top)


def ranked_again(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def routing_weights(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, index_id, weight) of every index (index_id, embedding; null: none): its cosine, not below 0; 1 where either has no vector or they don't fit."""
    pairs = queries.select("query_id", F.col("embedding").alias("_q")).crossJoin(broadcast_if_small(contexts.select("index_id", F.col("embedding").alias("_c"))))
    comparable = F.col("_q").isNotNull() & F.col("_c").isNotNull() & (F.size("_q") == F.size("_c"))
    return pairs.select("query_id", "index_id", F.when(comparable, F.greatest(F.lit(0.0), cosine(F.col("_q"), F.col("_c")))).otherwise(1.0).alias("weight"))


def routed(weights: DataFrame, mode: str = "all", *, n: int = 3, threshold: float = 0.3, digits: int = 9) -> DataFrame:
    """The indexes that are searched, with the weight of their lane: all, the n best (each with weight 1), or those from a threshold on."""
    if mode == "all":
        return weights
    if mode == "threshold":
        return weights.where(F.round("weight", digits) >= threshold)
    if mode != "top_n":
        raise ValueError(f"no routing mode {mode}")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", digits)), "index_id")
    return weights.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, n)).select("query_id", "index_id", F.lit(1.0).alias("weight"))
