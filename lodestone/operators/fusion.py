"""Fusing ranked lanes, and what reorders fused results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestone.functions.text import doc_demotion, normal_path

K = 60


def lane(ranks: DataFrame, weight: float | Column) -> DataFrame:
    """A lane's share of the fused score: weight / (60 + rank)."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return ranks.select("query_id", "chunk_id", (w / (K + F.col("rank"))).alias("part"))


def fused(lanes: list[DataFrame], top: int | Column, digits: int = 12) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, part) lanes: (query_id, chunk_id, score, rank), one shuffle for the sum."""
    every = lanes[0]
    for other in lanes[1:]:
        every = every.unionByName(other)
    total = every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    return best(total, top, digits)


def best(scored: DataFrame, top: int | Column, digits: int = 12) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def promoted(ranks: DataFrame, hits: DataFrame) -> DataFrame:
    """Put the chunk that a query names exactly (query_id, chunk_id; one a query) first in its lane, moved or added."""
    named = hits.select("query_id", F.col("chunk_id").alias("_hit"))
    rest = ranks.join(named, "query_id", "left").where(F.col("_hit").isNull() | (F.col("chunk_id") != F.col("_hit")))
    order = Window.partitionBy("query_id").orderBy("rank")
    rest = rest.select("query_id", "chunk_id", (F.row_number().over(order) + F.col("_hit").isNotNull().cast("int")).alias("rank"))
    return rest.unionByName(hits.select("query_id", "chunk_id", F.lit(1).alias("rank")))


def adjusted(results: DataFrame, *, boost: float = 1.5, branch: DataFrame | None = None, definition: Column | None = None) -> DataFrame:
    """Scores of results (with `file`) times 0.5 for documentation of a definition query, and times the boost for files of the branch (file)."""
    out = results
    factor = F.when(definition, doc_demotion(F.col("file"))).otherwise(1.0) if definition is not None else F.lit(1.0)
    boost = max(1.0, min(3.0, boost))
    if branch is None or abs(boost - 1) < 1e-9:
        out = out.withColumn("on_branch", F.lit(False))
    else:
        known = branch.select(normal_path(F.col("file")).alias("_b")).distinct()
        out = out.withColumn("_f", normal_path(F.col("file"))).join(known, F.col("_f") == F.col("_b"), "left").withColumn("on_branch", F.col("_b").isNotNull()).drop("_f", "_b")
        factor = factor * F.when(F.col("on_branch"), boost).otherwise(1.0)
    return out.withColumn("score", F.col("score") * factor)


def diverse(candidates: DataFrame, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: the candidates (query_id, chunk_id, score, embedding) of each query in a new order `rank`.

    Greedy, so each query's few candidates are handled together; among equals the later one in score order is taken.
    """

    def reorder(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = [None if v is None else np.asarray(v, float) for v in pdf["embedding"]]

        def alike(a, b) -> float:
            if a is None or b is None or len(a) != len(b) or not (norm := float(np.linalg.norm(a) * np.linalg.norm(b))):
                return 0.0
            return float(a @ b) / norm

        left, rank, near = list(range(len(pdf))), [0] * len(pdf), [0.0] * len(pdf)
        for n in range(1, len(pdf) + 1):
            pick = max(left, key=lambda i: (round(balance * pdf["score"][i] - (1 - balance) * near[i], 12), i))
            left.remove(pick)
            rank[pick] = n
            for i in left:
                near[i] = max(near[i], alike(vectors[i], vectors[pick]))
        return pdf.assign(rank=rank)[["query_id", "chunk_id", "score", "rank"]]

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.select("query_id", "chunk_id", "score", "embedding").groupBy("query_id").applyInPandas(reorder, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def within_budget(results: DataFrame, budget: int, *, flag: bool = False) -> DataFrame:
    """Results (query_id, rank, tokens) in order as long as they fit a token budget; what doesn't fit is passed over, the first always stays.

    With `flag` a column `truncated` tells whether something of the query was passed over.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        used, kept = 0, []
        for n in pdf["tokens"]:
            fits = not kept or used + n <= budget
            kept.append(fits)
            used += n if fits else 0
        return (pdf.assign(truncated=not all(kept)) if flag else pdf)[kept]

    schema = StructType(list(results.schema.fields) + [StructField("truncated", BooleanType())] * flag)
    return results.groupBy("query_id").applyInPandas(keep, schema)


def merged_overlaps(results: DataFrame) -> DataFrame:
    """Results (query_id, rank, chunk_id, file, start_line, end_line, score, content) with overlapping ranges of a file merged into the first of them.

    The merged row spans both ranges, has the longer content, and the id and score of the better one.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for r in pdf.sort_values("rank", kind="stable").to_dict("records"):
            into = next((m for m in rows if m["file"] == r["file"] and m["start_line"] <= r["end_line"] and r["start_line"] <= m["end_line"]), None)
            if into is None:
                rows.append(r)
                continue
            if r["score"] > into["score"]:
                into["chunk_id"], into["score"] = r["chunk_id"], r["score"]
            if len(r["content"] or "") > len(into["content"] or ""):
                into["content"] = r["content"]
            into["start_line"], into["end_line"] = min(into["start_line"], r["start_line"]), max(into["end_line"], r["end_line"])
        return pd.DataFrame(rows, columns=pdf.columns).assign(rank=range(1, len(rows) + 1))

    return results.groupBy("query_id").applyInPandas(merge, results.schema)


def retrieval_quality(results: DataFrame, expected: DataFrame, *, mrr_at: int = 5, recall_at: int = 10) -> DataFrame:
    """Mean reciprocal rank and recall by intent, from results (query_id, rank, content) and what was expected (query_id, intent, needle)."""
    hits = results.join(expected, "query_id").where(F.col("content").contains(F.col("needle"))).groupBy("query_id").agg(F.min("rank").alias("first"))
    judged = expected.join(hits, "query_id", "left")
    return judged.groupBy("intent").agg(
        F.avg(F.when(F.col("first") <= mrr_at, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= recall_at).cast("double")).alias("recall"),
        F.count("*").alias("queries"),
    )
