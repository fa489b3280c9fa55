"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of the partial scores of `lists` slices of the dimensions; each slice is one list.
1. Each task gathers, for every query and list, its k highest entries, with the whole scores of their vectors. The
   k-th highest of these scores is a query's first bound.
2. That bound over the number of lists is a safe cutoff: a vector below it in every list can't reach the bound. The
   cutoffs go to all tasks, which collect the entries at or above them and nothing else. Entries of a vector are
   joined; a vector that shows in all lists has its score. The k-th best of those, if higher, is the second bound. A
   list that doesn't show counts as the cutoff at most, and vectors whose upper bound falls short go.
3. Of those that remain, the ones with a list that doesn't show are looked up, and their scores resolved exactly.

Cutoffs are the tighter the fewer lists there are, so two are the default. Of equal vectors a task keeps those
with the k + 1 smallest ids, as no others can be among the best; a vector that a third of the rows repeat costs
no more than any other.

Queries are taken in blocks of bounded size, each against all rows; only a block's vectors and cutoffs are
sent to the tasks.

Defined results: components are floor(1024 * x); vectors that are null, have a null id, or hold null or
non-finite components take no part; vectors are compared with those of their own length; a query skips every row
of its own id; queries that share an id are one query (the least vector); candidates that share an id are
candidates each; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, scratch

#: Most queries in a block, about.
BLOCK = 2048
#: Scores that a task holds at once.
HELD = 2_000_000


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(1024 * values)


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where sums of their products are exact, else as whole numbers of any size."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return (np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (q, x))
    return q, x


class Block:
    """The queries of one block, by the length of their vectors."""

    def __init__(self, rows: list, lists: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r.embedding) for r in rows}:
            own = [r for r in rows if len(r.embedding) == d]
            self.by_length[d] = np.array([r.vec_id for r in own], np.int64), whole(np.array([r.embedding for r in own], float).reshape(len(own), d))
        self.lists = lists

    def partials(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(query ids, row ids, rows, partial scores by list) of the batch, in parts of bounded size."""
        ids, column = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for d, (queries, q) in self.by_length.items():
            own = np.flatnonzero(lengths == d)
            step = max(1, HELD // len(queries))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                x = whole(values[starts[rows][:, None] + np.arange(d)])
                q_, x_ = exact(q, x)
                parts = [q_[:, s] @ x_[:, s].T for s in np.array_split(np.arange(d), self.lists)]
                yield queries, ids[rows], x, parts, queries[:, None] == ids[rows][None]


def _few_of_equal(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by id, less those with whose vector k + 1 smaller ids came before, or k rows of the same id."""
    met: dict[bytes, list[int]] = {}  # ids so far, the last one, its rows
    for batch in batches:
        ids, column = batch.column(0).to_numpy(), batch.column(1)
        ends = np.cumsum(np.diff(column.offsets.to_numpy()))
        values, keep, at = column.flatten().to_numpy(zero_copy_only=False), [], 0
        for i, end in zip(ids.tolist(), ends.tolist(), strict=True):
            own = met.setdefault(hashlib.blake2b(values[at:end].tobytes(), digest_size=16).digest(), [0, 0, 0])
            own[:] = [own[0], i, own[2] + 1] if own[0] and own[1] == i else [own[0] + 1, i, 1]
            keep.append(own[0] <= k + 1 and own[2] <= k)
            at = end
        yield batch.filter(pa.array(keep, pa.bool_()))


def _marks(x: np.ndarray) -> np.ndarray:
    """64 bits of each row's content."""
    return np.array([int.from_bytes(hashlib.blake2b(r.astype(float).tobytes(), digest_size=8).digest(), "little", signed=True) for r in x], np.int64)


def gathered(block: Block, k: int):
    """Phase 1 in a task: the whole scores of the vectors with the k highest entries of every query and list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in _few_of_equal(batches, k):
            for queries, ids, x, parts, own in block.partials(batch):
                marks, total = _marks(x), sum(parts)
                for j, p in enumerate(parts):
                    p = p.astype(float)
                    p[own] = -np.inf
                    top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                    new = [np.take_along_axis(p, top, 1), ids[top], marks[top], np.take_along_axis(total, top, 1)]
                    key = (x.shape[1], j)
                    if key in best:
                        both = [np.concatenate([a, b], axis=1) for a, b in zip(best[key][1], new, strict=True)]
                        keep = np.argpartition(-both[0], min(k, both[0].shape[1]) - 1, axis=1)[:, :k]
                        new = [np.take_along_axis(m, keep, 1) for m in both]
                    best[key] = [queries, new]
        for queries, (p, ids, marks, total) in best.values():
            seen = p > -np.inf
            yield _batch(["query_id", "vec_id", "mark", "score"], np.repeat(queries, seen.sum(axis=1)), ids[seen], marks[seen], total[seen])

    return run


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(-(2**63), min(2**63 - 1, int(v))) for v in c] if getattr(c, "dtype", object) == object else np.asarray(c).astype(np.int64), pa.int64()) for c in columns], names)


def collected(block: Block, k: int, bounds: dict[int, int]):
    """Phase 2 in a task: the entries at or above their query's cutoff; `covers` is how many lists an entry stands for."""
    names = ["query_id", "list", "vec_id", "mark", "partial", "covers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_of_equal(batches, k):
            for queries, ids, x, parts, own in block.partials(batch):
                if parts[0].dtype == object:  # numbers beyond exact floats: the whole score is one entry
                    parts = [sum(parts)]
                bound = np.array([bounds.get(int(q), -(2**63)) for q in queries], parts[0].dtype)[:, None]
                marks = None
                for j, p in enumerate(parts):
                    at_q, at_x = np.nonzero((len(parts) * p >= bound) & ~own)
                    if len(at_q):
                        marks = _marks(x) if marks is None else marks
                        n = np.full(len(at_q), 1 if len(parts) == block.lists else block.lists)
                        yield _batch(names, queries[at_q], np.full(len(at_q), j), ids[at_x], marks[at_x], p[at_q, at_x], n)

    return run


def looked_up(block: Block):
    """Phase 3 in a task: the exact scores of (query_id, vec_id, mark, embedding) rows; those of another vector go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = {int(i): v for ids, q in block.by_length.values() for i, v in zip(ids, q, strict=True)}
        for batch in batches:
            rows: list[tuple] = []
            for q, i, mark, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, own = whole(np.array([v], float)), vectors[q][None]
                if x.shape == own.shape and _marks(x)[0] == mark:
                    own, x = exact(own, x)
                    rows.append((q, i, mark, (own @ x.T)[0, 0]))
            if rows:
                yield _batch(["query_id", "vec_id", "mark", "score"], *map(list, zip(*rows, strict=True)))

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, lists: int = 2, block: int = BLOCK, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row of `vectors` (vec_id, embedding) that is a query.

    `counts`, if given, gets the numbers of gathered, collected and looked-up pairs added.
    """
    rows = usable(vectors)
    queries = cut(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-queries")
    blocks = max(1, -(-queries.count() // block))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    done = None
    for b in range(blocks):
        with scratch() as own_cut:
            found = cut(_top_k_block(rows, queries.where(number == b).collect(), k, lists, own_cut, counts), "topk-block")
        done = done.unionByName(found) if done else found
    return done


def _top_k_block(rows: DataFrame, queries: list, k: int, lists: int, cut, counts: dict | None) -> DataFrame:
    block, pair = Block(queries, lists), ["query_id", "vec_id", "mark"]
    by_id = rows.sortWithinPartitions("vec_id")  # within tasks, not among them
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "mark")

    first = cut(by_id.mapInArrow(gathered(block, k), "query_id long, vec_id long, mark long, score long"), "topk-gathered")
    kth = first.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
    # No more than a block's queries, each with a number.
    bounds = {r.query_id: r.score for r in kth.select("query_id", "score").collect()}

    entries = by_id.mapInArrow(collected(block, k, bounds), "query_id long, list long, vec_id long, mark long, partial long, covers long")
    # Rows that are equal in id and vector show the same entries; how many there are is kept.
    entries = entries.groupBy(*pair, "list").agg(F.any_value("partial").alias("partial"), F.any_value("covers").alias("covers"), F.count("*").alias("copies"))
    known = cut(entries.groupBy(*pair).agg(F.sum("partial").alias("known"), F.sum("covers").alias("shown"), F.max("copies").alias("copies")), "topk-known")
    cutoffs = rows.sparkSession.createDataFrame(list(bounds.items()), "query_id long, cutoff long")
    whole_ = known.where(F.col("shown") == lists).select(*pair, F.col("known").alias("score"), "copies")
    second = whole_.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("second"))
    hidden = known.where(F.col("shown") < lists).join(F.broadcast(cutoffs), "query_id").join(second, "query_id", "left")
    wide = {c: F.col(c).cast("decimal(30,0)") for c in ("known", "cutoff")}
    upper = lists * wide["known"] + (lists - F.col("shown")) * wide["cutoff"]
    likely = cut(hidden.where(upper >= lists * F.greatest("cutoff", F.coalesce("second", "cutoff")).cast("decimal(30,0)")).select(*pair, "copies"), "topk-likely")
    found = likely.select(*pair).join(rows, "vec_id").select(*pair, "embedding").mapInArrow(looked_up(block), "query_id long, vec_id long, mark long, score long")
    every = whole_.unionByName(found.distinct().join(likely, pair).select(*pair, "score", "copies"))
    if counts is not None:
        for name, df in (("gathered", first), ("collected", known), ("looked_up", likely)):
            counts[name] = counts.get(name, 0) + df.count()
    top = every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    top = top.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
