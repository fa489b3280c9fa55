"""Connected components of an edge table: forests within tasks, then one task for what is little, or alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, cut, scratch

#: Nodes that a task joins in memory before it hands on what it found.
HELD = 500_000
#: Edges for each of the tasks that write a round, and fewest tasks.
_EDGES, _TASKS = 25_000, 8


def components(edges: DataFrame, few_edges: int | None = None) -> DataFrame:
    """(a, b) edges of long ids to (node, root): the least node reachable, for every node that is not its own root.

    Each task first turns the edges it reads into stars around their least nodes. If these are counted to have at most
    `few_edges` edges (BROADCAST_ROWS), one task joins them; else rounds follow, of which few are left. They end
    when every node is either a root or has one neighbour, its root, which the first step of a round shows.
    Each round is written to the shared folder, so lineage stays short; the rounds' tables are deleted at the end.
    Rounds grow with the logarithm of the longest chain. Only counts come to the driver. Stars are broadcast only if the
    nodes are counted to be few.
    """
    with scratch() as own:
        now = own(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "components")
        n_edges, few_edges = now.count(), BROADCAST_ROWS if few_edges is None else few_edges
        if n_edges <= few_edges:
            joined = now.coalesce(1).mapInArrow(lambda batches: _forest(batches, 2 * few_edges), "a long, b long")
            return cut(joined.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
        tasks = max(_TASKS, n_edges // _EDGES)
        while True:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).coalesce(tasks)
            least = own(least.select("u", F.least("u", "low").alias("m"), F.expr("low > u or low = high and low < u").alias("settled")), "components")
            nodes, settled = least.agg(F.count("*"), F.count_if("settled")).first()
            if nodes == settled:
                return cut(least.where("m < u").select(F.col("u").alias("node"), F.col("m").alias("root")), "components")
            few = F.broadcast if nodes <= BROADCAST_ROWS else lambda x: x
            large = own(both.where("v > u").join(few(least.select("u", "m")), "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "components")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            moved = large.join(few(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = own(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks), "components")


def _forest(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Edges as (node, least node that they join it to), for up to `held` nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > held:
            yield stars()
            parent.clear()
    if parent:
        yield stars()
