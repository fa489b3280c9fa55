"""Vector search over a table that is partitioned into cells.

The cells are those of k-means over a bounded sample; every vector is written to the cell of its nearest centre, so a search reads
only the cells that it probes. Probing the nearest cells gives most of the best rows (`recall` measures how many); the exact
search reads on, cell by cell as bounds tell, until no other cell can hold a better row: a vector within the angle r of its
centre c is no nearer to a query q than the angle between q and c, less r.

Defined results: vectors that are null, without length, or of another length than the index has take no part, in the index or as
queries; equal scores go by chunk_id; repeated rows count each; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.vectors import BLOCK, dot, normalised

#: Rows that the centres are fitted on, at most.
SAMPLE_ROWS = 50_000


class VectorCells:
    def __init__(self, spark: SparkSession, path: str):
        """An index that `build` has written."""
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many as there are cells
        self.centres = np.array([r.centre for r in rows], float)
        self.cells, self.radius = np.array([r.cell for r in rows]), np.array([r.radius for r in rows], float)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, cells: int = 64, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> VectorCells:
        """Index all usable rows of `vectors` (chunk_id, embedding); their most frequent length is that of the index."""
        spark = vectors.sparkSession
        rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0").where(dot(F.col("embedding"), F.col("embedding")) > 0)
        size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = size.d if size else 0
        rows = rows.where(F.size("embedding") == dim).withColumn("embedding", normalised(F.col("embedding")))
        sample = rows.orderBy(F.xxhash64(F.lit(seed), "chunk_id")).limit(sample_rows).select(array_to_vector("embedding").alias("features"))
        if size:
            k = max(1, min(cells, size["count"]))
            fitted = KMeans(k=k, maxIter=20, seed=seed, distanceMeasure="cosine").fit(sample)
            centres = np.array(fitted.clusterCenters())
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        else:
            centres = np.empty((0, 0))
        kind = rows.schema["chunk_id"].dataType.simpleString()

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                if not len(column):
                    continue
                near = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["chunk_id", "embedding", "cell", "angle"])

        found = rows.mapInArrow(assigned, f"chunk_id {kind}, embedding array<double>, cell int, angle double")
        found.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        written = spark.read.schema(f"chunk_id {kind}, embedding array<double>, angle double, cell int").parquet(f"{path}/rows")
        radius = written.groupBy("cell").agg(F.max("angle").alias("radius"))
        named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        named.join(radius, "cell").write.parquet(f"{path}/centres")
        return cls(spark, path)

    def rows(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells; the others' folders are not read."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(cells)).select("chunk_id", "embedding", "cell")

    def _angles(self, queries: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(queries @ self.centres.T, -1, 1))

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        """Ids and unit vectors of the usable queries, in blocks of bounded size."""
        dim = self.centres.shape[1] if self.centres.size else 0
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == dim)
        blocks = -(-max(1, asked.count()) // BLOCK)
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        for b in range(blocks):
            own = asked.where(number == b).collect()
            vectors = np.array([r.embedding for r in own], float).reshape(len(own), dim)
            norm = np.linalg.norm(vectors, axis=1)
            keep = norm > 0
            if keep.any():
                yield [r.query_id for r, k in zip(own, keep, strict=True) if k], vectors[keep] / norm[keep, None]

    def _scored(self, ids: list, vectors: np.ndarray, wanted: dict[int, np.ndarray], top: int, query_kind: str) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best rows of each query among those of the cells that it asks for."""
        rows = self.rows(sorted(wanted))
        kind, number = rows.schema["chunk_id"].dataType.simpleString(), np.arange(len(ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells).tolist():
                    at, own = np.flatnonzero(cells == cell), number[wanted[cell]]
                    scores = vectors[own] @ x[at].T
                    # Ties at the edge are kept, as the order is settled over all tasks.
                    edge = np.partition(-scores, min(top, len(at)) - 1, axis=1)[:, min(top, len(at)) - 1]
                    q, j = np.nonzero(-scores <= edge[:, None] + 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q].astype(np.int32)), batch.column(0).take(pa.array(at[j])), pa.array(scores[q, j])], ["q", "chunk_id", "score"])

        names = self.spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {query_kind}")
        found = rows.mapInArrow(run, f"q int, chunk_id {kind}, score double")
        order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "chunk_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return best.join(F.broadcast(names), "q").select("query_id", "chunk_id", "score", "rank")  # no more names than a block has queries

    def top(self, queries: DataFrame, top: int, *, probe: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for (query_id, embedding): exact, or among the rows of the `probe` nearest cells."""
        kind, found = queries.schema["query_id"].dataType.simpleString(), None
        for ids, vectors in self._blocks(queries) if len(self.cells) else ():
            angles = self._angles(vectors)
            nearest = np.argsort(angles, axis=1, kind="stable")
            asked = np.zeros(angles.shape, bool)
            np.put_along_axis(asked, nearest[:, : probe or max(1, len(self.cells) // 8)], True, axis=1)
            part = self._scored(ids, vectors, self._wanted(asked), top, kind)
            if probe is None:
                # What the first cells give bounds the others: those that may still hold a row as good are read too.
                kth = {r.query_id: r.score for r in part.where(F.col("rank") == top).select("query_id", "score").collect()}
                reach = np.cos(np.maximum(angles - self.radius, 0))
                asked |= reach >= np.array([kth.get(i, -2.0) for i in ids])[:, None] - 1e-9
                part = self._scored(ids, vectors, self._wanted(asked), top, kind)
            found = part if found is None else found.unionByName(part)
        if found is None:
            rows = self.spark.read.parquet(f"{self.path}/rows") if len(self.cells) else None
            chunk = rows.schema["chunk_id"].dataType.simpleString() if rows is not None else "string"
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id {chunk}, score double, rank int")
        return found

    def _wanted(self, asked: np.ndarray) -> dict[int, np.ndarray]:
        return {int(c): np.flatnonzero(asked[:, i]) for i, c in enumerate(self.cells) if asked[:, i].any()}


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted, recall): how many of the exact best rows were found."""
    hits = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.count("_hit").alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))
