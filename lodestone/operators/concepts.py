"""Concept clusters: k-means over the vectors of documented chunks of all files at once, labelled by the nearest word of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import slug
from lodestone.operators.joins import broadcast_if_small
from lodestone.operators.shared import cut
from lodestone.operators.vectors import cosine

LEAST, MOST_CLUSTERS = 4, 20


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the mean vector of each group, one sum for each dimension."""
    return _means(vectors, (by,))


def _means(vectors: DataFrame, by: tuple[str, ...]) -> DataFrame:
    at = vectors.select(*by, F.posexplode("embedding").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs")).select(*by, F.transform("xs", lambda p: p.x).alias("embedding"))


def labelled(centres: DataFrame, vocabulary: DataFrame, by: str) -> DataFrame:
    """(by, label, likeness): the word (word, at, embedding) nearest to each centre, the first among equals."""
    words = vocabulary.select("word", "at", F.col("embedding").alias("_w"))
    pairs = centres.select(by, F.col("embedding").alias("_c")).crossJoin(broadcast_if_small(words))  # a vocabulary of a few words
    scored = pairs.select(by, "word", "at", F.round(cosine(F.col("_c"), F.col("_w")), 9).alias("likeness"))
    first = Window.partitionBy(by).orderBy(F.desc("likeness"), "at")
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(by, F.col("word").alias("label"), "likeness")


def clusters_for(n: Column) -> Column:
    """How many clusters n documented chunks get: half as many, 1 to 20."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_CLUSTERS), F.floor(n / 2))).cast("int")


def _nearest(centres: Column, point: Column) -> Column:
    """The number of the nearest of an array of centres, the first among equals."""

    def squared(c: Column) -> Column:
        return F.round(F.aggregate(F.zip_with(c, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 12)

    return F.array_min(F.transform(centres, lambda c: F.struct(squared(c["embedding"]).alias("d"), c["cluster"].alias("cluster"))))["cluster"]


def grouped_kmeans(points: DataFrame, by: str, *, id: str = "chunk_id", most_rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """(by, id, cluster) and the centre of each row of points (by, id, embedding), for all groups at once.

    A group of n points has `clusters_for(n)` clusters, which start at its first points by id. A round joins points with the array of
    their group's centres, at most 20, and averages the points of each cluster; it is written to the shared folder. Rounds end
    when no centre of any group moves by more than `tolerance`. A cluster that loses all points is gone.
    """
    points = cut(points.select(by, id, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"), "points")
    counted = points.groupBy(by).agg(F.count("*").alias("n"))
    # Tasks keep the first points of each group before anything is shuffled, as the rank is limited.
    order = Window.partitionBy(by).orderBy(id, "embedding")
    first = points.withColumn("cluster", F.row_number().over(order) - 1).where(F.col("cluster") < MOST_CLUSTERS)
    centres = cut(first.join(counted, by).where(F.col("cluster") < clusters_for(F.col("n"))).select(by, "cluster", "embedding"), "centres")
    rounds = 0
    while True:
        held = centres.groupBy(by).agg(F.collect_list(F.struct("cluster", "embedding")).alias("centres"))
        assigned = points.join(held, by).select(by, id, "embedding", _nearest(F.col("centres"), F.col("embedding")).alias("cluster"))
        if rounds == most_rounds:
            break
        now = cut(_means(assigned, (by, "cluster")), "centres")
        moved = now.join(centres.withColumnRenamed("embedding", "_b"), [by, "cluster"])
        shift = moved.agg(F.max(F.aggregate(F.zip_with("embedding", "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).first()[0]
        centres, rounds = now, rounds + 1
        if shift is None or shift <= tolerance**2:
            held = centres.groupBy(by).agg(F.collect_list(F.struct("cluster", "embedding")).alias("centres"))
            assigned = points.join(held, by).select(by, id, "embedding", _nearest(F.col("centres"), F.col("embedding")).alias("cluster"))
            break
    return assigned.select(by, id, "cluster").join(centres.withColumnRenamed("embedding", "centre"), [by, "cluster"])


def clusters(vectors: DataFrame, vocabulary: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """ConceptCluster entities (entity_id, entity_type, text, file) of all files' documented chunks (file, chunk_id, embedding); none for a file with fewer than four.

    Chunks with one id in a file count each; null vectors and files don't count.
    """
    usable = vectors.where("embedding is not null and file is not null")
    enough = usable.groupBy("file").count().where(F.col("count") >= LEAST).select("file")
    found = grouped_kmeans(usable.join(enough, "file", "left_semi"), "file", most_rounds=most_rounds)
    centres = found.select("file", "cluster", "centre").distinct().select("file", F.struct("file", "cluster").alias("at_"), F.col("centre").alias("embedding"))
    named = labelled(centres.select("at_", "embedding"), vocabulary, "at_").select(F.col("at_.file").alias("file"), "label").distinct()
    return named.select(F.concat_ws(":", "file", F.lit("cluster"), slug(F.col("label"))).alias("entity_id"), F.lit("ConceptCluster").alias("entity_type"), F.col("label").alias("text"), "file")
