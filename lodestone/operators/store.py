"""Upkeep of an index: changed files, upserts, removals, caps, its tables and the registry of indexes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.shared import cut

# Words of which one at least should find something in a fresh index.
PROBES = ("fn", "function", "def", "class", "the")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files (file, content_sha256) whose content an index does not have yet."""
    return files.join(known.select("file", "content_sha256"), ["file", "content_sha256"], "left_anti")


def deleted(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("file").join(files.select("file"), "file", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """`old` with the rows of `new` in the place of those with the same key. Of several new rows with a key any one is right for the caller to have made unique."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """`old` without the chunks of `files` (file), and with the new ones: what a file no longer has goes too."""
    return old.join(files.select("file").distinct(), "file", "left_anti").unionByName(new, allowMissingColumns=True)


def without_files(old: DataFrame, files: Sequence[str]) -> DataFrame:
    return old.where(~F.col("file").isin(*files)) if files else old


def without_chunks(old: DataFrame, ids: Sequence[str]) -> DataFrame:
    return old.where(~F.col("chunk_id").isin(*ids)) if ids else old


def within_cap(old: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """The rows of `new` that an index of at most `cap` chunks takes: updates always, new ids by file, line and id while there is room; 0 is no cap."""
    if not cap:
        return new
    ids = old.select("chunk_id").distinct()
    room = max(0, cap - ids.count())
    updates = new.join(ids, "chunk_id", "left_semi")
    fresh = new.join(ids, "chunk_id", "left_anti").orderBy("file", "start_line", "chunk_id").limit(room)
    return updates.unionByName(fresh)


def unfit_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors that are null, of another length than the index has, or not finite."""
    return vectors.where(~fits(dim))


def status(chunks: DataFrame) -> DataFrame:
    """Chunks, files and lines of each index."""
    return chunks.groupBy("index_id").agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


class BucketTable:
    """Rows of named indexes as one Parquet table, partitioned by index and by bucket of the key that rows are replaced by.

    A write replaces the buckets of its keys and leaves all others as they are, by Spark's own dynamic partition overwrite.
    What a bucket will hold is written to the shared folder first, so a driver that is lost before the overwrite has changed
    nothing, and the same write may be repeated. A row without a key stands in each bucket that was written, so that one
    which has become empty is replaced too; readers don't see it.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int = 64):
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path.rstrip("/"), columns, key, buckets

    @classmethod
    def of_chunks(cls, spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
        return cls(spark, path, "chunk_id string, file string, start_line int, end_line int, content string, function_name string, chunk_type string", "file", buckets)

    @classmethod
    def of_vectors(cls, spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
        return cls(spark, path, "chunk_id string, embedding array<float>", "chunk_id", buckets)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, index_id string, bucket int").parquet(self.path)

    def _any(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self, index_id: str | None = None) -> DataFrame:
        """The rows of an index, or of all with their index_id."""
        if not self._any():
            return self.spark.createDataFrame([], f"{self.columns}, index_id string")
        found = self._read().where(F.col(self.key).isNotNull()).drop("bucket")
        return found if index_id is None else found.where(F.col("index_id") == index_id)

    def replace(self, index_id: str, keys: DataFrame, new: DataFrame) -> None:
        """Take the rows of `keys` out of an index and put `new` ones in; columns that `new` lacks are null."""
        schema = self.spark.createDataFrame([], self.columns).schema
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        fresh = new.where(F.col(self.key).isNotNull()).select(*columns).select("*", bucket)
        named = keys.select(F.col(self.key).cast(schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        # As many numbers as there are buckets, at most.
        touched = sorted({r[0] for df in (named.select(bucket), fresh.select("bucket")) for r in df.distinct().collect()})
        if not touched:
            return
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "bucket")
        after = fresh.unionByName(marks)
        if self._any():
            old = self._read().where((F.col("index_id") == index_id) & F.col("bucket").isin(touched)).where(F.col(self.key).isNotNull())
            after = old.drop("index_id").join(named, self.key, "left_anti").unionByName(after)
        done = cut(after.withColumn("index_id", F.lit(index_id)), "bucket-table")
        done.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_id", "bucket").parquet(self.path)


class Registry:
    """Named indexes and their settings as a table, a row for each name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, BucketTable(spark, path, "name string, settings string, live boolean", "name", 1)

    def _latest(self) -> DataFrame:
        return self.table.rows().where("live").select(F.col("name").alias("index_id"), "settings")

    def create(self, index_id: str, **settings) -> bool:
        """Register an index; False if it is there already, which then stays as it is."""
        if index_id in self.ids():
            return False
        self._put(index_id, json.dumps(settings, sort_keys=True), True)
        return True

    def _put(self, index_id: str, settings: str | None, live: bool) -> None:
        row = self.spark.createDataFrame([(index_id, settings, live)], "name string, settings string, live boolean")
        self.table.replace("registry", row.select("name"), row)

    def settings(self, index_id: str) -> dict | None:
        found = self._latest().where(F.col("index_id") == index_id).first()
        return json.loads(found.settings) if found else None

    def ids(self) -> list[str]:
        """Names are few: people give them."""
        return sorted(r.index_id for r in self._latest().select("index_id").collect())

    def drop(self, index_id: str, *tables: BucketTable) -> bool:
        """Forget an index and empty its rows in `tables`."""
        there = index_id in self.ids()
        for t in tables:
            own = t.rows(index_id)
            t.replace(index_id, own.select(t.key), own.limit(0))
        if there:
            self._put(index_id, None, False)
        return there


def checked_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """`vectors` (chunk_id, embedding); whatever writes or reads them fails at a row whose vector is null, of another length than `dim`, or not finite."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    said = F.concat(F.lit(f"an index of dimension {dim} takes no vector of "), F.when(F.col("embedding").isNull(), "null").otherwise(size.cast("string")), F.lit(" for "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null")))
    return vectors.withColumn("embedding", F.when(fits(dim), F.col("embedding")).otherwise(F.raise_error(said)))


def fits(dim: int) -> Column:
    return F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def write_vectors(table: BucketTable, index_id: str, vectors: DataFrame, dim: int, *, capacity: int = 0, refused: str | None = None) -> None:
    """Upsert `vectors` (chunk_id, embedding) into an index.

    Without `refused` one unfit row fails the write, and nothing changes. With it unfit rows are written there as Parquet and the
    others go in. More ids than `capacity` (0: no bound) fail the write before anything changes. Of rows with one id, that
    with the greatest vector stays.
    """
    one = vectors.select(F.col("chunk_id").cast("string"), "embedding").groupBy("chunk_id").agg(F.max_by("embedding", F.coalesce("embedding", F.array().cast("array<float>")).cast("array<double>")).alias("embedding"))
    if refused is None:
        kept = cut(checked_vectors(one, dim), "vectors")
    else:
        one = cut(one, "vectors")
        one.where(~fits(dim)).write.mode("append").parquet(refused)
        kept = one.where(fits(dim))
    if capacity:
        held = table.rows(index_id).select("chunk_id").unionByName(kept.select("chunk_id")).distinct().count()
        if held > capacity:
            raise ValueError(f"index {index_id} would hold {held} vectors; its capacity is {capacity}")
    table.replace(index_id, kept.select("chunk_id"), kept)


def healthy(chunks: DataFrame) -> bool:
    """Whether an index has chunks, and a probe word finds one among all of them; what is read ends with the first hit."""
    from lodestone.operators.lexical import postings

    return not postings(chunks).where(F.col("term").isin(*PROBES)).isEmpty()
