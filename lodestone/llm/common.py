"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count shows it has at most so many rows.
BROADCAST_ROWS = 200_000

#: Settings of a session by which few texts are decoded and handed to Python at once. By Spark's own, a batch of texts has 64 MB; the
#: JVM builds it in buffers of twice that, besides its heap, and the worker holds it whole.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = _local_dir()
    return named.rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    made = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def _in_shared(spark: SparkSession, name: str):
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark's file system removes it when the driver ends."""
    path, where, fs = _in_shared(spark, name)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """A `cut` whose tables are deleted at the end of the block; what outlives it has to be written by the plain one.

    Its `drop` deletes a table before that.
    """
    made = {}

    def own_cut(df: DataFrame, name: str) -> DataFrame:
        path, where, fs = _in_shared(df.sparkSession, name)
        fs.deleteOnExit(where)
        made[path] = where, fs
        df.write.parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        paths.append((back, path))
        return back

    def drop(df: DataFrame) -> None:
        for back, path in paths:
            if back is df and path in made:
                delete(*made.pop(path))

    def delete(where, fs) -> None:
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)

    own_cut.drop, paths = drop, []

    try:
        yield own_cut
    finally:
        for where, fs in made.values():
            delete(where, fs)


@contextmanager
def small_batches(spark: SparkSession):
    """Few texts at once for what runs in the block."""
    before = {k: spark.conf.get(k) for k in SMALL_BATCHES}
    set_small_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def set_small_batches(spark: SparkSession) -> None:
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)


def join_counted(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join, with `small` broadcast if it is counted to have at most `rows` rows, else shuffled.

    `small` has to be cheap to count: a written table or a small local one, and of narrow rows.
    """
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small, on, how)


def slices(batches: Iterator[pa.RecordBatch], *texts: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in stretches whose columns of texts hold about so many bytes, so that few long texts are unpacked at once.

    What is made of a stretch goes to Spark by itself, so neither side holds a large batch of results. A worker outlives
    its task, so what Arrow keeps for later goes back after each batch.
    """
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in texts)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()


def uniform(*columns: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on the values and the seed alone, so that reruns agree."""
    hashed = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
