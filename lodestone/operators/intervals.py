"""Joins of points with the ranges that hold them, without comparing all points of a key with all its ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: str | Sequence[str], *, at: str = "line", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Every pair of a point and a range of the same key with start <= at <= end; the other columns of both sides need names of their own.

    Lines are dealt into bins whose width is a power of two. A range goes to the one or two bins that it touches at the level of
    its own length, a point to its bin at each level that occurs (at most 32). They meet by an equality join on key,
    level and bin, where a point sees only ranges of about the bin's width near it, and are compared once.

    Nulls in the key, the point or an end of the range meet nothing, nor do ranges that end before they start; repeated rows
    meet as often as they are there.
    """
    keys = [key] if isinstance(key, str) else list(key)
    level = F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    dealt = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    bins = F.array_distinct(F.array(*[F.floor(F.col(c) / width).cast("long") for c in (start, end)]))
    dealt = dealt.withColumn("_bin", F.explode(bins))
    # At most 32 numbers.
    levels = sorted(r[0] for r in dealt.select("_level").distinct().collect())
    spots = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col(at) / F.lit(float(1 << n))).cast("long").alias("_bin")) for n in levels or [0]])
    near = points.withColumn("_spot", F.explode(spots)).select("*", "_spot._level", "_spot._bin").drop("_spot")
    met = near.join(dealt, [*keys, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return met.drop("_level", "_bin")
