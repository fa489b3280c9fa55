"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets an expected number of copies. The whole part of it is certain; for the
fractional part, documents are ranked by random odds over inclusion odds, and are taken in that order until
the words that the source still lacks are reached: a sample of fixed size (in words) with unequal
probabilities. One more document, that which fits best, closes the gap that whole documents leave; it is no Pareto
pick, and its inclusion is biased by its length (one document for each source). Within a source, expected copies fall with the length class of a document (by `tilt` for
each doubling), so a huge document is repeated less readily than a short one.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, ordered
last; a source without words has target 0; rows that are equal in all columns rank alike, in any order
among themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut, join_counted, scratch, uniform

#: Bins of a source's ranking, at each of two levels; the crossing point is searched in one bin of one bin.
BINS = 1024


def fill_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Split share * sum(sizes) by weight; what exceeds cap * size is reshared among the others by weight."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(over)]
    return targets


def expected_copies(words: dict[int, int], target: float, cap: float, tilt: float) -> dict[int, float]:
    """Copies for each length class: min(cap, c * 2^(-tilt * class)), with c such that the words come to target."""
    total = sum(words.values())
    if target >= cap * total:
        return dict.fromkeys(words, float(cap))
    weight = {b: 2.0 ** (-tilt * b) for b in words}
    free, left = set(words), target
    while True:
        c = left / sum(weight[b] * words[b] for b in free) if free and left > 0 else 0.0
        over = {b for b in free if c * weight[b] > cap}
        if not over:
            return {b: (c * weight[b] if b in free else float(cap)) for b in words}
        free -= over
        left -= sum(cap * words[b] for b in over)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with what its rows are ranked by: _m_source, _m_size, _m_cls, _m_key, _m_u."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumns({"_m_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")), "_m_size": size, "_m_key": F.xxhash64("text")})
    out = out.withColumn("_m_cls", F.when(F.col("_m_size") > 0, F.floor(F.log2("_m_size"))).otherwise(0).cast("int"))
    return out.withColumn("_m_u", uniform("doc_id", "_m_key", seed=seed))


def _ranked(keyed: DataFrame, strata: DataFrame) -> DataFrame:
    """With the columns of `strata`, and the rank _m_v (null: never drawn) in bins of bins."""
    odds = (F.col("_m_u") / (1 - F.col("_m_u"))) / (F.col("_m_pi") / (1 - F.col("_m_pi")))
    out = join_counted(keyed, strata, ["_m_source", "_m_cls"]).withColumn("_m_v", F.when((F.col("_m_pi") > 1e-9) & (F.col("_m_size") > 0), odds / (1 + odds)))
    out = out.withColumn("_m_bin", F.least(F.floor(F.col("_m_v") * BINS), F.lit(BINS - 1)).cast("int"))
    return out.withColumn("_m_sub", F.least(F.floor((F.col("_m_v") * BINS - F.col("_m_bin")) * BINS), F.lit(BINS - 1)).cast("int"))


def _chosen(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """With the columns of `ends`, and whether a row comes before its source's end in rank order."""
    here, same_bin = F.struct(*_HERE), F.col("_m_bin") == F.col("at__m_bin")
    before = (F.col("_m_bin") < F.col("at__m_bin")) | (same_bin & (F.col("_m_sub") < F.col("at__m_sub")))
    at_edge = F.col("_m_edge").isNotNull() & same_bin & (F.col("_m_sub") == F.col("at__m_sub")) & (here <= F.col("_m_edge"))
    return join_counted(ranked, ends, "_m_source", "left").withColumn("_m_chosen", F.col("_m_v").isNotNull() & F.coalesce(before | at_edge, F.lit(False)))


_HERE = ("_m_v", "doc_id", "_m_key")


def _plan(narrow: DataFrame, weights: tuple[float, ...], share: float, cap: int, tilt: float) -> tuple[DataFrame, DataFrame]:
    """(strata, ends): expected copies for each source and length class, and where each source's ranking ends.

    Both are small: a row for each source and length class, and for each source.
    """
    spark = narrow.sparkSession
    found: dict[str, dict[int, int]] = {}
    for r in narrow.groupBy("_m_source", "_m_cls").agg(F.sum("_m_size").alias("words")).collect():
        found.setdefault(r._m_source, {})[r._m_cls] = r.words
    names = sorted(found, key=lambda s: (s == "null", s))
    sizes = [sum(found[s].values()) for s in names]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    rows = []
    for name, total, target in zip(names, sizes, targets, strict=True):
        copies = expected_copies(found[name], target, cap, tilt)
        whole = {b: min(cap, math.floor(e + 1e-12)) for b, e in copies.items()}
        left = target - sum(whole[b] * found[name][b] for b in whole)
        rows += [(name, b, total, target, whole[b], max(0.0, copies[b] - whole[b]), left) for b in copies]
    strata = spark.createDataFrame(rows, "_m_source string, _m_cls int, _m_total long, _m_target double, _m_whole int, _m_pi double, _m_lacks double")

    with scratch() as own_cut:
        ranked = own_cut(_ranked(narrow, strata), "mix-ranked")
        first = _crossing(ranked, ["_m_source"], "_m_bin", F.col("_m_lacks"))
        within = join_counted(ranked, first, "_m_source").where("_m_bin = at__m_bin")
        second = own_cut(_crossing(within, ["_m_source", "at__m_bin", "before__m_bin"], "_m_sub", F.col("_m_lacks") - F.col("before__m_bin")), "mix-crossing")
        last = join_counted(ranked, second, "_m_source").where("_m_bin = at__m_bin and _m_sub = at__m_sub")
        order = Window.partitionBy("_m_source").orderBy(*_HERE)
        start = F.col("before__m_bin") + F.col("before__m_sub")
        upto = F.sum("_m_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + start
        fits = F.col("upto") <= F.col("_m_lacks")
        edge = last.withColumn("upto", upto).groupBy("_m_source").agg(
            F.max(F.when(fits, F.struct(*_HERE))).alias("_m_edge"),
            (F.max("_m_lacks") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.max(start))).alias("_m_gap"),
        )
        ends = own_cut(second.join(edge, "_m_source").select("_m_source", "at__m_bin", "at__m_sub", "_m_edge", "_m_gap"), "mix-ends")
        # The next document in rank order may be far longer than what is still lacking; one that closes the gap best is taken.
        off = F.abs(F.col("_m_gap") - F.col("_m_size"))
        closing = _chosen(ranked, ends).where(F.col("_m_v").isNotNull() & ~F.col("_m_chosen") & (off < F.col("_m_gap"))).groupBy("_m_source").agg(F.min(F.struct(off.alias("off"), *_HERE)).alias("c"))
        closing = closing.select("_m_source", F.struct(*[f"c.{c}" for c in _HERE]).alias("_m_closing"))
        return strata, cut(ends.join(closing, "_m_source", "left").drop("_m_gap"), "mix-ends")


def _taken(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int, tilt: float, seed: int) -> DataFrame:
    """`docs` with _m_copies and the columns it follows from. Every row is settled by small tables of its source: nothing is shuffled."""
    narrow = _keyed(docs.select("doc_id", "text", "source"), seed).drop("text", "source")
    with scratch() as own_cut:
        strata, ends = _plan(own_cut(narrow, "mix-sizes"), weights, share, cap, tilt)
    out = _chosen(_ranked(_keyed(docs, seed), strata), ends)
    chosen = F.col("_m_chosen") | F.coalesce(F.struct(*_HERE) == F.col("_m_closing"), F.lit(False))
    return out.withColumn("_m_copies", F.when(F.col("_m_size") > 0, F.col("_m_whole") + chosen.cast("int")).otherwise(0).cast("int"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, tilt: float = 0.25, seed: int = 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, text_key, size, source_size, target, copies, taken.

    `weights` go to the sources in code point order (null last), repeating. One row per source and length
    class (at most 64 for each) comes to the driver; sources are assumed to be named by people, so few.
    """
    out = _taken(docs.select("doc_id", "text", "source"), weights, share, cap, tilt, seed)
    named = {"text_key": "_m_key", "size": "_m_size", "source_size": "_m_total", "target": "_m_target", "copies": "_m_copies"}
    return out.select("doc_id", *[F.col(c).alias(n) for n, c in named.items()], (F.col("_m_size") * F.col("_m_copies")).cast("long").alias("taken"))


def _crossing(ranked: DataFrame, keys: list[str], bins: str, lacks) -> DataFrame:
    """For each source the bin in which its words in rank order first reach what it lacks, and the words before it."""
    sums = ranked.where(F.col("_m_v").isNotNull()).groupBy(*keys, bins).agg(F.sum("_m_size").alias("words"), F.max("_m_lacks").alias("_m_lacks"))
    upto = F.sum("words").over(Window.partitionBy(*keys).orderBy(bins).rowsBetween(Window.unboundedPreceding, 0))
    # Rounding must not leave a source without a crossing, so the last bin ends the search in any case.
    found = sums.withColumn("upto", upto).withColumn("last", F.max(bins).over(Window.partitionBy(*keys)))
    found = found.where((F.col("upto") >= lacks) | (F.col(bins) == F.col("last")))
    best = found.groupBy(*keys).agg(F.min(F.struct(F.col(bins).alias("b"), (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    return best.select(*keys, F.col("x.b").alias(f"at_{bins}"), F.col("x.before").alias(f"before_{bins}"))


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, tilt: float = 0.25, seed: int = 20) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, its columns unchanged."""
    taken = _taken(docs, weights, share, cap, tilt, seed).where("_m_copies > 0")
    return taken.withColumn("_m_n", F.explode(F.sequence(F.lit(1), "_m_copies"))).select(*docs.columns)
