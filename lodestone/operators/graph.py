"""Symbol graph: nodes, edges, neighbourhoods and score expansion, all as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.joins import BROADCAST_ROWS
from lodestone.operators.shared import cut, shared_path

# How much of a seed's score a neighbour gets, by the kind of edge.
MULTIPLIERS = {
    "CallsFunction": 0.70, "CalledByFunction": 0.70, "Implements": 0.85, "TypeContains": 0.80, "UsesType": 0.75, "Derives": 0.70,
    "ModuleContains": 0.80, "ReExports": 0.75, "RaisesError": 0.85, "Configures": 0.70, "TestedBy": 0.80, "TestUsesFixture": 0.65,
    "CoOccursInTest": 0.55, "Documents": 0.65, "ReferencesConcept": 0.60, "Aliases": 0.80, "ErrorDescribes": 0.70,
}
# The kinds of edges that each intent follows.
FOLLOWED = {
    "Definition": ("Implements", "Aliases", "UsesType"),
    "Usage": ("CallsFunction", "CalledByFunction", "TestedBy", "CoOccursInTest"),
    "Conceptual": ("ReferencesConcept", "Documents"),
    "BugDebt": ("RaisesError", "ErrorDescribes", "Configures"),
    "Unknown": ("CallsFunction", "CalledByFunction"),
}
CONTAINERS = ("Impl", "Class", "Struct", "Module")


def nodes(chunks: DataFrame, cap: int = 0) -> DataFrame:
    """(symbol, chunk_id, file) of every name; the first chunk by file and line defines it. `cap` keeps the first so many, 0 all."""
    named = chunks.where(F.coalesce(F.col("function_name"), F.lit("")) != "")
    first = F.struct("file", "start_line", "chunk_id")
    found = named.groupBy(F.col("function_name").alias("symbol")).agg(F.min(first).alias("at"))
    if cap:
        found = found.orderBy("at.file", "at.start_line", "at.chunk_id").limit(cap)
    return found.select("symbol", "at.chunk_id", "at.file")


def suffixes(node: DataFrame) -> DataFrame:
    """Names that end a qualified symbol, each with the least such symbol."""
    qualified = node.where(F.col("symbol").contains("::"))
    return qualified.groupBy(F.element_at(F.split("symbol", "::"), -1).alias("name")).agg(F.min("symbol").alias("qualified"))


def edges(chunks: DataFrame, node: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): calls and bases that resolve to a symbol, by name or by the last part of a qualified one; no loops."""
    node = nodes(chunks) if node is None else node
    named = chunks.where(F.coalesce(F.col("function_name"), F.lit("")) != "")

    def mentions(column: str, kind: str) -> DataFrame:
        return named.select(F.col("function_name").alias("src"), F.explode(column).alias("name"), F.lit(kind).alias("kind"))

    named_edges = mentions("calls", "CallsFunction").unionByName(mentions("inherits_from", "Implements"))
    exact = node.select(F.col("symbol").alias("_exact"))
    tails = suffixes(node).select(F.col("name").alias("_tail"), "qualified")
    resolved = named_edges.join(exact, F.col("name") == F.col("_exact"), "left").join(tails, F.col("name") == F.col("_tail"), "left")
    resolved = resolved.select("src", F.coalesce("_exact", "qualified").alias("dst"), "kind")
    return resolved.where("dst is not null and src <> dst")


def contains(chunks: DataFrame) -> DataFrame:
    """ModuleContains edges from each container to the other symbols of its file.

    Their number grows with the square of a file's containers, so pairs are made where they are put out: a file's
    containers are dealt over parts that all get its symbols, and only pairs of containers in several files are
    compared to drop repeated ones.
    """
    named = chunks.where("function_name <> '' and file is not null").select("file", "function_name", F.coalesce(F.col("chunk_type").isin(*CONTAINERS), F.lit(False)).alias("outer"))
    named = cut(named.groupBy("file", "function_name").agg(F.max("outer").alias("outer")), "named")
    outer = named.where("outer").select("file", F.col("function_name").alias("src"))
    several = outer.groupBy("src").agg((F.count("*") > 1).alias("several"))
    n = named.where("outer").count()
    parts = min(64, 1 + n // 1000)
    outer = outer.join(several, "src").withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int"))
    outer = cut(outer, "containers")
    inner = named.join(outer.select("file").distinct(), "file", "left_semi").select("file", F.col("function_name").alias("dst"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # A number of partitions of their own, as their size says nothing about that of the result.
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * parts)
    inner = inner.repartition(tasks, "file", "part")

    def pairs(own: DataFrame) -> DataFrame:
        met = own.select("file", "part", "src").repartition(tasks, "file", "part").join(inner, ["file", "part"])
        return met.where("src <> dst").select("src", "dst", F.lit("ModuleContains").alias("kind"))

    once = pairs(outer.where("not several"))
    return once if outer.where("several").isEmpty() else once.unionByName(pairs(outer.where("several")).distinct())


def both_ways(edge: DataFrame) -> DataFrame:
    return edge.select("src", "dst", "kind").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


def reached(edge: DataFrame, starts: DataFrame, hops: int | None = None, *, backwards: bool = False, both: bool = False, kinds: tuple[str, ...] = ("CallsFunction",)) -> DataFrame:
    """(start, symbol, hop) of what `starts` (start) reach in at most `hops` steps (None: any number), each once at its nearest, without themselves.

    A breadth-first search for all starts together: a hop joins what the last one found with the edges, less what was found
    before, until nothing is new. Edges and each hop are written to the shared folder, a hop as a partition of one table, so
    the plan of a hop and of the result stays as small as that of the first. The first hop is the starts' edges, as they
    are; later ones send all edges around only if the last hop found many symbols. `both` follows edges in either direction.

    Null starts and ends reach nothing; repeated edges and starts count once; a start that no edge has reaches nothing.
    """
    spark = edge.sparkSession
    ends = [("dst", "src")] if backwards else [("src", "dst")]
    ends += [ends[0][::-1]] * both
    steps = [edge.where(F.col("kind").isin(*kinds)).select(F.col(a).alias("_from"), F.col(b).alias("symbol")) for a, b in ends]
    step = cut(reduce(DataFrame.unionByName, steps).where("_from is not null and symbol is not null and _from <> symbol").distinct(), "steps")
    path = shared_path(spark, "reached")
    first = starts.where("start is not null").select("start", F.col("start").alias("symbol")).distinct()
    schema = f"start {first.schema['start'].dataType.simpleString()}, symbol {first.schema['symbol'].dataType.simpleString()}, hop int"
    first.write.parquet(f"{path}/hop=0")
    hop = 0
    while hops is None or hop < hops:
        seen = spark.read.schema(schema).parquet(path)
        last = seen.where(F.col("hop") == hop).select("start", F.col("symbol").alias("_from"))
        met = last.join(leading(step, last), "_from").select("start", "symbol")
        hop += 1
        # Edges are distinct and no loops, so their ends are new to a start.
        met = met if hop == 1 else met.distinct().join(seen, ["start", "symbol"], "left_anti")
        met.write.parquet(f"{path}/hop={hop}")
        if spark.read.schema("start string").parquet(f"{path}/hop={hop}").isEmpty():
            break
    return spark.read.schema(schema).parquet(path).where("hop > 0")


def leading(step: DataFrame, last: DataFrame) -> DataFrame:
    """The edges (_from) that lead on from `last`, broadcast if they are few; all where that is not known to be so."""
    ends = last.select("_from").distinct()
    if ends.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return step
    few = step.join(F.broadcast(ends), "_from", "left_semi")
    return F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few


def neighbours(edge: DataFrame, kinds: tuple[str, ...], of: DataFrame | None = None) -> DataFrame:
    """(src, dst, multiplier): symbols one step away in either direction, with the best multiplier among their edges; `of` (src) restricts them."""
    value = F
    for kind in kinds:
        value = value.when(F.col("kind") == kind, MULTIPLIERS[kind])
    found = both_ways(edge.where(F.col("kind").isin(*kinds))).select("src", "dst", value.alias("multiplier"))
    found = found if of is None else found.join(of, "src", "left_semi")
    return found.groupBy("src", "dst").agg(F.max("multiplier").alias("multiplier"))


def followed(edge: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(intent, src, dst, multiplier): the neighbours that a query of each intent follows."""
    found = None
    for intent, kinds in FOLLOWED.items():
        part = neighbours(edge, kinds, of).select(F.lit(intent).alias("intent"), "src", "dst", "multiplier")
        found = part if found is None else found.unionByName(part)
    return found


def expanded(seeds: DataFrame, chunk_symbols: DataFrame, node: DataFrame, edge: DataFrame, *, kinds: tuple[str, ...] = ("CallsFunction",)) -> DataFrame:
    """(query_id, chunk_id, score) of the seeds' neighbours that are no seeds themselves.

    A seed (query_id, chunk_id, score) stands for the symbol of its chunk (chunk_id, symbol); a neighbour is
    represented by the chunk that defines it and gets its best seed's score times the edge's multiplier. Where seeds
    have an `intent`, its kinds of edges are followed instead of `kinds`.
    """
    by_intent = ["intent"] * ("intent" in seeds.columns)
    from_seed = seeds.select("query_id", "chunk_id", "score", *by_intent).join(chunk_symbols, "chunk_id").withColumnRenamed("symbol", "src")
    # Few seeds select their edges before these are grouped.
    of = from_seed.select("src").distinct()
    of = F.broadcast(of) if of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None
    near = from_seed.join(followed(edge, of) if by_intent else neighbours(edge, kinds, of), ["src", *by_intent])
    hits = near.join(node.select(F.col("symbol").alias("dst"), F.col("chunk_id").alias("_at")), "dst")
    scored = hits.groupBy("query_id", F.col("_at").alias("chunk_id")).agg(F.max(F.col("score") * F.col("multiplier")).alias("score"))
    return scored.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def exported(node: DataFrame, edge: DataFrame, *, node_kinds: tuple[str, ...] = (), edge_kinds: tuple[str, ...] = (), least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (symbol, kind, chunk_id, file) and weighted edges, filtered; with a node filter, edges need both their ends."""
    from lodestone.functions.text import node_kind

    kept = node.withColumn("kind", node_kind(F.col("symbol")))
    if node_kinds:
        kept = kept.where(F.lower("kind").isin(*[k.lower() for k in node_kinds]))
    weight = F.coalesce(*[F.when(F.col("kind") == k, m) for k, m in MULTIPLIERS.items()], F.lit(1.0))
    links = edge.withColumn("weight", weight).where(F.col("weight") >= least)
    if edge_kinds:
        links = links.where(F.lower("kind").isin(*[k.lower() for k in edge_kinds]))
    if node_kinds:
        ends = kept.select("symbol")
        links = links.join(ends, F.col("src") == ends["symbol"], "left_semi").join(ends, F.col("dst") == ends["symbol"], "left_semi")
    return kept, links


def capped(chunks: DataFrame, cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first `cap` chunks (of each `by`) by file, line and id; all for 0."""
    if not cap:
        return chunks
    if not by:
        return chunks.orderBy("file", "start_line", "chunk_id").limit(cap)
    order = Window.partitionBy(*by).orderBy("file", "start_line", "chunk_id")
    return chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
