import collections

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, fusion, graph, intervals, lexical, search, store, vectors

CHUNK = "chunk_id string, index_id string, file string, start_line int, end_line int, content string, function_name string, chunk_type string, calls array<string>, inherits_from array<string>"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "x", f, s, s + 5, c, n, t, calls, bases) for i, f, s, c, n, t, calls, bases in rows], CHUNK)


def small(spark):
    return chunks(
        spark,
        [
            ("a", "src/auth.rs", 1, "login password secure", "authenticate", "Function", [], []),
            ("b", "src/ui.rs", 1, "rendering components", "render", "Function", [], []),
            ("c", "src/login.rs", 1, "handler entry", "login_handler", "Function", ["authenticate"], []),
            ("d", "docs/auth.md", 1, "login password guide", None, "Docstring", [], []),
        ],
    )


def test_bm25_and_hybrid_with_graph(spark):
    table = small(spark)
    asked = spark.createDataFrame([(1, "callers of login password", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    found = [r.chunk_id for r in lexical.bm25_top(table, asked, 10).orderBy("rank").collect()]
    assert set(found) == {"a", "d"}
    node = graph.nodes(table)
    index = search.Index(table, None, None, node, graph.edges(table, node))
    rows = {r.chunk_id: r for r in search.search(index, asked).collect()}
    assert rows["c"].match_reason == "hybrid+kg" and abs(rows["c"].score - 0.7 * rows["a"].score) < 1e-12
    assert rows["a"].match_reason == "bm25" and "c" not in {r.chunk_id for r in search.search(index, asked, expand=False).collect()}


def test_definition_demotes_documents_and_branch_lifts(spark):
    table = small(spark)
    asked = spark.createDataFrame([(1, "define login password", None)], "query_id long, text string, embedding array<double>")
    index = search.Index(table)
    assert search.search(index, asked).orderBy("rank").first().file == "src/auth.rs"
    branch = spark.createDataFrame([("./docs/auth.md",)], "file string")
    lifted = search.search(index, asked, branch=branch, boost=9.0).orderBy("rank").first()
    assert lifted.file == "docs/auth.md" and lifted.on_branch


def test_entity_goes_first(spark):
    entities = spark.createDataFrame([("NamedType", "Handler", "src/login.rs", 2)], "entity_type string, text string, file string, line int")
    asked = spark.createDataFrame([(1, "handler", None)], "query_id long, text string, embedding array<double>")
    assert search.search(search.Index(small(spark), entities=entities), asked).orderBy("rank").first().chunk_id == "c"


def test_fusion_order_and_ties(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id long, chunk_id string, rank int")
    found = fusion.fused([fusion.lane(one, 1.0), fusion.lane(two, 1.0)], 1).collect()
    assert [r.chunk_id for r in found] == ["a"]


def test_diversity(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.9, [1.0, 0.0]), (1, "c", 0.8, [0.0, 1.0])], "query_id long, chunk_id string, score double, embedding array<double>")
    assert [r.chunk_id for r in fusion.diverse(rows).orderBy("rank").collect()] == ["a", "c", "b"]


def test_budget_and_overlaps(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 700), (1, 3, 100)], "query_id long, rank int, tokens long")
    assert [r.rank for r in fusion.within_budget(rows, 1000).orderBy("rank").collect()] == [1, 3]
    spans = spark.createDataFrame([(1, 1, "a", "f", 1, 10, 0.5, "x"), (1, 2, "b", "f", 8, 20, 0.9, "xyz"), (1, 3, "c", "g", 1, 2, 0.1, "q")], "query_id long, rank int, chunk_id string, file string, start_line int, end_line int, score double, content string")
    merged = fusion.merged_overlaps(spans).orderBy("rank").collect()
    assert [(r.chunk_id, r.start_line, r.end_line, r.content) for r in merged] == [("b", 1, 20, "xyz"), ("c", 1, 2, "q")]


def test_cosine_edges(spark):
    row = spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), vectors.cosine(F.array(F.lit(2.0)), F.array(F.lit(3.0))).alias("o")).first()
    assert (row.z, row.d, row.o) == (0.0, 0.0, 1.0)


def test_hashing_embedder_is_normal(spark):
    rows = spark.createDataFrame([("alpha beta",), ("alpha beta",), ("",)], "text string")
    got = [r.embedding for r in vectors.HashingEmbedder(8).embed(rows).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and not any(got[2])


def test_graph_suffix_loops_and_hops(spark):
    table = chunks(spark, [("1", "f.rs", 1, "", "m::go", "Function", ["run"], []), ("2", "f.rs", 9, "", "run", "Method", ["run", "go"], ["Base"]), ("3", "g.rs", 1, "", "Base", "Class", ["nowhere"], [])])
    edge = {(r.src, r.dst, r.kind) for r in graph.edges(table).collect()}
    assert edge == {("m::go", "run", "CallsFunction"), ("run", "m::go", "CallsFunction"), ("run", "Base", "Implements")}
    starts = spark.createDataFrame([("run",), ("absent",)], "start string")
    assert [(r.symbol, r.hop) for r in graph.reached(graph.edges(table), starts, 3).collect()] == [("m::go", 1)]
    assert graph.reached(graph.edges(table), starts, 0).count() == 0


def test_cells_are_pruned_exact_and_near(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8))
    points = [(i, [float(x) for x in middles[i % 12] + rng.normal(0, 0.2, 8)]) for i in range(900)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0]), (3, [1.0] * 8)]
    rows = spark.createDataFrame(points, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, points[7 * i][1]) for i in range(40)] + [(98, [1.0]), (99, None)], "query_id long, embedding array<double>")
    index = cells.VectorCells.build(rows, f"{tmp_path}/cells", cells=12)
    show = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    wanted = vectors.cosine_top(rows.where("chunk_id < 1000"), asked.where("query_id < 90"), 10)
    assert show(index.top(asked, 10)) == show(wanted)
    assert show(cells.VectorCells(spark, f"{tmp_path}/cells").top(asked, 10)) == show(wanted)
    few = index.top(asked, 10, probe=2)
    got = cells.recall(few, wanted).agg(F.avg("recall"), F.count("*")).first()
    assert got[0] >= 0.9 and got[1] == 40
    one = index.top(asked.where("query_id = 0"), 10, probe=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "cell#" in plan
    read = index.rows([0, 1]).select(F.input_file_name()).distinct().collect()
    assert read and all("/cell=0/" in r[0] or "/cell=1/" in r[0] for r in read)
    assert cells.VectorCells.build(rows.limit(0), f"{tmp_path}/none").top(asked, 5).count() == 0


def test_reach_of_any_depth(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n3", "n20"), ("n25", "n0"), ("n5", "n5"), ("n1", None), (None, "n2"), ("n0", "n1")]
    edge = spark.createDataFrame([(a, b, "CallsFunction") for a, b in links] + [("n0", "other", "Implements")], "src string, dst string, kind string")
    starts = spark.createDataFrame([("n0",), ("n0",), ("n24",), ("absent",), (None,)], "start string")
    plain = {}
    for s in ("n0", "n24"):
        seen, front, hop = {s: 0}, [s], 0
        while front:
            hop += 1
            front = sorted({b for a, b in links if a in front and b and b not in seen})
            seen |= dict.fromkeys(front, hop)
        plain |= {(s, k): v for k, v in seen.items() if v}
    found = graph.reached(edge, starts)
    assert {(r.start, r.symbol): r.hop for r in found.collect()} == plain and found.count() == len(plain)
    assert {(r.start, r.symbol): r.hop for r in graph.reached(edge, starts, 4).collect()} == {k: v for k, v in plain.items() if v <= 4}
    # One scan, however many hops.
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    around = {(r.start, r.symbol) for r in graph.reached(edge, starts.where("start = 'n24'"), 1, both=True).collect()}
    assert around == {("n24", "n23"), ("n24", "n25")}
    assert {r.symbol for r in graph.reached(edge, starts, 1, kinds=("Implements",)).collect()} == {"other"}


def test_points_meet_their_ranges_alone(spark):
    import random

    rng = random.Random(4)
    spans = [(f"f{i % 3}", i, s, s + rng.choice((0, 1, 2, 7, 8, 9, 100, 4000))) for i in range(300) for s in [rng.randrange(1, 5000)]]
    spots = [(f"f{i % 4}", rng.randrange(0, 6000)) for i in range(500)] + [("f0", None), (None, 5)]
    ranges = spark.createDataFrame([*spans, ("f0", 900, 9, 8), ("f0", 901, None, 8), (None, 902, 1, 8)], "file string, id int, start_line int, end_line int")
    points = spark.createDataFrame(spots, "file string, line int")
    got = sorted((r.file, r.line, r.id) for r in intervals.points_in_ranges(points, ranges, "file").collect())
    assert got == sorted((f, p, i) for f, p in spots for g, i, s, e in spans if f == g and p is not None and s <= p <= e)
    assert intervals.points_in_ranges(points, ranges.limit(0), "file").count() == 0


def test_a_file_of_many_lines_makes_few_pairs(spark):
    ranges = spark.range(0, 100_000, 5).select(F.lit("f").alias("file"), F.col("id"), F.col("id").alias("start_line"), (F.col("id") + 9).alias("end_line"))
    points = spark.range(0, 100_000).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    found = intervals.points_in_ranges(points, ranges, "file")
    assert found.count() == 199_995
    found.write.format("noop").mode("overwrite").save()
    near = points.withColumn("b", F.floor(F.col("line") / 16)).join(ranges.withColumn("b", F.explode(F.array_distinct(F.array(F.floor(F.col("start_line") / 16), F.floor(F.col("end_line") / 16))))), ["file", "b"]).count()
    assert near < 4 * 199_995  # what is compared, of two billion pairs


def test_tables_replace_touched_buckets_alone(spark, tmp_path):
    table = store.BucketTable.of_chunks(spark, f"file://{tmp_path}/chunks", buckets=8)
    assert table.rows("x").count() == 0
    table.replace("x", small(spark).select("file"), small(spark))
    table.replace("y", small(spark).select("file"), small(spark).where("chunk_id = 'a'"))
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks").rglob("*.parquet")}
    files = spark.createDataFrame([("src/ui.rs",), ("unknown.rs",)], "file string")
    for _ in range(2):  # a repeated write changes nothing
        table.replace("x", files, small(spark).limit(0))
        assert sorted(r.chunk_id for r in table.rows("x").collect()) == ["a", "c", "d"] and [r.chunk_id for r in table.rows("y").collect()] == ["a"]
    touched = {r[0] for r in files.select(F.pmod(F.xxhash64("file"), F.lit(8))).collect()}
    gone = [p for p in written if not p.exists()]
    assert gone and all("index_id=x" in str(p) and int(str(p.parent).rpartition("=")[2]) in touched for p in gone)
    table.replace("x", files, small(spark).where("chunk_id = 'b'").withColumn("content", F.lit("again")))
    assert table.rows("x").where("chunk_id = 'b'").first().content == "again" and table.rows().count() == 5


def test_a_write_that_stops_half_way_loses_nothing(spark, tmp_path, monkeypatch):
    table = store.BucketTable.of_chunks(spark, f"file://{tmp_path}/chunks", buckets=2)
    table.replace("x", small(spark).select("file"), small(spark))

    def stop(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "cut", stop)
        table.replace("x", small(spark).select("file"), small(spark).limit(0))
    assert table.rows("x").count() == 4


def test_registry(spark, tmp_path):
    table = store.BucketTable.of_chunks(spark, f"file://{tmp_path}/chunks", buckets=2)
    table.replace("x", small(spark).select("file"), small(spark))
    names = store.Registry(spark, f"file://{tmp_path}/names")
    assert names.ids() == [] and names.settings("x") is None
    assert names.create("x", root="/r") and not names.create("x", root="/other") and names.create("y") and names.ids() == ["x", "y"]
    assert store.Registry(spark, f"file://{tmp_path}/names").settings("x") == {"root": "/r"}
    assert names.drop("x", table) and not names.drop("x", table) and names.ids() == ["y"] and table.rows("x").count() == 0
    assert names.create("x", root="/new") and names.settings("x") == {"root": "/new"}


def test_vectors_are_checked_when_they_are_written(spark, tmp_path):
    table = store.BucketTable.of_vectors(spark, f"file://{tmp_path}/vectors", buckets=2)
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    store.write_vectors(table, "x", good, 2)
    for bad in ([1.0], None, [1.0, float("nan")], [1.0, None], []):
        unfit = spark.createDataFrame([("c", bad), ("d", [5.0, 5.0])], "chunk_id string, embedding array<float>")
        assert store.unfit_vectors(unfit, 2).count() == 1
        with pytest.raises(Exception, match="an index of dimension 2 takes no vector"):
            store.write_vectors(table, "x", unfit, 2)
    assert {r.chunk_id for r in table.rows("x").collect()} == {"a", "b"}
    store.write_vectors(table, "x", unfit, 2, refused=f"{tmp_path}/refused")
    assert {r.chunk_id for r in table.rows("x").collect()} == {"a", "b", "d"} and [r.chunk_id for r in spark.read.parquet(f"{tmp_path}/refused").collect()] == ["c"]
    more = spark.createDataFrame([("a", [3.0, 3.0]), ("e", [4.0, 4.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(ValueError, match="would hold 4 vectors; its capacity is 3"):
        store.write_vectors(table, "x", more, 2, capacity=3)
    store.write_vectors(table, "x", more, 2, capacity=4)
    assert {r.chunk_id: r.embedding for r in table.rows("x").collect()}["a"] == [3.0, 3.0] and table.rows("x").count() == 4


def test_intents_follow_their_kinds_of_edges(spark):
    edge = spark.createDataFrame([("s", "t", "CallsFunction"), ("u", "s", "TestedBy"), ("s", "v", "Implements"), ("s", "w", "ErrorDescribes")], "src string, dst string, kind string")
    node = spark.createDataFrame([(x, x.upper(), "f") for x in "stuvw"], "symbol string, chunk_id string, file string")
    seeds = spark.createDataFrame([(1, "S", 1.0, "Usage"), (2, "S", 1.0, "Definition"), (3, "S", 1.0, "BugDebt"), (4, "S", 1.0, "Unknown"), (5, "S", 1.0, "Conceptual")], "query_id long, chunk_id string, score double, intent string")
    got = {(r.query_id, r.chunk_id): r.score for r in graph.expanded(seeds, node.select("chunk_id", "symbol"), node, edge).collect()}
    assert got == {(1, "T"): 0.7, (1, "U"): 0.8, (2, "V"): 0.85, (3, "W"): 0.7, (4, "T"): 0.7}


def test_cap_takes_updates_first(spark):
    old = small(spark).where("chunk_id in ('a', 'b')")
    assert {r.chunk_id for r in store.within_cap(old, small(spark), 3).collect()} == {"a", "b", "d"}


def test_health_looks_at_all_chunks(spark):
    chunks = spark.range(0, 12_000, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") == 11_999, "def probe").otherwise("nothing here").alias("content"))
    assert store.healthy(chunks) and not store.healthy(chunks.where("chunk_id <> '11999'")) and not store.healthy(chunks.limit(0))


def test_all_indexes_are_searched_with_both_lanes(spark):
    table = small(spark)
    near = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    indexes = {"one": search.Index(table, near), "two": search.Index(table.where("chunk_id <> 'a'")), "none": search.Index(table.limit(0))}
    asked = spark.createDataFrame([(1, "login password", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    for mode in ("flat", "fold"):
        found = {(r.index_id, r.chunk_id): r for r in search.search_all(indexes, asked, mode=mode).collect()}
        assert {("one", "a"), ("one", "d"), ("one", "b"), ("two", "d")} <= found.keys() and found["one", "a"].match_reason == "hybrid"
        assert found["one", "a"].rank == 1 and abs(found["one", "a"].score - 1 / 61) < 1e-12 and found["two", "d"].content == "login password guide"
    assert {r.index_id for r in search.search_all(indexes, asked, only=["two", "absent"]).collect()} == {"two"}
    assert search.search_all(indexes, asked, only=["absent"]).count() == 0
    routes = spark.createDataFrame([(1, "two"), (2, "one")], "query_id long, index_id string")
    assert {r.index_id for r in search.search_all(indexes, asked, routes=routes).collect()} == {"two"}


def test_routing(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    contexts = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("r", None), ("s", [-1.0, 0.0])], "index_id string, embedding array<double>")
    weights = vectors.routing_weights(asked, contexts)
    assert {r.index_id: r.weight for r in weights.collect()} == {"p": 1.0, "q": 0.0, "r": 1.0, "s": 0.0}
    assert {r.index_id for r in vectors.routed(weights, "threshold").collect()} == {"p", "r"}
    assert [r.index_id for r in vectors.routed(weights, "top_n", n=0).collect()] == ["p"]


def test_containers_of_one_large_file_and_of_several(spark):
    rows = [("big.rs", f"C{i}", "Class") for i in range(1200)] + [("big.rs", "f", "Function"), ("a.rs", "C1", "Class"), ("a.rs", "C2", "Function"), ("a.rs", "f", "Function"), (None, "C3", "Class"), ("a.rs", "", "Class"), ("a.rs", None, "Class")]
    found = graph.contains(spark.createDataFrame(rows, "file string, function_name string, chunk_type string"))
    # Pairs are put out where they are made: a distinct over all of them would move their square.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [src") == 1 and "Union" in plan
    got = collections.Counter((r.src, r.dst) for r in found.collect())
    wanted = {(s, d) for f, s, k in rows if f and s and k == "Class" for g, d, _ in rows if g == f and d and d != s}
    assert set(got) == wanted and max(got.values()) == 1


def test_few_found_symbols_lead_on_without_moving_all_edges(spark):
    step = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("b", "d")], "_from string, symbol string")
    last = spark.createDataFrame([("s", "b"), ("t", "b")], "start string, _from string")
    assert sorted(graph.leading(step, last).collect()) == [("b", "c"), ("b", "d")]
    plan = last.join(graph.leading(step, last), "_from")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
