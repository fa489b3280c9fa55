"""The kept lexical index: updates equal a rebuild, terms' buckets alone are read, a repeated write changes nothing."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, search
from lodestone.operators.inverted import LexicalIndex

SCHEMA = "chunk_id string, index_id string, file string, start_line int, end_line int, content string, function_name string"


def rows(spark, texts):
    return spark.createDataFrame([(f"{f}:{n}", i, f, n, n, t, None) for i, f, n, t in texts], SCHEMA)


OLD = [("x", "a.rs", 1, "parseHTTP request login"), ("x", "a.rs", 2, "login password"), ("x", "b.rs", 1, "login guide"), ("y", "c.md", 1, "password request guide"), ("y", "d.md", 1, None), (None, "e.md", 1, "request of nobody")]
NEW = [("x", "a.rs", 1, "parseHTTP renewed login"), ("y", "f.md", 1, "request renewed password")]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def same(spark, index, chunks):
    """All that the index says is what the chunks say."""
    for by in ((), ("index_id",)):
        terms = lexical.term_stats(lexical.postings(chunks, keep=by), by)
        assert sorted(map(repr, index.term_stats(by).collect())) == sorted(map(repr, terms.collect()))
        stats = [sorted(repr((*r[:-1], round(r[-1], 9))) for r in s.collect()) for s in (index.corpus_stats(by), lexical.corpus_stats(chunks, by=by))]
        assert stats[0] == stats[1]
    found = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    queries = asked(spark, "login request", "renewed password", "nothing here", "")
    assert found(index.top(queries, 10)) == found(lexical.bm25_top(chunks, queries, 10))
    assert {(r.query_id, r.index_id, r.chunk_id, r.rank) for r in index.top(queries, 2, by=("index_id",)).where("index_id is not null").collect()} == {(r.query_id, r.index_id, r.chunk_id, r.rank) for r in lexical.bm25_top(chunks, queries, 2, by=("index_id",)).collect()}


def test_updates_equal_a_rebuild(spark, tmp_path):
    index = LexicalIndex.build(rows(spark, OLD), f"file://{tmp_path}/one", buckets=4)
    same(spark, index, rows(spark, OLD))
    files = spark.createDataFrame([("a.rs",), ("c.md",), ("f.md",), ("unknown",)], "file string")
    index.update(1, files, rows(spark, NEW))
    now = [r for r in OLD if r[1] not in ("a.rs", "c.md")] + NEW
    same(spark, index, rows(spark, now))
    # The same update again takes its own place.
    index.update(1, files, rows(spark, NEW))
    same(spark, index, rows(spark, now))
    index.update(2, spark.createDataFrame([("a.rs",), ("b.rs",)], "file string"), rows(spark, OLD[:2]))
    now = [r for r in now if r[1] not in ("a.rs", "b.rs")] + OLD[:2]
    same(spark, index, rows(spark, now))
    with pytest.raises(ValueError):
        index.update(1, files, rows(spark, NEW))
    small = index.compacted(f"file://{tmp_path}/two")
    same(spark, small, rows(spark, now))
    assert small.segments() == [0] and index.segments() == [0, 1, 2]
    # A new object over the same folder, as after a restart.
    same(spark, LexicalIndex(spark, f"file://{tmp_path}/one", 4), rows(spark, now))


def test_an_update_that_stops_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    index = LexicalIndex.build(rows(spark, OLD), f"file://{tmp_path}/one", buckets=4)
    files = spark.createDataFrame([("a.rs",), ("c.md",)], "file string")
    put = LexicalIndex._put

    def stop(self, df, table, *rest):
        if table == "corpus":
            raise OSError("the driver is lost")
        put(self, df, table, *rest)

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(LexicalIndex, "_put", stop)
        index.update(1, files, rows(spark, NEW))
    same(spark, index, rows(spark, OLD))
    index.update(1, files, rows(spark, NEW))
    same(spark, index, rows(spark, [r for r in OLD if r[1] not in ("a.rs", "c.md")] + NEW))


def test_one_path_in_two_indexes(spark, tmp_path):
    both = [("x", "a.rs", 1, "login one"), ("y", "a.rs", 2, "login two")]
    index = LexicalIndex.build(rows(spark, both), f"file://{tmp_path}/one", buckets=2)
    index.update(1, spark.createDataFrame([("x", "a.rs")], "index_id string, file string"), rows(spark, [("x", "a.rs", 1, "renewed")]))
    same(spark, index, rows(spark, [("x", "a.rs", 1, "renewed"), both[1]]))


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    index = LexicalIndex.build(rows(spark, OLD), f"file://{tmp_path}/one", buckets=16)
    queries = asked(spark, "login")
    bucket = queries.select(F.pmod(F.xxhash64(F.lit("login")), F.lit(16))).first()[0]
    plan = index.scores(queries)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert len(scans) == 3 and sum(bool(re.search(rf"bucket#\d+ = {bucket}\b", s)) for s in scans) == 2, scans
    files = [r[0] for r in index.postings([bucket]).select(F.input_file_name()).distinct().collect()]
    assert files and all(f"/bucket={bucket}/" in f for f in files)


def test_an_empty_index(spark, tmp_path):
    index = LexicalIndex.build(rows(spark, OLD).limit(0), f"file://{tmp_path}/one", buckets=4)
    assert index.top(asked(spark, "login"), 5).collect() == [] and index.term_stats().collect() == [] and not index.has_any(("login",))
    index.update(1, spark.createDataFrame([("a.rs",)], "file string"), rows(spark, OLD[:2]))
    assert index.has_any(("absent", "login")) and not index.has_any(("absent",))
    same(spark, index, rows(spark, OLD[:2]))


def test_search_over_a_kept_index(spark, tmp_path):
    chunks = rows(spark, OLD)
    kept = search.Index(chunks, kept=LexicalIndex.build(chunks, f"file://{tmp_path}/one", buckets=4))
    queries = asked(spark, "login request").withColumn("embedding", F.lit(None).cast("array<double>"))
    got = [[(r.chunk_id, round(r.score, 9), r.rank) for r in search.search(i, queries).orderBy("rank").collect()] for i in (kept, search.Index(chunks))]
    assert got[0] == got[1] and got[0]


def test_a_sort_takes_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.operators.inverted.SORTED", 1)
    chunks = rows(spark, [("x", f"{i}.rs", 1, f"login{i} request") for i in range(40)])
    index = LexicalIndex.build(chunks, f"file://{tmp_path}/one", buckets=2)
    same(spark, index, chunks)
    files = index._read("postings").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 8 and max(r["count"] for r in files) < 60  # two files, one for each bucket, if nothing parts it


def test_scores_are_summed_where_postings_are(spark, tmp_path):
    chunks = rows(spark, OLD)
    kept = LexicalIndex.build(chunks, f"file://{tmp_path}/one", buckets=4)
    fresh = search.Index(chunks)
    for found in (kept.scores(asked(spark, "login request")), fresh.lexical_scores(asked(spark, "login request"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)
    # Chunks are tokenized once, for their lengths and their postings.
    assert all("regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (fresh.stats, fresh.postings))
