"""SQL functions give what the column functions and chunkers give."""

from pyspark.sql import functions as F

from lodestone.functions import intent, sql, text
from lodestone.operators import vectors
from lodestone.sources import chunks

TEXTS = ["parseHTTPRequest utf8mb4 foo_bar", "", None, "Éa HTTP2Client x", "callers of fn a", "what is this", "one two three four five six seven", "CodeIndexer", "panic!b"]


def test_scalars_are_the_same(spark):
    sql.register(spark)
    sql.register(spark)
    spark.createDataFrame([(t,) for t in TEXTS], "t string").createOrReplaceTempView("texts")
    got = spark.sql("select t, code_tokenize(t) as ts, query_intent(t) as i from texts").collect()
    wanted = spark.table("texts").select("t", text.code_tokens(F.col("t")).alias("ts"), intent.intent(F.col("t")).alias("i")).collect()
    assert got == wanted
    pairs = [([1.0, 2.0], [2.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])]
    spark.createDataFrame(pairs, "a array<double>, b array<double>").createOrReplaceTempView("pairs")
    got = [r[0] for r in spark.sql("select cosine_sim(a, b) from pairs").collect()]
    assert got[:4] == [r[0] for r in spark.table("pairs").select(vectors.cosine(F.col("a"), F.col("b"))).collect()][:4] and got[4] == 0.0
    # No Python and no join: the functions are expressions of the plan.
    assert "Python" not in spark.sql("select code_tokenize(t) from texts")._jdf.queryExecution().executedPlan().toString()


def test_chunker_in_a_lateral_join(spark):
    sql.register(spark)
    files = spark.createDataFrame([("a.txt", "\n".join(map(str, range(23)))), ("b.txt", "one\r\ntwo\n"), ("c.txt", ""), ("d.txt", None)], "file string, content string")
    files.createOrReplaceTempView("files")
    got = spark.sql("select f.file, c.* from files f, lateral chunk_lines(f.file, f.content, 10, 4) c")
    wanted = chunks.sliding(files, 10, 4).select("file", "chunk_id", "start_line", "end_line", "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
