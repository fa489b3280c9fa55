import pytest
from pyspark.sql import functions as F

from lodestone.functions import intent, text


def value(spark, column, *args):
    return spark.range(1).select(column(*[F.lit(a) for a in args]).alias("v")).first().v


@pytest.mark.parametrize(
    ("source", "tokens"),
    [
        ("CodeIndexer", ["code", "codeindexer", "indexer"]),
        ("use_kg_first", ["first", "kg", "use"]),
        ("HTTP2Client", ["2", "client", "http", "http2", "http2client"]),
        ("HTTPSClient", ["client", "https", "httpsclient"]),
        ("foo foo bar", ["bar", "foo"]),
        ("", []),
        (None, []),
    ],
)
def test_code_tokens(spark, source, tokens):
    got = value(spark, text.code_tokens, source)
    assert got == sorted(set(got)) and set(tokens) <= set(got) and (source or not got)


@pytest.mark.parametrize(("source", "rows"), [("", []), (None, []), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])])
def test_lines(spark, source, rows):
    assert value(spark, text.lines, source) == rows


def test_snippet_and_demotion(spark):
    assert value(spark, text.snippet, "\n".join("abcdefghi")) == "\n".join("abcdefg")
    assert value(spark, text.snippet, "a\nb\n") == "a\nb\n"
    assert [value(spark, text.doc_demotion, f) for f in ("a.MD", "a.rs", "a.yml", "mdx")] == [0.5, 1.0, 0.5, 1.0]


def test_globs(spark):
    paths = spark.createDataFrame([("src/a.rs",), ("src/gen/b.rs",), ("docs/x.md",)], "p string")
    kept = [r.p for r in paths.where(~text.excluded(F.col("p"), ["gen", "*.md"])).collect()]
    assert kept == ["src/a.rs"]


@pytest.mark.parametrize(
    ("asked", "label"),
    [
        ("fn search_hybrid", "Definition"), ("callers of fn search_hybrid", "Usage"), ("how does the search work", "Conceptual"), ("TODO items in search", "BugDebt"),
        ("authenticate tested by login_test", "Usage"), ("which types implements Embedder", "Definition"), ("functions that raises ConfigError", "BugDebt"),
        ("RoomType definition", "Definition"), ("one two three four five six", "Conceptual"), ("HTTP2Client", "Definition"), ("a panic! b", "Unknown"), ("plain", "Unknown"),
    ],
)
def test_intents(spark, asked, label):
    assert value(spark, intent.intent, asked) == label


def test_domain_terms_only_lift_unknown(spark):
    rows = spark.createDataFrame([("Booking flow",), ("why booking",)], "t string")
    assert [r[0] for r in rows.select(intent.domain_intent(F.col("t"), ["booking"])).collect()] == ["Definition", "Conceptual"]
