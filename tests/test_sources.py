import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import concepts, store
from lodestone.operators.inverted import LexicalIndex
from lodestone.sources import chunks, declarations, files, manifests, settings
from lodestone.streaming import changes


def table(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in contents.items()], "file string, content string")


def shape(found):
    return [(r.start_line, r.end_line, r.function_name) for r in found.orderBy("file", "start_line").collect()]


def test_sliding(spark):
    text = "\n".join(f"line {i}" for i in range(1, 201))
    assert shape(chunks.sliding(table(spark, a__rs=text, b__rs=""))) == [(1, 150, None), (51, 200, None)]


def test_markdown_ignores_fences(spark):
    text = "intro\n\n# One\ntext\n```\n# not\n```\n## Two\nmore\n"
    assert shape(chunks.markdown(table(spark, a__md=text))) == [(1, 2, None), (3, 7, "One"), (8, 9, "Two")]


def test_formats(spark):
    assert shape(chunks.yaml(table(spark, a__yaml="# c\nname: x\nlist:\n  - a\n  b: 2\n"))) == [(2, 2, "name"), (3, 5, "list")]
    assert shape(chunks.toml(table(spark, a__toml="x = 1\n[one]\na = 1\n[[two]]\nb = 2\n"))) == [(2, 3, "one"), (4, 5, "two")]
    assert shape(chunks.json(table(spark, a__json="{}\n", b__json="\n" * 500))) == [(1, 1, None)]
    assert shape(chunks.plaintext(table(spark, a__txt="a\nb\n\n\nc\n" + "\n" + "x\n" * 60))) == [(1, 2, None), (5, 5, None), (7, 56, None), (57, 66, None)]
    assert shape(chunks.xml(table(spark, a__xml="<r>\n<a>\n<b/>\n</a>\n<one>1</one>\n<c>\nx\n</c>\n</r>"))) == [(2, 4, "a"), (6, 8, "c")]
    assert chunks.documents(table(spark, a__md="# x\n", b__rs="fn a() {}", c__json="{}", d__log="x")).count() == 4


def test_oversized(spark):
    found = chunks.split_oversized(chunks.whole(table(spark, a__rs="\n".join(["x"] * 201))))
    parent = found.where("parent_chunk_id is null").first()
    assert len(parent.child_chunk_ids) == found.count() - 1 == 4
    assert [(r.start_line, r.end_line) for r in found.where("parent_chunk_id is not null").orderBy("start_line").collect()] == [(1, 100), (51, 150), (101, 200), (151, 201)]


RUST = '''use serde::Value;
/// Reads `Config` from HTTP
pub struct Reader { a: u8 }
impl Read for Reader {
    fn read(&self) -> u8 { self.helper(); panic!("something bad here") }
}
fn helper() {}
'''


def test_declarations(spark):
    rows = {r.function_name: r for r in declarations.declarations(table(spark, a__rs=RUST)).orderBy("start_line").collect()}
    assert {"Reader": "Impl", "Reader::read": "Method", "helper": "Function"}.items() <= {k: r.chunk_type for k, r in rows.items()}.items()
    assert rows["Reader::read"].calls == ["helper", "panic"] and rows["Reader"].inherits_from == ["Read"]
    python = "class A(B, C):\n    def run(self):\n        return go()\n\ndef top():\n    def inner():\n        pass\n    return 1\n"
    got = {r.function_name: r for r in declarations.declarations(table(spark, m__py=python)).collect()}
    assert set(got) == {"A", "run", "top"} and got["run"].chunk_type == "Method" and got["A"].inherits_from == ["B", "C"] and got["top"].end_line == 8
    plain = declarations.declarations(table(spark, z__py="x = 1\n")).first()
    assert plain.chunk_type == "Code" and plain.function_name is None


def test_comments_and_attributes_belong_to_what_follows(spark):
    rust = "fn a() {\n    // inside\n    go();\n}\n\n/// Makes a Widget from `Bar`\n#[inline]\nfn b() {}\n// loose\n\nfn c() {}\n"
    rows = {r.function_name: r for r in declarations.declarations(table(spark, a__rs=rust)).collect()}
    assert [(n, rows[n].start_line, rows[n].end_line) for n in "abc"] == [("a", 1, 4), ("b", 8, 8), ("c", 11, 11)]
    assert rows["b"].nlp_keywords == ["Bar", "Makes", "Widget"] and rows["b"].nlp_code_refs == ["Bar"]
    assert rows["a"].nlp_keywords == [] and rows["c"].nlp_keywords == []
    python = "@first\ndef a():\n    return 1\n\n# on b\n@second\ndef b():\n    return 2\n"
    assert shape(declarations.declarations(table(spark, m__py=python))) == [(2, 3, "a"), (7, 8, "b")]
    java = "class A {\n    /** Makes one. */\n    @Override\n    public int one() {\n        return 1;\n    }\n    // two\n    public int two() {\n        return 2;\n    }\n}\n"
    assert {(r.function_name, r.start_line, r.end_line) for r in declarations.declarations(table(spark, m__java=java)).collect()} == {("A", 1, 11), ("one", 4, 6), ("two", 8, 10)}


def found_in(spark, **contents):
    rows = declarations.declarations(table(spark, **contents)).collect()
    return {(r.function_name, r.chunk_type, r.start_line, r.end_line, r.chunk_depth) for r in rows}


SCOPES_RUST = """mod deep {
    // fn no() {
    const S: &str = "fn neither() { {";
    const R: &str = r#"} } fn raw() {"#;
    pub trait Shape<'a> {
        fn area(&self) -> f64;
        fn twice(&self) -> f64 {
            let c = '{'; /* } */
            fn inner() {}
            self.area() * 2.0
        }
    }
    pub struct Point {
        x: u8,
    }
    struct Unit;
    impl<'a> Shape<'a> for Point
    where
        Point: Sized,
    {
        fn area(
            &self,
        ) -> f64 {
            if true {
                1.0
            } else {
                sum(&self.x)
            }
        }
    }
}
fn last() {
    run("call()");
}
"""


def test_scopes_in_languages_with_braces(spark):
    assert found_in(spark, a__rs=SCOPES_RUST) == {
        ("deep", "Module", 1, 31, 0), ("Shape", "Trait", 5, 12, 1), ("Shape::area", "Method", 6, 6, 2), ("Shape::twice", "Method", 7, 11, 2), ("Point", "Class", 13, 15, 1),
        ("Unit", "Class", 16, 16, 1), ("Point", "Impl", 17, 30, 1), ("Point::area", "Method", 21, 29, 2), ("last", "Function", 32, 34, 0),
    }
    calls = {(r.function_name, r.start_line): r.calls for r in declarations.declarations(table(spark, a__rs=SCOPES_RUST)).collect()}
    assert calls["Point::area", 21] == ["sum"] and calls["last", 32] == ["run"]
    script = "class A {\n  go(a = {}) {\n    const t = `}\n} ${x}\n`;\n    if (a) {\n      b();\n    }\n  }\n\n  stop() { return '}'; }\n}\nfunction one() {}\nfunction two()\n{\n  one();\n}\n"
    assert found_in(spark, a__js=script) == {("A", "Class", 1, 12, 0), ("go", "Method", 2, 9, 1), ("stop", "Method", 11, 11, 1), ("one", "Function", 13, 13, 0), ("two", "Function", 14, 17, 0)}
    kotlin = "class Foo {\n    fun bar() { baz(); this.qux() }\n    fun sum(a: Int) = a + 1\n    val x = 2\n}\ninterface Bare\nobject Singleton {\n    fun run() { other() }\n}\n"
    assert found_in(spark, a__kt=kotlin) == {("Foo", "Class", 1, 5, 0), ("bar", "Method", 2, 2, 1), ("sum", "Method", 3, 3, 1), ("Bare", "Trait", 6, 6, 0), ("Singleton", "Class", 7, 9, 0), ("run", "Method", 8, 8, 1)}
    sharp = 'namespace MyApp\n{\n    class Foo\n    {\n        public void Bar()\n        {\n            Baz(); this.Qux("}");\n        }\n    }\n    interface IThing { void Do(); }\n}\n'
    assert found_in(spark, a__cs=sharp) >= {("MyApp", "Module", 1, 11, 0), ("Foo", "Class", 3, 9, 1), ("Bar", "Method", 5, 8, 2), ("IThing", "Trait", 10, 10, 1)}


SCOPES_PYTHON = """class A(
    B,
):
    '''Doc
not indented: def no():
    '''

    def run(
        self,
    ):
        x = '''
def neither():
'''
        # deeper
        def inner():
            pass
        return x

    # on two
    def two(self): return 2


def top():
    return [
1,
    ]
# the end
"""


def test_scopes_by_indentation(spark):
    for python in (SCOPES_PYTHON, SCOPES_PYTHON.replace("'''", '"""')):
        assert found_in(spark, m__py=python) == {("A", "Class", 1, 20, 0), ("run", "Method", 8, 17, 1), ("two", "Method", 20, 20, 1), ("top", "Function", 23, 26, 0)}
    ruby = "module M\n  class A\n    def self.go\n      run # end\n    end\n\n    def x; 1; end\n  end\nend\ndef top\nend\n"
    assert found_in(spark, m__rb=ruby) == {("M", "Module", 1, 9, 0), ("A", "Class", 2, 8, 1), ("go", "Method", 3, 5, 2), ("x", "Method", 7, 7, 2), ("top", "Function", 10, 11, 0)}


def test_scopes_of_broken_and_long_files(spark):
    broken = found_in(spark, a__rs='fn a() {\n  "open string {\n}\n', b__rs="}}}\nfn b() {}\n", c__rs="", d__rs="fn c(\n", e__py="def f(:\n  x\n", f__rs=None)
    assert broken == {("a", "Function", 1, 3, 0), ("b", "Function", 2, 2, 0), ("c", "Function", 1, 1, 0), ("f", "Function", 1, 2, 0)}
    long = "".join(f'fn f{i}() {{\n    g("{"x" * 50}");\n}}\n' for i in range(3000))
    rows = declarations.declarations(table(spark, a__rs=long)).select("start_line", "end_line").collect()
    assert sorted((r.start_line, r.end_line) for r in rows) == [(3 * i + 1, 3 * i + 3) for i in range(3000)]


def test_entities_are_not_in_comments_and_strings(spark):
    rust = 'use a::b; // use x::y Widget\n/* Gadget\n c::d */\nlet s: Real = "Fake in::side a long text";\n'
    found = {(r.entity_type, r.text, r.line) for r in declarations.entities(table(spark, a__rs=rust)).collect()}
    assert found == {("ModulePath", "a::b", 1), ("ExternalCrate", "a", 1), ("NamedType", "Real", 4), ("LiteralString", "Fake in::side a long text", 4)}


def test_entities_and_virtual_terms(spark):
    source = table(spark, a__rs=RUST)
    entity = declarations.entities(source)
    kinds = {(r.entity_type, r.text) for r in entity.collect()}
    assert {("ModulePath", "serde::Value"), ("ExternalCrate", "serde"), ("NamedType", "Reader"), ("ErrorVariant", "panic!"), ("LiteralString", "something bad here")} <= kinds
    found = declarations.virtual_terms(chunks.sliding(source, 3, 3), entity)
    assert "serde" in found.where("start_line = 1").first().virtual_terms


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.rs", 1), ("Cargo.lock", 1), ("x/app-1a2b3c4d.js", 1), ("x/app-main.js", 1), ("big.rs", 2_000_000), ("node_modules/a.js", 1), ("a.PNG", 1)], "p string, n long")
    kept = [r.p for r in rows.where(~files.skipped_path(F.col("p"), F.col("n")) & ~files.in_skipped_folder(F.col("p"))).collect()]
    assert kept == ["a/b.rs", "x/app-main.js"]
    assert files.configured_extensions(["Rust", "ts", "nothing"]) == ["rs", "ts", "tsx"]


def test_scan(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}", "src/target/b.rs": b"x", "README.md": b"# hi", "bad.py": b"\xff\xfe", "min.js": b"x" * 600, "c.bin": b"1"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    root = f"file://{tmp_path}/root"
    good, bad = files.scan(spark, [root, f"{root}/", root], exclude=["nothing*"])
    assert sorted(r.file for r in good.collect()) == ["README.md", "src/a.rs"] and [r.file for r in bad.collect()] == ["bad.py"]
    assert manifests.summary(good).first().summary == "README: # hi"
    nested, _ = files.scan(spark, [root, f"{root}/src"], extensions=["RS"])
    assert [r.file for r in nested.collect()] == ["a.rs"]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(length,1048576\)", plan)


def test_manifests_by_section(spark):
    rows = {
        "Cargo.toml": ('[workspace]\nname = "not this"\n[ package ] # here\nname = "crate \\"x\\""\nversion = "1"\n  description = \'It # does\'  # no\n[dependencies]\ndescription = "nor this"\n', 'Cargo: crate "x" — It # does'),
        "package.json": ('{"name": "pkg", "description": 5, "keywords": ["a", 1, "b", null], "scripts": {"name": "x"}}', "package.json: pkg — a, b"),
        "pyproject.toml": ('[tool.poetry]\nname = "old"\n[project]\ndescription = """new one"""\n[[tool.x]]\nname = "y"\n', "pyproject: new one"),
        "go.mod": ("// x\nmodule \n  module example.com/m  \ngo 1.2\n", "go.mod: example.com/m"),
        "lodestone.yaml": ('a: 1\n  description: "\'Words\'" \n', "settings: Words"),
        "CLAUDE.md": ("  notes \n", "CLAUDE.md: notes"),
        "AGENTS.md": ("more", "AGENTS.md: more"),
        "README.md": ("\n# T\n" + "é" * 3000, "README: # T\n" + "é" * 1996),
    }
    order = ["README.md", "CLAUDE.md", "AGENTS.md", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "lodestone.yaml"]
    files_ = [("all", k, v) for k, (v, _) in rows.items()] + [("each" + k, k, v) for k, (v, _) in rows.items()]
    files_ += [("poetry", "pyproject.toml", '[tool.poetry]\nname = "p"\ndescription="d"'), ("dotted", "pyproject.toml", 'project.name = "dots"\n'), ("bare", "pyproject.toml", '[project]\nversion="1"\n[tool.poetry]\nname="unseen"'), ("bad", "package.json", "{"), ("deep", "sub/README.md", "x"), ("none", "README.md", None), ("empty", "Cargo.toml", ""), ("blank", "README.md", " \n ")]
    got = {r.index_id: r for r in manifests.summary(spark.createDataFrame(files_, "index_id string, file string, content string")).collect()}
    assert {k: got["each" + k].summary for k in rows} == {k: v for k, (_, v) in rows.items()}
    whole = "\n\n".join(rows[k][1] for k in order)
    assert got["all"].summary == whole[:3000] and got["all"].display == whole[:500]
    assert got["poetry"].summary == "pyproject: p — d" and got["dotted"].summary == "pyproject: dots"
    assert {"bare", "bad", "deep", "none", "empty", "blank"}.isdisjoint(got)


def test_stream_updates_index(spark, tmp_path):
    index = LexicalIndex.build(spark.createDataFrame([], "index_id string, file string, chunk_id string, content string"), f"file://{tmp_path}/index", buckets=2)
    table = store.BucketTable.of_chunks(spark, f"file://{tmp_path}/chunks", buckets=2)
    found = lambda: {(r.file, r.content) for r in table.rows("x").collect()}
    words = lambda: {r.term: r.df for r in index.term_stats().collect()}

    def come(name, *rows):
        batch = spark.createDataFrame([(f"2024-01-01 00:00:{t}", f, op, c) for t, f, op, c in rows], "ts string, file string, op string, content string")
        batch.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema("ts timestamp, file string, op string, content string").parquet(f"{tmp_path}/in/*")
        done = changes.follow(stream, index, "x", chunks.sliding, f"{tmp_path}/at", table=table)
        done.awaitTermination(120)
        assert done.exception() is None
        return done

    # The burst of a.rs goes on in the second batch, so nothing is known of it before.
    come("0", ("00.7", "a.rs", "Modified", "one\n"), ("00.1", "b.rs", "Modified", "two\n"), ("00.9", "d.rs", "Modified", "five\n"), ("01.0", "a.rs", "Modified", "one half\n"))
    run()
    assert found() == {("b.rs", "two")} and words() == {"two": 1}
    come("1", ("01.3", "a.rs", "Modified", "three\n"), ("03.0", "unknown.rs", "Removed", None), ("05.0", "b.rs", "Modified", "two\n"))
    run()
    assert found() == {("a.rs", "three"), ("b.rs", "two"), ("d.rs", "five")} and words() == {"two": 1, "three": 1, "five": 1}
    before = index.segments()
    run()  # a restart without news
    assert index.segments() == before
    come("2", ("08.0", "b.rs", "Removed", None), ("08.1", "target/x.rs", "Modified", "skipped"), ("20.0", "z.rs", "Modified", "late"))
    done = run()
    assert found() == {("a.rs", "three"), ("d.rs", "five")} and words() == {"three": 1, "five": 1}
    # a.rs, d.rs and x.rs have a hash, z.rs an open burst; nothing is kept of b.rs and unknown.rs.
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] == 4


def test_changes_without_effect_go(spark, tmp_path):
    rows = [("a", "Modified", "x", 1), ("a", "Modified", "x", 2), ("a", "Modified", "y", 3), ("b", "Removed", None, 4), ("a", "Removed", None, 5), ("a", "Modified", "y", 6), ("c", "Modified", None, 7), ("e", "Modified", "end", 99)]
    events = spark.createDataFrame(rows, "file string, op string, content string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = []
    changes.known_changes(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    assert [(r.file, r.op, r.content) for r in sorted(got, key=lambda r: r.last_ts)] == [("a", "Modified", "x"), ("a", "Modified", "y"), ("a", "Removed", None), ("a", "Modified", "y")]


def test_concepts(spark):
    vocabulary = spark.createDataFrame([("east", 0, [1.0, 0.0]), ("north", 1, [0.0, 1.0])], "word string, at int, embedding array<double>")
    near = [[1.0, 0.1], [1.0, 0.0], [0.0, 1.0], [0.1, 1.0]]
    rows = [("f", str(i), v) for i, v in enumerate(near)] + [("g", str(i), v) for i, v in enumerate(near[:2] * 3)] + [("h", str(i), v) for i, v in enumerate(near[:3])] + [("h", "9", None), (None, "1", near[0])]
    found = concepts.clusters(spark.createDataFrame(rows, "file string, chunk_id string, embedding array<double>"), vocabulary)
    assert {(r.file, r.text, r.entity_id, r.entity_type) for r in found.collect()} == {(f, t, f"{f}:cluster:{t}", "ConceptCluster") for f, t in (("f", "east"), ("f", "north"), ("g", "east"))}


def test_grouped_kmeans_is_lloyds(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {g: np.concatenate([rng.normal(c, 0.3, (n, 3)) for c in (0, 4, 9)]) for g, n in (("a", 9), ("b", 20), ("c", 1))}
    rows = [(g, i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    found = concepts.grouped_kmeans(spark.createDataFrame(rows, "file string, chunk_id int, embedding array<double>"), "file").collect()
    for g, vs in groups.items():
        centres = vs[: max(1, min(20, len(vs) // 2))].copy()
        for _ in range(50):
            near = ((vs[:, None] - centres[None]) ** 2).sum(axis=2).round(12).argmin(axis=1)
            now = np.array([vs[near == c].mean(axis=0) if (near == c).any() else np.full(3, np.inf) for c in range(len(centres))])
            done = np.nanmax(np.abs(np.where(np.isinf(now), 0, now - centres))) < 1e-9
            centres = now
            if done:
                break
        got = {r.chunk_id: r for r in found if r.file == g}
        assert [got[i].cluster for i in range(len(vs))] == near.tolist()
        assert all(np.allclose(got[i].centre, centres[near[i]]) for i in range(len(vs)))


def test_settings_of_indexes(spark, tmp_path):
    pytest.importorskip("yaml")
    text = 'version: 1\nindexes:\n  - name: api\n    paths: ["src/", "."]\n    exclude: [gen/, "**/*_test.py"]\n    languages: [python, Rust]\n    domain_terms: ["rate plan"]\n  - name: all\n'
    for name, data in {"src/a.py": "x", "src/a_test.py": "x", "gen/b.py": "x", "ui/c.ts": "x", "d.rs": "x", "lodestone.yaml": text}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    api, every = settings.load(str(tmp_path))
    assert api.roots("/r/") == ["/r/src", "/r"] and every.roots("/r") == ["/r"] and {"py", "rs"} <= set(api.extensions()) and "ts" not in api.extensions() and api.domain_terms == ("rate plan",)
    good, _ = api.scan(spark, f"file://{tmp_path}")
    assert {(r.index_id, r.file) for r in good.collect()} == {("api", "a.py"), ("api", "d.rs")}
    assert {r.file for r in every.scan(spark, f"file://{tmp_path}")[0].collect()} >= {"src/a.py", "ui/c.ts", "d.rs", "gen/b.py"}
    assert settings.load(f"{tmp_path}/src") is None and settings.parse('{"indexes": [{"name": "j"}]}') == [settings.IndexSettings("j")]
    for bad in ("indexes: 1", "indexes:\n  - paths: [a]", "indexes:\n  - name: x\n    paths: a", "a: [", "- x"):
        with pytest.raises(ValueError):
            settings.parse(bad)


def test_filter_sets():
    assert settings.filter_set(" Symbol, ,FILE ") == {"symbol", "file"} and settings.filter_set(" , ") is None and settings.filter_set(None) is None
