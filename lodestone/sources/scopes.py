"""Where declarations begin and end: comments and strings are blanked, then one fold over a file's lines keeps a stack of scopes.

`masked` parts a text at the comments and strings of its language and puts blanks in their place, line by line, so that nothing in
them counts as code. `spans` folds the lines of a file with a state of depth, open parentheses, open scopes and a declaration
that waits for its body. In languages with braces a scope ends with the brace that closes it; a declaration without a body ends at
its semicolon, or before the next one. In languages with indentation it ends before the next line that is indented no deeper, where
lines in parentheses and the inside of strings don't count. Functions are not looked into.

One declaration a line is found. All of it is Spark's functions; the work is the number of lines times the depth of nesting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE, _BLOCK, _HASH = r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)", r"#[^\n]*+"
_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+(?:"|(?=\n)|\z)', r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+(?:'|(?=\n)|\z)"
_WIDE = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)'
_CHAR = r"'(?:\\[^\n']{1,10}|\\'|[^'\\\n])'"
_TRIPLE = r'"{3}(?s:.*?)(?:"{3}|\z)'
#: What is no code, by language; the first that fits at a place is taken.
NO_CODE = {
    "rust": (_LINE, _BLOCK, r'\bb?r(#*)"(?s:.*?)"\1', _WIDE, _CHAR),
    "python": (_HASH, _TRIPLE, r"'{3}(?s:.*?)(?:'{3}|\z)", _DOUBLE, _SINGLE),
    "ruby": (_HASH, _WIDE, _SINGLE),
    "php": (_LINE, _BLOCK, r"#(?!\[)[^\n]*+", _WIDE, _SINGLE),
    "javascript": (_LINE, _BLOCK, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(?:`|\z)", _DOUBLE, _SINGLE),
    "go": (_LINE, _BLOCK, r"`[^`]*+(?:`|\z)", _DOUBLE, _CHAR),
    "csharp": (_LINE, _BLOCK, r'@"(?:[^"]|"")*+"', _DOUBLE, _CHAR),
    "java": (_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR),
}
NO_CODE |= {"typescript": NO_CODE["javascript"], "kotlin": NO_CODE["java"], "scala": NO_CODE["java"], "swift": NO_CODE["java"], "c": NO_CODE["java"], "cpp": NO_CODE["java"]}
INDENTED = ("python", "ruby")
#: Languages that end a declaration with an expression instead of a body.
_EXPRESSIONS = ("scala", "kotlin", "csharp")
#: Stands at the start of lines that are inside of a string.
INSIDE = "\u0001"

_SCOPE = "struct<kind:string,name:string,at:int,depth:int,indent:int>"
_DONE = "struct<at:int,end:int,kind:string,name:string,owner:string,owned:boolean,level:int>"
_STATE = f"struct<depth:int,paren:int,last:int,open:array<{_SCOPE}>,wait:{_SCOPE},done:array<{_DONE}>>"


def masked(tongue: Column, content: Column) -> Column:
    """The content with as many lines, where comments are gone and strings are a pair of quotes."""

    def blanked(piece: Column) -> Column:
        lines = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        comment = piece.startswith("//") | piece.startswith("/*") | piece.startswith("#")
        return F.when(comment, F.repeat(F.lit("\n"), lines)).otherwise(F.concat(F.lit('"'), F.repeat(F.lit(f"\n{INSIDE}"), lines), F.lit('"')))

    def of(pattern: str) -> Column:
        code, pieces = F.split(content, pattern, -1), F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), blanked)
        return F.array_join(F.zip_with(code, pieces, lambda c, p: F.concat(F.coalesce(c, F.lit("")), F.coalesce(p, F.lit("")))), "")

    out = F
    for name, parts in NO_CODE.items():
        out = out.when(tongue == name, of("|".join(parts)))
    return out.otherwise(content)


def facts(line: Column) -> dict[str, Column]:
    """What the fold needs of a masked line."""

    def count(of: str) -> Column:
        return F.regexp_count(line, F.lit(of)).cast("int")

    head = F.regexp_extract(line, r"^([^{]*)", 1)
    return {
        "opens": count(r"\{"), "closes": count(r"\}"), "lead": F.regexp_count(head, F.lit(r"\}")).cast("int"), "parens": (count(r"[(\[]") - count(r"[)\]]")).cast("int"),
        "semi": line.contains(";"), "blank": F.trim(line).isin("") | line.rlike(r"^\s*\z"), "inside": line.startswith(INSIDE), "indent": F.length(F.regexp_extract(line, r"^\s*", 0)),
        "ends": line.rlike(r"^\s*end\b"), "expression": line.rlike(r"[)\w>\]]\s*(?::[^={]+)?=>?\s*[^\s={][^{]*\z"),
    }


def _let(value: Column, f) -> Column:
    """`f` of a value that is worked out once, however often `f` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(tongue: Column, rows: Column, types: tuple[str, ...]) -> Column:
    """array(struct(at, end, kind, name, owner, owned, level)) of the declarations of a file, from its lines in order.

    `rows` are structs of at (1-based), kind and name (null where nothing is declared), and the `facts` of the line. `owner` is the
    innermost open scope of one of the kinds `types`, `level` the number of open scopes around.
    """
    functions = ("Function", "Method")
    none = F.lit(None).cast(_SCOPE)

    def done(scope: Column, end: Column, around: Column) -> Column:
        owners = F.filter(around, lambda o: o["kind"].isin(*types))
        return F.struct(
            scope["at"].alias("at"), F.greatest(end, scope["at"]).cast("int").alias("end"), scope["kind"].alias("kind"), scope["name"].alias("name"),
            F.get(owners, F.size(owners) - 1)["name"].alias("owner"), (F.size(owners) > 0).alias("owned"), F.size(around).cast("int").alias("level"),
        ).cast(_DONE)

    def closed(open_: Column, gone: Column, end) -> Column:
        """The scopes of the stack for which `gone` holds, each with those below it around."""
        return F.filter(F.transform(open_, lambda o, i: F.when(gone(o), done(o, end(o), F.slice(open_, 1, i)))), lambda x: x.isNotNull())

    nothing = F.array().cast(f"array<{_DONE}>")

    def step(s: Column, x: Column) -> Column:
        by_indent, bare = tongue.isin(*INDENTED), ~x["blank"]
        # How deep the line ends, how deep it comes in between, and whether it can end scopes by its indentation.
        after = s["depth"] + x["opens"] - x["closes"]
        levels = F.struct(after.cast("int").alias("after"), F.least(s["depth"] - x["lead"], after).cast("int").alias("low"), (bare & ~x["inside"] & (s["paren"] <= 0)).alias("ended"))

        def leave(v: Column) -> Column:
            """The scopes that go on, and those that end."""

            def gone(o: Column) -> Column:
                return F.when(by_indent, v["ended"] & (x["indent"] <= o["indent"])).otherwise(o["depth"] >= v["low"])

            def end(o: Column) -> Column:
                return F.when(by_indent, F.when(x["ends"] & (x["indent"] == o["indent"]), x["at"]).otherwise(s["last"])).otherwise(x["at"])

            return F.struct(v.alias("v"), F.filter(s["open"], lambda o: ~gone(o)).alias("open"), F.concat(s["done"], closed(s["open"], gone, end)).alias("done"))

        def declare(w: Column) -> Column:
            """What the line declares; nothing within functions."""
            head = x["kind"].isNotNull() & ~x["inside"] & (~by_indent | w["v"]["ended"]) & ~F.exists(w["open"], lambda o: o["kind"].isin(*functions))
            new = F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["at"].alias("at"), w["v"]["low"].alias("depth"), x["indent"].alias("indent")).cast(_SCOPE)
            return F.struct(w.alias("w"), F.when(head, new).alias("new"))

        def settle(n: Column) -> Column:
            """A declaration that still waits for its body has none if another one begins or its surroundings end."""
            stopped = s["wait"].isNotNull() & (n["new"].isNotNull() | (n["w"]["v"]["low"] < s["wait"]["depth"]))
            out = F.concat(n["w"]["done"], F.when(stopped, F.array(done(s["wait"], s["last"], n["w"]["open"]))).otherwise(nothing))
            return F.struct(n["w"].alias("w"), F.coalesce(n["new"], F.when(~stopped, s["wait"])).alias("scope"), out.alias("done"))

        def finished(t: Column) -> Column:
            opened = by_indent | ((x["opens"] > 0) & (t["w"]["v"]["after"] > t["scope"]["depth"]))
            flat = s["paren"] + x["parens"] <= 0
            whole = ~by_indent & ((x["opens"] > 0) | (x["semi"] & flat) | (tongue.isin(*_EXPRESSIONS) & x["expression"] & flat))
            now = F.when(t["scope"].isNull(), "none").when(opened, "push").when(whole, "done").otherwise("wait")
            return F.struct(t.alias("t"), now.alias("now"))

        def result(r: Column) -> Column:
            t, open_ = r["t"], r["t"]["w"]["open"]
            return F.struct(
                t["w"]["v"]["after"].alias("depth"), F.greatest(s["paren"] + x["parens"], F.lit(0)).cast("int").alias("paren"), F.when(bare, x["at"]).otherwise(s["last"]).alias("last"),
                F.when(r["now"] == "push", F.concat(open_, F.array(t["scope"]))).otherwise(open_).alias("open"), F.when(r["now"] == "wait", t["scope"]).alias("wait"),
                F.concat(t["done"], F.when(r["now"] == "done", F.array(done(t["scope"], x["at"], open_))).otherwise(nothing)).alias("done"),
            ).cast(_STATE)

        bound = levels
        for f in (leave, declare, settle, finished, result):
            bound = _let(bound, f)
        return bound

    first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("paren"), F.lit(0).alias("last"), F.array().cast(f"array<{_SCOPE}>").alias("open"), none.alias("wait"), F.array().cast(f"array<{_DONE}>").alias("done")).cast(_STATE)

    def finish(s: Column) -> Column:
        rest = closed(s["open"], lambda o: F.lit(True), lambda o: s["last"])
        return F.concat(s["done"], rest, F.when(s["wait"].isNotNull(), F.array(done(s["wait"], s["last"], s["open"]))).otherwise(nothing))

    return F.aggregate(rows, first, step, finish)
