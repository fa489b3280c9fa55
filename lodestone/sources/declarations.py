"""Declaration chunks and entities by patterns over lines of code.

No grammars are used: a table of patterns finds the lines that declare something, and `scopes` finds where each ends and what
it is in. Names, calls, bases and entities are extracted by patterns, from code without its comments and strings. That is an
approximation of a parse, which stays inside Spark's functions; a parser can take its place by writing the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import backtick_refs, doc_comment, keywords, lines
from lodestone.operators.intervals import points_in_ranges
from lodestone.sources import scopes
from lodestone.sources.chunks import _finished, _or_whole
from lodestone.sources.files import language

_MODIFIERS = r"(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|static|final|abstract|async|unsafe|const|override|virtual|open|sealed|data|inline|extern|case|implicit|partial|readonly|suspend|fileprivate|mutating)\s+)*"
#: Per language: the type of chunk and the pattern of the line that declares it, with its name.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "rust": (("Function", r"fn\s+(\w+)"), ("Class", r"struct\s+(\w+)"), ("Trait", r"trait\s+(\w+)"), ("Enum", r"enum\s+(\w+)"), ("Module", r"mod\s+(\w+)\s*\{"), ("Impl", r"impl(?:<[^>]*>)?\s+(?:[\w:<>, '&]+\s+for\s+)?(\w+)")),
    "python": (("Function", r"def\s+(\w+)"), ("Class", r"class\s+(\w+)")),
    "javascript": (("Function", r"function\s*\*?\s+(\w+)"), ("Class", r"class\s+(\w+)"), ("Method", r"(?!if|for|while|switch|catch|return|function|else|do|try)(?:get\s+|set\s+)?(\w+)\s*\([^)]*\)\s*\{")),
    "go": (("Method", r"func\s+\([^)]*\)\s*(\w+)"), ("Function", r"func\s+(\w+)"), ("Class", r"type\s+(\w+)")),
    "java": (("Class", r"class\s+(\w+)"), ("Trait", r"interface\s+(\w+)"), ("Enum", r"enum\s+(\w+)"), ("Method", r"(?!return|new|else|throw)[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*\)\s*(?:throws[\w, ]+)?\{")),
    "c": (("Class", r"struct\s+(\w+)\s*\{"), ("Function", r"(?!return|else|typedef)[A-Za-z_][\w \t*]*[ *](\w+)\s*\([^;]*\)\s*\{")),
    "ruby": (("Method", r"def\s+self\.(\w+)"), ("Function", r"def\s+(\w+)"), ("Class", r"class\s+(\w+)"), ("Module", r"module\s+(\w+)")),
    "php": (("Function", r"function\s+(\w+)"), ("Class", r"class\s+(\w+)"), ("Trait", r"(?:interface|trait)\s+(\w+)"), ("Module", r"namespace\s+([\w\\]+)")),
    "scala": (("Function", r"def\s+(\w+)"), ("Class", r"(?:class|object)\s+(\w+)"), ("Trait", r"trait\s+(\w+)")),
    "csharp": (("Class", r"(?:class|struct|record)\s+(\w+)"), ("Trait", r"interface\s+(\w+)"), ("Enum", r"enum\s+(\w+)"), ("Module", r"namespace\s+([\w.]+)"), ("Method", r"(?!return|new|else|throw)[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*\)\s*(?:\{|\z)")),
    "kotlin": (("Function", r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("Class", r"(?:class|object)\s+(\w+)"), ("Trait", r"interface\s+(\w+)")),
    "swift": (("Function", r"func\s+(\w+)"), ("Class", r"(?:class|struct|extension)\s+(\w+)"), ("Enum", r"enum\s+(\w+)"), ("Trait", r"protocol\s+(\w+)"), ("Method", r"(init)\s*[?(]")),
}
PATTERNS["typescript"] = (*PATTERNS["javascript"], ("Trait", r"interface\s+(\w+)"))
PATTERNS["cpp"] = (("Class", r"class\s+(\w+)"), *PATTERNS["c"])
CONTAINERS = ("Class", "Trait", "Impl", "Module", "Enum")
#: Containers whose functions are methods.
_TYPES = ("Class", "Trait", "Impl")
#: Languages whose methods are named with their type.
QUALIFIED = ("rust", "scala", "php")


def _declared(tongue: Column, line: Column) -> Column:
    """struct(kind, name) of a line that declares something, else null."""
    out = F
    for name, patterns in PATTERNS.items():
        for kind, pattern in patterns:
            full = rf"^\s*{_MODIFIERS}{pattern}"
            out = out.when((tongue == name) & line.rlike(full), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, full, 1).alias("name")))
    return out.otherwise(F.lit(None).cast("struct<kind:string,name:string>"))


def _leads(tongue: Column, line: Column) -> Column:
    """Whether a line can belong to the declaration below it: a comment, an attribute, an annotation or a decorator."""
    return F.when(tongue.isin("python", "ruby"), line.rlike(r"^\s*[#@]")).otherwise(line.rlike(r"^\s*(?://|/\*|\*(?:\s|/|\z)|@\w|#!?\[|\[\w)"))


def _after_bare(at: Column) -> Column:
    """The line after the last one above `at` that doesn't lead; `bare` holds the numbers of all such lines."""
    return F.coalesce(F.array_max(F.filter("bare", lambda b: b < at)), F.lit(0)) + 1


def declarations(files: DataFrame) -> DataFrame:
    """Chunks of the declarations of each file, with language, calls, bases and doc keywords; a file without any is one chunk.

    Comments and attributes right above a declaration belong to it: the one before ends above them, and doc keywords are
    taken from them.
    """
    tongue = F.col("language")
    rows = files.select("file", language(F.col("file")).alias("language"), "content").where("content is not null")
    rows = rows.select("file", "language", lines(F.col("content")).alias("rows"), lines(scopes.masked(tongue, F.col("content"))).alias("code"))
    line = rows.select("file", "language", F.posexplode("code").alias("at", "line")).withColumn("at", F.col("at") + 1)
    # What is known of each line is worked out in a projection; the fold over a file's lines only compares numbers.
    known = line.select("file", "language", F.struct("at", _declared(tongue, F.col("line")).alias("d"), *[c.alias(n) for n, c in scopes.facts(F.col("line")).items()]).alias("x"))
    known = known.select("file", "language", F.struct("x.at", "x.d.kind", "x.d.name", *[f"x.{n}" for n in scopes.facts(F.lit(""))]).alias("x"))
    folded = known.groupBy("file", "language").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    folded = folded.select("file", F.explode(scopes.spans(tongue, F.col("xs"), _TYPES)).alias("d")).select("file", "d.*")
    bare = F.filter(F.transform("rows", lambda x, i: F.when(~_leads(tongue, x), i + 1)), lambda i: i.isNotNull())
    joined = folded.join(rows.select("file", "language", "rows", "code", bare.alias("bare")), "file").withColumn("end", F.least("end", F.size("rows")))
    top = _after_bare(F.col("at"))
    joined = joined.withColumn("doc", doc_comment(F.array_join(F.slice("rows", top, F.col("at") - top), "\n")))
    kind = F.when((F.col("kind") == "Function") & F.col("owned"), "Method").otherwise(F.col("kind"))
    name = F.when((kind == "Method") & tongue.isin(*QUALIFIED) & F.col("owned"), F.concat_ws("::", "owner", "name")).otherwise(F.col("name"))
    size = F.col("end") - F.col("at") + 1
    body, code = (F.array_join(F.slice(c, F.col("at"), size), "\n") for c in ("rows", "code"))
    found = joined.select("file", F.col("at").alias("start_line"), F.col("end").alias("end_line"), body.alias("content"), name.alias("function_name"), kind.alias("chunk_type"), "doc", code.alias("code"), F.col("level").alias("chunk_depth"))
    done = _or_whole(_finished(found, "doc", "code", "chunk_depth"), files)
    doc = F.coalesce("doc", F.lit(""))
    plain = F.coalesce("code", scopes.masked(language(F.col("file")), F.col("content")))
    return done.withColumns({"language": language(F.col("file")), "calls": calls(plain, F.col("function_name")), "inherits_from": bases(language(F.col("file")), plain), "nlp_keywords": keywords(doc), "nlp_code_refs": backtick_refs(doc), "chunk_depth": F.coalesce("chunk_depth", F.lit(0))}).drop("doc", "code")


def calls(content: Column, own: Column) -> Column:
    """Distinct sorted names that are called, without qualifiers, keywords and the declaration itself."""
    words = F.regexp_extract_all(content, F.lit(r"(?<!\bfn |\bdef |\bfunc |\bfun |\bfunction )\b([A-Za-z_]\w*)!?\s*\("), F.lit(1))
    no = F.array(*map(F.lit, "if for while switch match return catch fn def func fun function sizeof elif and or not in else".split()))
    return F.array_sort(F.filter(F.array_distinct(words), lambda w: ~F.array_contains(no, w) & ~w.eqNullSafe(F.element_at(F.split(own, "::"), -1))))


def bases(tongue: Column, content: Column) -> Column:
    """Traits and classes that a declaration names as its bases, where the language is known to have them."""
    first = F.element_at(F.split(content, "\n"), 1)
    text = (
        F.when(tongue == "rust", F.regexp_extract(first, r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s", 1))
        .when(tongue == "python", F.regexp_extract(first, r"class\s+\w+\s*\(([^)]*)\)", 1))
        .when(tongue == "scala", F.regexp_replace(F.regexp_extract(first, r"\bextends\s+([^{]*)", 1), r"\bwith\b", ","))
        .when(tongue == "php", F.regexp_replace(F.regexp_extract(first, r"\b(?:extends|implements)\s+([^{]*)", 1), r"\bimplements\b", ","))
        .otherwise("")
    )
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(x, r"\(.*", ""))), lambda x: x != "")


#: Entities by pattern: type, languages (none: all), pattern with the text as its group.
ENTITIES = (
    ("ModulePath", ("rust",), r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    ("NamedType", (), r"\b([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*)\b"),
    ("ModulePath", ("rust", "cpp"), r"\b(\w+(?:::\w+)+)\b"),
    ("ModulePath", ("python", "java", "go", "javascript", "typescript"), r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b"),
    ("TraitBound", ("rust",), r"<\s*\w+\s*:\s*(\w+)"),
    ("ErrorVariant", ("rust",), r"\b((?:bail|anyhow|panic)!|(?<=\.)(?:unwrap|expect)(?=\())"),
    ("Annotation", ("rust",), r"^\s*#!?\[([^\]]+)\]"),
    ("LiteralString", ("rust",), r'"([^"\n]{11,})"'),
    ("TypeAlias", ("rust",), r"^\s*(?:pub\s+)?type\s+(\w+)\s*="),
)
_BUILT_IN_CRATES = ("crate", "super", "self", "std", "core", "alloc")
_WITH_ENTITIES = ("rust", "python", "javascript", "typescript", "go", "java", "c", "cpp")


def entities(files: DataFrame) -> DataFrame:
    """(entity_id, entity_type, text, file, line) of each distinct entity of a line; only literals are sought in strings and comments."""
    rows = files.select("file", language(F.col("file")).alias("language"), "content").where(F.col("language").isin(*_WITH_ENTITIES))
    plain, code = (rows.select("file", "language", F.posexplode(lines(text)).alias("at", "line")) for text in (F.col("content"), scopes.masked(F.col("language"), F.col("content"))))
    found = None
    for kind, tongues, pattern in ENTITIES:
        rows = plain if kind == "LiteralString" else code
        own = rows.where(F.col("language").isin(*tongues)) if tongues else rows
        part = own.select(F.lit(kind).alias("entity_type"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))).alias("text"), "file", (F.col("at") + 1).alias("line"))
        found = part if found is None else found.unionByName(part)
    crates = found.where("entity_type = 'ModulePath' and contains(text, '::')").withColumn("text", F.element_at(F.split("text", "::"), 1))
    crates = crates.where(~F.col("text").isin(*_BUILT_IN_CRATES)).withColumn("entity_type", F.lit("ExternalCrate")).distinct()
    every = found.unionByName(crates).distinct()
    return every.select(F.concat_ws(":", "file", "line", "entity_type", "text").alias("entity_id"), "*")


def virtual_terms(chunks: DataFrame, entity: DataFrame) -> DataFrame:
    """`chunks` with the distinct names of the entities inside their lines, by line and name."""
    inside = points_in_ranges(entity.select("file", "line", "text"), chunks.select("chunk_id", "file", "start_line", "end_line"), "file")
    named = inside.groupBy("chunk_id", "text").agg(F.min("line").alias("line")).groupBy("chunk_id")
    terms = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text).alias("virtual_terms"))
    return chunks.join(terms, "chunk_id", "left").withColumn("virtual_terms", F.coalesce("virtual_terms", F.array().cast("array<string>")))
