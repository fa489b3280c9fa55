"""Column functions over code and prose: tokens, lines, paths, snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
_CAMEL = r"(?<=[\p{IsLowercase}0-9])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
_DIGITS = r"(?<=\p{IsAlphabetic})(?=[0-9])|(?<=[0-9])(?=\p{IsAlphabetic})"
#: What every word with a border of either kind holds.
_BORDER = r"[0-9]|.\p{IsUppercase}"


def camel_parts(word: Column) -> Column:
    """`parseHTTPRequest` as parse, HTTP, Request."""
    return F.split(word, _CAMEL)


def digit_parts(word: Column) -> Column:
    """`utf8mb4` as utf, 8, mb, 4."""
    return F.split(word, _DIGITS)


def code_tokens(text: Column) -> Column:
    """Distinct sorted lower-case tokens: words, their camel-case parts and their letter and digit runs.

    The text is parted into words once; only the distinct words that may hold a border are looked through for more.
    """
    words = F.array_distinct(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _NOT_ALNUM, " "), " "))

    def parts(distinct: Column) -> Column:
        inner = F.array_join(F.filter(distinct, lambda w: w.rlike(_BORDER)), " ")
        every = F.concat_ws(" ", F.array_join(distinct, " "), F.regexp_replace(inner, _CAMEL, " "), F.regexp_replace(inner, _DIGITS, " "))
        return F.split(F.lower(every), " ")

    # A function over an array of one element binds the words, which would be computed at each use otherwise.
    every = F.element_at(F.transform(F.array(words), parts), 1)
    return F.array_sort(F.array_remove(F.array_distinct(every), ""))


def lines(content: Column) -> Column:
    """Lines without their ends; no empty last line, and none at all for empty content."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def snippet(content: Column, most: int = 7) -> Column:
    """The content if it has at most `most` lines, else its first ones."""
    rows = lines(content)
    return F.when(F.size(rows) <= most, content).otherwise(F.array_join(F.slice(rows, 1, most), "\n"))


def fingerprint(content: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(content, 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-|-\z", "")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def token_estimate(path: Column, content: Column, compact: Column | None = None) -> Column:
    """A rough count of a result's tokens: a quarter of its bytes, with 80 for its frame; at most 560 for content that is not compacted."""
    body = F.least(F.octet_length(content), F.lit(560))
    body = body if compact is None else F.coalesce(F.octet_length(compact), body)
    return F.floor((body + F.octet_length(path) + 80) / 4).cast("long")


def doc_demotion(path: Column, factor: float = 0.5) -> Column:
    """`factor` for documentation and configuration files, else 1."""
    return F.when(F.lower(path).rlike(r"\.(md|txt|toml|ya?ml|json)\z"), factor).otherwise(1.0)


def match_reason(vector: Column, lexical: Column, graph: Column) -> Column:
    """Which lanes a result came from."""
    return (
        F.when(vector & lexical, "hybrid").when(vector, "vector").when(lexical, "bm25").when(graph, "hybrid+kg").otherwise("fallback")
    )


def node_kind(symbol: Column) -> Column:
    """File for symbols that look like paths with an extension, else Symbol."""
    return F.when(symbol.contains("/") & symbol.rlike(r"\.[^./]+\z"), "File").otherwise("Symbol")


def doc_comment(content: Column) -> Column:
    """The text of `///` and `//!` lines, joined by spaces."""
    marked = F.filter(F.transform(lines(content), lambda x: F.trim(x)), lambda x: x.rlike(r"^//[/!]"))
    return F.trim(F.array_join(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^//[/!]", ""))), " "))


def backtick_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))))


def keywords(text: Column) -> Column:
    """Distinct sorted words of three or more characters that are all capitals and digits, or capitalised."""
    words = F.split(text, _NOT_ALNUM)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & (w.rlike(r"^[\p{IsUppercase}0-9]+\z") | w.rlike(r"^\p{IsUppercase}[\p{IsLowercase}0-9]+\z")))))


def glob_pattern(glob: str) -> str:
    """A path glob as a Java regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", r"\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            out, i = out + ("\\" if not glob[i].isalnum() and glob[i] not in "_/-" else "") + glob[i], i + 1
    return f"^{out}\\z"


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether a glob matches the path, its last part, or either below any folder."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g)) | basename(path).rlike(glob_pattern(g)) | path.rlike(glob_pattern(f"**/{g}")) | path.rlike(glob_pattern(f"**/{g}/**"))
    return hit


def first_part_matches(path: Column, root: str, globs: Sequence[str]) -> Column:
    """Whether the first part of the path below `root` matches a glob; without globs everything does."""
    if not globs:
        return F.lit(True)
    base = root.rstrip("/") + "/"
    part = F.element_at(F.split(F.substr(path, F.lit(len(base) + 1)), "/"), 1)
    hit = F.lit(False)
    for g in globs:
        hit = hit | part.rlike(glob_pattern(g))
    return path.startswith(base) & hit
