"""What a project's own files say about it: README, agent notes, manifests and settings, as one summary for each index.

Manifests are read by section in Spark's functions: a TOML file's lines are folded into (path, value) pairs, where the path has the
section and the key; JSON is parsed as a variant, so that only strings count as such. What can't be read says nothing.
Values of TOML that go over several lines, and arrays, are not taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines

# How much of a README, of a summary and of one for display is kept, what parts name and description, and the labels.
README_CHARS, SUMMARY_CHARS, DISPLAY_CHARS = 2000, 3000, 500
DASH = " — "
LABELS = ("README", "CLAUDE.md", "AGENTS.md", "Cargo", "package.json", "pyproject", "go.mod", "settings")
#: Files with settings of an index, which may describe it.
SETTINGS = (".lodestone.yaml", "lodestone.yaml")

_HEADER = r"^\s*\[\s*([^\[\]]+?)\s*\]\s*(?:#.*)?\z"
_OTHER_HEADER = r"^\s*\[\[.*"
_PAIR = r"""^\s*("?[\w.\- ]+?"?)\s*=\s*(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|"((?:[^"\\]|\\.)*)"|'([^']*)')\s*(?:#.*)?\z"""


def toml_values(content: Column) -> Column:
    """array(struct(path, value)) of the strings of a TOML file, with a path that ends in a dot and no value for each section."""
    kind = "array<struct<path:string,value:string>>"
    state = F.struct(F.lit("").alias("section"), F.array().cast(kind).alias("found"))

    def entry(path: Column, value: Column) -> Column:
        return F.array(F.struct(path.alias("path"), value.alias("value"))).cast(kind)

    def plain(key: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(key, '"', ""), r"\s*\.\s*", ".")

    def step(acc: Column, line: Column) -> Column:
        section = plain(F.regexp_extract(line, _HEADER, 1))
        raw = F.array_join(F.array(*[F.regexp_extract(line, _PAIR, i) for i in (2, 3, 4, 5)]), "")
        value = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        path = F.concat(acc["section"], F.when(acc["section"] == "", "").otherwise("."), plain(F.regexp_extract(line, _PAIR, 1)))
        return (
            F.when(line.rlike(_OTHER_HEADER), F.struct(F.lit("[]").alias("section"), acc["found"].alias("found")))
            .when(line.rlike(_HEADER), F.struct(section.alias("section"), F.concat(acc["found"], entry(F.concat(section, F.lit(".")), F.lit(None).cast("string"))).alias("found")))
            .when(line.rlike(_PAIR), F.struct(acc["section"].alias("section"), F.concat(acc["found"], entry(path, value)).alias("found")))
            .otherwise(acc)
        )

    return F.aggregate(lines(content), state, step)["found"]


def _at(values: Column, path: str) -> Column:
    return F.get(F.filter(values, lambda x: x["path"] == path), F.lit(0))["value"]


def _has(values: Column, section: str) -> Column:
    return F.exists(values, lambda x: x["path"].startswith(f"{section}."))


def _joined(*parts: Column) -> Column:
    """What there is of the parts, trimmed; null if nothing."""
    kept = F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, DASH))


def cargo(content: Column) -> Column:
    values = toml_values(content)
    return _joined(_at(values, "package.name"), _at(values, "package.description"))


def pyproject(content: Column) -> Column:
    """By the standard's own section if there is one, else by the packaging tool's."""
    values = toml_values(content)
    return F.when(_has(values, "project"), _joined(_at(values, "project.name"), _at(values, "project.description"))).otherwise(
        _joined(_at(values, "tool.poetry.name"), _at(values, "tool.poetry.description"))
    )


def package_json(content: Column) -> Column:
    parsed = F.try_parse_json(content)

    def string(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    words = F.filter(F.transform(F.try_variant_get(parsed, "$.keywords", "array<variant>"), string), lambda x: x.isNotNull())
    return _joined(*[string(F.try_variant_get(parsed, f"$.{k}", "variant")) for k in ("name", "description")], F.array_join(words, ", "))


def _first(content: Column, start: str) -> Column:
    """What follows `start` in the first line that begins with it and says something."""
    rows = F.transform(F.filter(F.transform(lines(content), lambda x: F.trim(x)), lambda x: x.startswith(start)), lambda x: F.trim(F.substr(x, F.lit(len(start) + 1))))
    return F.get(F.filter(rows, lambda x: x != ""), F.lit(0))


def go_mod(content: Column) -> Column:
    return _first(content, "module ")


def settings_description(content: Column) -> Column:
    rows = F.transform(lines(content), lambda x: F.trim(x))
    said = F.transform(F.filter(rows, lambda x: x.startswith("description:")), lambda x: F.trim(F.regexp_replace(F.trim(F.substr(x, F.lit(13))), r"""^["']+|["']+\z""", "")))
    return F.get(F.filter(said, lambda x: x != ""), F.lit(0))


def summary(files: DataFrame, *, settings: Sequence[str] = SETTINGS, most: int = SUMMARY_CHARS) -> DataFrame:
    """(index_id, summary, display) of the indexes of `files` (index_id, file, content) that have such files at their root, each part with its label."""
    content, name = F.col("content"), F.col("file")
    text = F.trim(F.regexp_replace(content, r"^\s+|\s+\z", ""))
    parts = [
        (name == "README.md", F.substring(text, 1, README_CHARS)), (name == "CLAUDE.md", text), (name == "AGENTS.md", text), (name == "Cargo.toml", cargo(content)),
        (name == "package.json", package_json(content)), (name == "pyproject.toml", pyproject(content)), (name == "go.mod", go_mod(content)),
        (name.isin(*settings), settings_description(content)),
    ]
    # Only files at a root with one of the names are looked into; the filter is on the name, before contents.
    named = files.where(name.isin("README.md", "CLAUDE.md", "AGENTS.md", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", *settings))
    said = F
    for at, (here, what) in enumerate(parts):
        said = said.when(here, F.struct(F.lit(at).alias("at"), F.lit(LABELS[at]).alias("label"), what.alias("text")))
    found = named.select("index_id", "file", said.otherwise(F.lit(None)).alias("p")).where("p.text <> ''")
    # A root has at most one file of each name.
    first = found.groupBy("index_id", "p.at").agg(F.min_by(F.concat("p.label", F.lit(": "), "p.text"), "file").alias("text"))
    ordered = first.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    whole = F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), 1, most)
    return ordered.select("index_id", whole.alias("summary"), F.substring(whole, 1, DISPLAY_CHARS).alias("display"))
