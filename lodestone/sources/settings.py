"""Settings of indexes from a project's own file: what each named index covers, and the terms of its domain."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.files import configured_extensions, scan
from lodestone.sources.manifests import SETTINGS


@dataclass(frozen=True)
class IndexSettings:
    """A named part of a project: folders (none: all of it), globs to leave out, languages (none: all) and domain terms."""

    name: str
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    domain_terms: tuple[str, ...] = ()

    def roots(self, root: str) -> list[str]:
        """The folders below `root`; "." and an empty path are the root itself."""
        base = root.rstrip("/")
        inner = [p.strip().removeprefix("./").strip("/") for p in self.paths]
        return [base if p in ("", ".") else f"{base}/{p}" for p in inner] or [base]

    def extensions(self) -> list[str]:
        return configured_extensions(self.languages)

    def scan(self, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
        """The files of this index, and those that are no UTF-8. A glob that ends in "/" leaves out what is below the folder."""
        globs = [g + "**" if g.endswith("/") else g for g in self.exclude]
        return scan(spark, self.roots(root), index_id=self.name, extensions=self.extensions(), exclude=globs)


def parse(text: str) -> list[IndexSettings]:
    """The indexes of a YAML or JSON text; ValueError if it can't be read, or an index has no name or a list that is none.

    JSON is read without help; YAML needs its usual package, which is optional.
    """
    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("settings in YAML need the package yaml; JSON does without") from e
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"the settings can't be read: {e}") from e
    if not isinstance(value, dict) or not isinstance(value.get("indexes"), list):
        raise ValueError("settings have a list of indexes")
    found = []
    for entry in value["indexes"]:
        if not isinstance(entry, dict) or not isinstance(entry.get("name"), str):
            raise ValueError("an index has a name")
        lists = {k: entry.get(k) or [] for k in ("paths", "exclude", "languages", "domain_terms")}
        for k, v in lists.items():
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise ValueError(f"{k} of {entry['name']} is a list of strings")
        found.append(IndexSettings(entry["name"], **{k: tuple(v) for k, v in lists.items()}))
    return found


def load(root: str, names: tuple[str, ...] = SETTINGS) -> list[IndexSettings] | None:
    """The settings at a local project root; None if there is no such file."""
    for name in names:
        path = Path(root) / name
        if path.exists():
            return parse(path.read_text(encoding="utf-8"))
    return None


def filter_set(text: str | None) -> frozenset[str] | None:
    """Comma-separated names, trimmed and in lower case; None, which is no filter, if there are none."""
    return frozenset(x for x in (p.strip().lower() for p in (text or "").split(",")) if x) or None
