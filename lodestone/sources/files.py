"""Source scans: what is read, what is skipped, and in which language it is."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import basename, excluded, extension, lines

# Extensions that are read, folders and files that are skipped, binary extensions, languages.
SOURCE_EXTENSIONS = (
    "rs", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt", "kts",
    "scala", "groovy", "gradle", "sh", "md", "mdx", "yaml", "yml", "toml", "json", "xml", "txt", "log",
)
SKIPPED_FOLDERS = (
    ".git", "target", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".build", ".next", ".nuxt", ".svelte-kit",
    "vendor", ".cargo", ".npm", ".cache", ".pnpm-store", ".yarn", ".rustup", ".tox", ".bundle", "coverage", ".nyc_output",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".gradle", ".mvn", ".m2", "out", "bin", "classes", "generated",
    "generated-sources", "generated-test-sources", "cdk.out", "cdk.out2", ".aws-sam", ".turbo", ".idea", ".vscode", ".claude",
    ".claude-mpm", ".open-mpm", ".cursor", ".aider", ".continue", ".obsidian", "fixtures", "__fixtures__", "testdata", "test-data",
    "test_data", "testresources", "test_resources",
)
SKIPPED_FILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "composer.lock", "go.sum")
BINARY_EXTENSIONS = (
    "wasm", "so", "dylib", "dll", "exe", "pdf", "png", "jpg", "jpeg", "gif", "ico", "webp", "zip", "tar", "gz", "bz2", "xz", "7z", "rar",
    "ttf", "otf", "woff", "woff2", "mp3", "mp4", "mov", "avi", "mkv", "db", "sqlite", "lock", "pyc", "class", "o", "a",
)
BUNDLE_ENDS = (".min.js", ".min.css", ".bundle.js", ".bundle.css", ".chunk.js")
MOST_BYTES = 1_048_576
MINIFIED_LINE, MINIFIED_LINES = 500, 5
LANGUAGES = {
    "rust": ("rs",), "python": ("py",), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts", "tsx"), "go": ("go",),
    "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "ruby": ("rb",), "php": ("php",),
    "scala": ("scala",), "csharp": ("cs",), "kotlin": ("kt", "kts"), "swift": ("swift",),
}
#: Extensions that a language's name or short name stands for in an index's configuration.
CONFIGURED = {"rust": "rust", "rs": "rust", "python": "python", "py": "python", "typescript": "typescript", "ts": "typescript", "javascript": "javascript", "js": "javascript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "c++": "cpp", "cxx": "cpp"}


def language(path: Column) -> Column:
    """The language by extension; null if there is none."""
    ext, out = extension(path), F
    for name, own in LANGUAGES.items():
        out = out.when(ext.isin(*own), name)
    return out.otherwise(F.lit(None).cast("string"))


def configured_extensions(names: Sequence[str]) -> list[str]:
    return [e for n in names if n.lower() in CONFIGURED for e in LANGUAGES[CONFIGURED[n.lower()]]]


def in_skipped_folder(path: Column) -> Column:
    """Whether a folder of the path (not its last part) is skipped."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def skipped_path(path: Column, n_bytes: Column) -> Column:
    """Lock files, binaries, bundles (by suffix or a hash in the name) and files that are too large."""
    name, ext = basename(path), extension(path)
    bundle = F.lit(False)
    for end in BUNDLE_ENDS:
        bundle = bundle | F.lower(name).endswith(end)
    hashed = ext.isin("js", "css") & F.regexp_replace(name, r"\.[^.]*\z", "").rlike(r"-[A-Za-z0-9]{8,}\z")
    return name.isin(*SKIPPED_FILES) | ext.isin(*BINARY_EXTENSIONS) | bundle | hashed | (n_bytes > MOST_BYTES)


def minified(path: Column, content: Column) -> Column:
    rows = lines(content)
    return extension(path).isin("js", "mjs", "cjs") & (F.size(rows) < MINIFIED_LINES) & F.exists(rows, lambda x: F.octet_length(x) > MINIFIED_LINE)


def scan(spark: SparkSession, roots: Sequence[str], *, index_id: str = "default", extensions: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Files below the roots, each once, as (index_id, file, content, content_sha256, n_bytes); and those that are no UTF-8.

    Roots that lie in other ones are not listed again, so no file comes twice and nothing has to be compared. Extensions are
    looked at while listing and sizes before reading; files in skipped folders are dropped after it. A file's name is relative to
    the nearest of its roots.
    """
    wanted = [e.lower().lstrip(".") for e in extensions] or list(SOURCE_EXTENSIONS)
    glob = "*.{" + ",".join(sorted({"".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted})) + "}"
    plain_roots = {r.rstrip("/"): r for r in roots}
    outer = [r for k, r in plain_roots.items() if not any(k.startswith(f"{o}/") for o in plain_roots)]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(outer).where(F.col("length") <= MOST_BYTES)
    bases = sorted({r.rstrip("/").removeprefix("file://") for r in roots}, key=len, reverse=True)
    plain = F.regexp_replace("path", "^file:/*", "/")
    relative = F
    for base in bases:
        relative = relative.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2)))
    files = listed.withColumn("file", F.coalesce(relative.otherwise(plain), plain))
    kept = files.where(extension(F.col("file")).isin(*wanted) & ~in_skipped_folder(F.col("file")) & ~skipped_path(F.col("file"), F.col("length")))
    if exclude:
        kept = kept.where(~excluded(F.col("file"), exclude))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    bad = kept.where(~valid).select(F.lit(index_id).alias("index_id"), "file")
    good = kept.where(valid).select(F.lit(index_id).alias("index_id"), "file", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("n_bytes"))
    return good.where(~minified(F.col("file"), F.col("content"))), bad


def inline(spark: SparkSession, files: Sequence[tuple[str, str]], index_id: str = "default") -> DataFrame:
    """Files that are given as (path, content)."""
    rows = spark.createDataFrame(list(files), "file string, content string")
    return rows.select(F.lit(index_id).alias("index_id"), "file", "content", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


def branch_files(root: str, branch: str) -> list[str]:
    """Files that a branch changed since it left HEAD; none if git can't tell."""

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, check=True, timeout=60).stdout

    try:
        base = git("merge-base", "HEAD", branch).strip()
        return [f for f in git("diff", "--name-only", f"{base}..HEAD").splitlines() if f]
    except (OSError, subprocess.SubprocessError):
        return []


def project_root(start: str, markers: Sequence[str] = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod")) -> Path:
    """The nearest folder with .git, else the nearest with a manifest, else the start itself."""
    here = Path(start).resolve()
    for names in ([".git"], markers):
        for folder in (here, *here.parents):
            if any((folder / n).exists() for n in names):
                return folder
    return here


def entity_references(refs: DataFrame) -> DataFrame:
    """Occurrences (symbol, file, start_line, is_definition) of an external index as entities."""
    kind = F.when(F.col("is_definition"), "NamedType").otherwise("ModulePath")
    return refs.select(
        F.concat_ws(":", "file", "start_line", F.xxhash64("symbol")).alias("entity_id"), kind.alias("entity_type"), F.col("symbol").alias("text"),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span"), "file", F.col("start_line").cast("int").alias("line"),
    )
