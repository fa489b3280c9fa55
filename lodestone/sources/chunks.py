"""Chunkers: tables of files in, tables of chunks out.

Lines are exploded once with their numbers; fences, sections, paragraphs and nesting are running sums over a
file's lines, and each section is put together again by an ordered aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, lines

WINDOW, STRIDE = 150, 50
OVERSIZED, SUB_LINES, SUB_STRIDE = 200, 100, 50
PARAGRAPH_LINES, JSON_LINES = 50, 500
COLUMNS = ("chunk_id", "file", "start_line", "end_line", "content", "function_name", "chunk_type")


def chunk_id(file: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    named = F.concat_ws("::", file, kind, name, start.cast("string"))
    return F.when(name.isNotNull(), named).otherwise(F.concat_ws(":", file, start.cast("string"), end.cast("string")))


def _finished(found: DataFrame, *more: str) -> DataFrame:
    """(file, start_line, end_line, content, function_name, chunk_type) with ids, in the order of COLUMNS, then `more`."""
    ident = chunk_id(*[F.col(c) for c in ("file", "chunk_type", "function_name", "start_line", "end_line")])
    return found.withColumn("chunk_id", ident).select(*COLUMNS, *more)


def windows(rows: Column, size: int, stride: int) -> Column:
    """(start, end) of windows of `size` lines, from the first to the one that reaches the last line; 1-based, inclusive."""
    n = F.size(rows)
    last = F.greatest(F.ceil((n - size) / F.lit(stride)).cast("int"), F.lit(0))
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride + 1).cast("int").alias("start"), F.least(i * stride + size, n).cast("int").alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def sliding(files: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Overlapping windows of lines."""
    cut = files.select("file", lines(F.col("content")).alias("rows"))
    cut = cut.select("file", "rows", F.explode(windows(F.col("rows"), size, stride)).alias("w"))
    text = F.array_join(F.slice("rows", F.col("w.start"), F.col("w.end") - F.col("w.start") + 1), "\n")
    return _finished(cut.select("file", F.col("w.start").alias("start_line"), F.col("w.end").alias("end_line"), text.alias("content"), F.lit(None).cast("string").alias("function_name"), F.lit("Code").alias("chunk_type")))


def whole(files: DataFrame, kind: str = "Code") -> DataFrame:
    """A chunk for each file that has lines."""
    rows = files.select("file", lines(F.col("content")).alias("rows")).where(F.size("rows") > 0)
    return _finished(rows.select("file", F.lit(1).alias("start_line"), F.size("rows").alias("end_line"), F.array_join("rows", "\n").alias("content"), F.lit(None).cast("string").alias("function_name"), F.lit(kind).alias("chunk_type")))


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(lines(F.col("content"))).alias("at", "line")).withColumn("at", F.col("at") + 1)


def _order(*more: str) -> Window:
    return Window.partitionBy("file", *more).orderBy("at")


def _upto(*more: str) -> Window:
    return _order(*more).rowsBetween(Window.unboundedPreceding, 0)


def _sections(marked: DataFrame, kind: str) -> DataFrame:
    """Lines (file, at, line, section, name) as chunks; sections without visible text are dropped."""
    parts = marked.groupBy("file", "section").agg(F.min("at").alias("start_line"), F.max("at").alias("end_line"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"), F.max("name").alias("function_name"))
    text = F.array_join(F.transform("rows", lambda r: r.line), "\n")
    shaped = parts.select("file", "start_line", "end_line", text.alias("content"), "function_name", F.lit(kind).alias("chunk_type"))
    return _finished(shaped.where(F.trim(F.regexp_replace("content", r"\s", " ")) != ""))


def _or_whole(found: DataFrame, files: DataFrame, kind: str = "Code") -> DataFrame:
    """Files that gave no chunk become one whole chunk."""
    return found.unionByName(whole(files.join(found.select("file").distinct(), "file", "left_anti"), kind), allowMissingColumns=True)


def markdown(files: DataFrame) -> DataFrame:
    """A section for every heading outside of code fences, and what stands before the first."""
    text = F.ltrim("line")
    fence = text.startswith("```") | text.startswith("~~~")
    marked = _numbered(files).withColumn("fence", fence.cast("int"))
    inside = F.sum("fence").over(_upto()) % 2 == 1
    marked = marked.withColumn("head", (text.startswith("#") & ~inside & (F.col("fence") == 0)).cast("int"))
    name = F.trim(F.regexp_replace(text, "^#+", ""))
    marked = marked.withColumn("section", F.sum("head").over(_upto())).withColumn("name", F.when((F.col("head") == 1) & (name != ""), name))
    return _or_whole(_sections(marked, "Docstring"), files, "Docstring")


def _keyed(files: DataFrame, key: Column, name: Column) -> DataFrame:
    marked = _numbered(files).withColumn("head", key.cast("int"))
    marked = marked.withColumn("section", F.sum("head").over(_upto())).withColumn("name", F.when(F.col("head") == 1, name))
    return _or_whole(_sections(marked.where("section > 0"), "Constant"), files)


def yaml(files: DataFrame) -> DataFrame:
    """A chunk for every top-level key."""
    name = F.regexp_extract("line", r"^([^\s#:-][^\s:]*):", 1)
    return _keyed(files, name != "", name)


def toml(files: DataFrame) -> DataFrame:
    """A chunk for every table header."""
    line = F.rtrim("line")
    return _keyed(files, line.startswith("[") & line.endswith("]"), F.trim(F.regexp_replace(line, r"^\[+|\]+\z", "")))


def json(files: DataFrame) -> DataFrame:
    """One chunk for files of fewer than 500 lines, none for others."""
    return whole(files.where(F.size(lines(F.col("content"))) < JSON_LINES), "Constant")


def plaintext(files: DataFrame, most: int = PARAGRAPH_LINES) -> DataFrame:
    """Paragraphs between blank lines, parted after `most` lines."""
    marked = _numbered(files).withColumn("blank", (F.trim(F.regexp_replace("line", r"\s", " ")) == "").cast("int"))
    marked = marked.withColumn("paragraph", F.sum("blank").over(_upto())).where("blank = 0")
    within = F.row_number().over(_order("paragraph")) - 1
    marked = marked.withColumn("section", F.struct("paragraph", F.floor(within / most).alias("part"))).withColumn("name", F.lit(None).cast("string"))
    return _sections(marked, "Code")


def xml(files: DataFrame) -> DataFrame:
    """A chunk for every child of the root that spans lines; a whole chunk if there is none."""
    text = F.regexp_replace("line", r"<!--.*?-->|<\?.*?\?>|<![^>]*>", "")
    opens = F.size(F.regexp_extract_all(text, F.lit(r"<[A-Za-z_][^>]*(?<!/)>"), F.lit(0)))
    closes = F.size(F.regexp_extract_all(text, F.lit(r"</[^>]+>"), F.lit(0)))
    marked = _numbered(files).withColumn("step", opens - closes)
    marked = marked.withColumn("after", F.sum("step").over(_upto())).withColumn("before", F.col("after") - F.col("step"))
    marked = marked.withColumn("head", ((F.col("before") == 1) & (F.col("after") > 1)).cast("int"))
    marked = marked.withColumn("section", F.sum("head").over(_upto())).where("section > 0 and (before > 1 or after > 1)")
    marked = marked.withColumn("name", F.when(F.col("head") == 1, F.regexp_extract("line", r"<([A-Za-z_][\w:.-]*)", 1)))
    return _or_whole(_sections(marked, "Class"), files)


def documents(files: DataFrame) -> DataFrame:
    """Each file by the chunker of its format; others by sliding windows."""
    ext = extension(F.col("file"))
    own = {("md", "mdx"): markdown, ("yaml", "yml"): yaml, ("toml",): toml, ("json",): json, ("txt", "log"): plaintext, ("xml",): xml}
    out = sliding(files.where(~ext.isin(*[e for k in own for e in k])))
    for kinds, chunker in own.items():
        out = out.unionByName(chunker(files.where(ext.isin(*kinds))))
    return out


def split_oversized(chunks: DataFrame, most: int = OVERSIZED, size: int = SUB_LINES, stride: int = SUB_STRIDE) -> DataFrame:
    """Chunks of more lines also as overlapping parts, which know their parent, as it knows them."""
    rows = lines(F.col("content"))
    large = chunks.withColumn("_rows", rows).where(F.size("_rows") > most).select("*", F.posexplode(windows(F.col("_rows"), size, stride)).alias("_i", "_w"))
    parts = large.select(
        F.concat_ws("::", "chunk_id", F.lit("sub"), F.col("_i").cast("string")).alias("chunk_id"), "file", (F.col("start_line") + F.col("_w.start") - 1).alias("start_line"), (F.col("start_line") + F.col("_w.end") - 1).alias("end_line"),
        F.array_join(F.slice("_rows", F.col("_w.start"), F.col("_w.end") - F.col("_w.start") + 1), "\n").alias("content"), "function_name", "chunk_type", F.col("chunk_id").alias("parent_chunk_id"), F.array().cast("array<string>").alias("child_chunk_ids"),
    )
    n = F.when(F.size(rows) > most, F.size(windows(rows, size, stride))).otherwise(0)
    children = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws("::", F.col("chunk_id"), F.lit("sub"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return chunks.select(*COLUMNS, F.lit(None).cast("string").alias("parent_chunk_id"), children.alias("child_chunk_ids")).unionByName(parts)
