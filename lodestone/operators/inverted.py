"""A lexical index that outlives its queries.

Each document is tokenized once, when it comes in. What is kept are tables below one folder, written by Spark and partitioned by
segment and bucket, so that a query reads the buckets of its own terms and an update those of its own files:

| Table | Buckets of | Rows |
|-|-|-|
| forward | file | index_id, file, chunk_id, tokens |
| postings | term, sorted by it | index_id, file, chunk_id, term, dl |
| terms | term | index_id, term, df: what the segment adds to the term's document frequency, or takes off |
| corpus | - | index_id, n, dl: chunks and summed lengths, likewise |
| changes | - | index_id, file: the files that the segment replaces or removes; a row without a file for the segment itself |

An update is a segment of its own. It replaces whole files: their former rows stay where they are and count no more,
as a newer segment names the file, and their tokens are taken off the frequencies. `changes` is written last, and only
segments that it names are read; a segment that is written again takes its own place, so an update that stopped half way can
simply be repeated. `compacted` merges all segments into a new index without tokenizing anything again.

Defined results: null and empty content is a chunk without tokens, which counts in n; of chunks with one id each row
counts; a null file can't be replaced; null index ids are one index; removing an unknown file changes nothing; an index of no
chunks finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens
from lodestone.operators import lexical
from lodestone.operators.joins import BROADCAST_ROWS

BUCKETS = 64
#: Postings that a task sorts, about.
SORTED = 2_000_000
_SCHEMAS = {
    "forward": "index_id string, file string, chunk_id {}, tokens array<string>, segment int, bucket int",
    "postings": "index_id string, file string, chunk_id {}, dl long, term string, segment int, bucket int",
    "terms": "index_id string, term string, df long, segment int, bucket int",
    "corpus": "index_id string, n long, dl long, segment int",
    "changes": "index_id string, file string, segment int",
}


class LexicalIndex:
    """`buckets` and `id_kind`, the type of chunk ids, have to be those that the index was built with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, id_kind: str = "string"):
        self.spark, self.path, self.buckets, self.id_kind = spark, path.rstrip("/"), buckets, id_kind

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, text: str = "content", buckets: int = BUCKETS) -> LexicalIndex:
        """A new index of all `chunks` (index_id, file, chunk_id and the text)."""
        index = cls(chunks.sparkSession, path, buckets, chunks.schema["chunk_id"].dataType.simpleString())
        index._write(0, chunks, text, None)
        return index

    def update(self, segment: int, files: DataFrame, chunks: DataFrame, *, text: str = "content") -> None:
        """Replace all chunks of `files` (file, and index_id if one path may be in several indexes) by `chunks`; files without new chunks are removed.

        `segment` is a number above all others (a stream's batch number, say); the same update written again changes nothing.
        """
        if segment <= max((s for s in self.segments() if s != segment), default=0):
            raise ValueError(f"segment {segment} is not above those of the index")
        self._write(segment, chunks, text, files)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[table].format(self.id_kind)).parquet(f"{self.path}/{table}")

    def _put(self, rows: DataFrame, table: str, segment: int, *order: str) -> None:
        """Rows as a segment of a table: gathered by bucket, large buckets in several files, each in order.

        A size in bytes says little of what many postings take in a sort, so these go by their number (`_pieces` of a bucket).
        """
        keys = [c for c in ("bucket",) if c in rows.columns]
        out = rows.withColumn("segment", F.lit(segment))
        if keys:
            pieces = self._pieces if table == "postings" else 0
            at = F.col("bucket") * pieces + F.pmod(F.xxhash64("chunk_id"), F.lit(pieces)) if pieces else None
            out = out.repartitionById(self.buckets * pieces, at.cast("int")) if pieces else out.hint("rebalance", *keys)
            out = out.sortWithinPartitions("segment", *keys, *order)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", *keys).parquet(f"{self.path}/{table}")

    def _write(self, segment: int, chunks: DataFrame, text: str, files: DataFrame | None) -> None:
        new = chunks.select(F.col("index_id").cast("string"), F.col("file").cast("string"), "chunk_id", code_tokens(F.col(text)).alias("tokens"))
        self._put_all(segment, new, files)

    def _put_all(self, segment: int, new: DataFrame, files: DataFrame | None) -> None:
        self._put(new.withColumn("bucket", self._bucket("file")), "forward", segment, "file")
        now = self._read("forward").where(F.col("segment") == segment)
        gone = self._gone(segment, files)
        terms = F.explode("tokens").alias("term")
        n = now.select(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
        self._pieces = -(-n // (self.buckets * SORTED)) if n > SORTED else 0
        posted = now.select("index_id", "file", "chunk_id", F.size("tokens").cast("long").alias("dl"), terms)
        self._put(posted.withColumn("bucket", self._bucket("term")), "postings", segment, "term")
        signed = now.withColumn("sign", F.lit(1).cast("long"))
        if gone is not None:
            signed = signed.select(*gone.columns, "sign").unionByName(gone.withColumn("sign", F.lit(-1).cast("long")))
        deltas = signed.select("index_id", "sign", terms).groupBy("index_id", "term").agg(F.sum("sign").alias("df")).where("df <> 0")
        self._put(deltas.withColumn("bucket", self._bucket("term")), "terms", segment, "term")
        lengths = signed.groupBy("index_id").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.size("tokens")).alias("dl"))
        self._put(lengths, "corpus", segment)
        mark = self.spark.createDataFrame([(None, None)], "index_id string, file string")
        named = mark if files is None else self._named(files).unionByName(mark)
        self._put(named.withColumns({c: F.col(c).cast("string") for c in ("index_id", "file")}), "changes", segment)

    def _named(self, files: DataFrame) -> DataFrame:
        """(index_id, file); an index_id of null where the file goes whatever its index."""
        index = F.col("index_id").cast("string") if "index_id" in files.columns else F.lit(None).cast("string")
        return files.select(index.alias("index_id"), "file").where("file is not null").distinct()

    def _gone(self, segment: int, files: DataFrame | None) -> DataFrame | None:
        """The rows that a segment takes away: those of its files in the segments before it."""
        if files is None:
            return None
        named = self._named(files)
        # As many numbers as there are buckets, at most.
        touched = [r[0] for r in named.select(self._bucket("file")).distinct().collect()]
        before = self._live(self._read("forward").where(F.col("bucket").isin(touched)), [s for s in self.segments() if s < segment])
        return before.select("index_id", "file", "chunk_id", "tokens").join(named.select(F.col("file").alias("_f"), F.col("index_id").alias("_i")), (F.col("file") == F.col("_f")) & (F.col("_i").isNull() | (F.col("_i") == F.col("index_id"))), "left_semi")

    def segments(self) -> list[int]:
        """The segments that were written whole."""
        try:
            return sorted(r.segment for r in self._read("changes").select("segment").distinct().collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """Rows of these segments whose file no later one of them names."""
        rows = rows.where(F.col("segment").isin(segments))
        if len(segments) < 2:
            return rows
        changes = self._read("changes").where(F.col("segment").isin(segments) & F.col("file").isNotNull())
        last = changes.groupBy(F.col("index_id").alias("_i"), F.col("file").alias("_f")).agg(F.max("segment").alias("_last"))
        if last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            last = F.broadcast(last)
        later = (F.col("file") == F.col("_f")) & (F.col("_i").isNull() | (F.col("_i") == F.col("index_id"))) & (F.col("segment") < F.col("_last"))
        return rows.join(last, later, "left_anti")

    def documents(self) -> DataFrame:
        """(index_id, file, chunk_id, tokens) of all chunks that count."""
        return self._live(self._read("forward"), self.segments()).select("index_id", "file", "chunk_id", "tokens")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(index_id, chunk_id, dl, term), of some buckets or all."""
        rows = self._read("postings")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return self._live(rows, self.segments()).select("index_id", "chunk_id", "dl", "term")

    def term_stats(self, by: tuple[str, ...] = (), buckets: list[int] | None = None) -> DataFrame:
        """(*by, term, df): the segments' signed numbers, summed."""
        rows = self._read("terms").where(F.col("segment").isin(self.segments()))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy(*by, "term").agg(F.sum("df").alias("df")).where("df > 0")

    def corpus_stats(self, by: tuple[str, ...] = ()) -> DataFrame:
        """(*by, n, avgdl)."""
        rows = self._read("corpus").where(F.col("segment").isin(self.segments()))
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n > 0").select(*by, "n", (F.col("dl") / F.col("n")).alias("avgdl"))

    def scores(self, queries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, *by, chunk_id, score) of every chunk that shares a term with a query (query_id, text). Only the terms' buckets are read."""
        terms = queries.select("query_id", F.explode(code_tokens(F.col("text"))).alias("term"))
        few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        kept = F.broadcast if few else lambda df: df
        # As many numbers as there are buckets, at most.
        buckets = [r[0] for r in terms.select(self._bucket("term")).distinct().collect()]
        words = kept(terms.select("term").distinct())
        hit = self.postings(buckets).join(words, "term", "left_semi")
        dfs = self.term_stats(by, buckets).join(words, "term", "left_semi")
        return lexical.weighed(hit, dfs, self.corpus_stats(by), terms, by, few)

    def top(self, queries: DataFrame, top: int | Column, *, by: tuple[str, ...] = ()) -> DataFrame:
        """The whole lane: (query_id, *by, chunk_id, score, rank)."""
        return lexical.ranked(self.scores(queries, by=by), top, by=by)

    def has_any(self, words: tuple[str, ...]) -> bool:
        """Whether a chunk has one of these words, by their buckets' frequencies alone."""
        wanted = self.spark.createDataFrame([(w,) for w in words], "term string")
        buckets = [r[0] for r in wanted.select(self._bucket("term")).distinct().collect()]
        return not self.term_stats((), buckets).where(F.col("term").isin(*words)).isEmpty()

    def compacted(self, path: str) -> LexicalIndex:
        """The same index in one segment, at a new path."""
        index = LexicalIndex(self.spark, path, self.buckets, self.id_kind)
        index._put_all(0, self.documents(), None)
        return index
