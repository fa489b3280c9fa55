"""WARC archives: a writer with revisit records, and a reader that splits archives by byte ranges.

Each record is a gzip member of its own. The reader's tasks scan their range for the gzip magic. A candidate is
taken for a member if it decodes, with its checksum, to something that starts with a WARC version line, and if
members follow one another from there on to the range's end and for at least PROOF bytes, or to the end of the
file. What looks like a member within the stored blocks of another one can't pass that: stored blocks are
shorter than PROOF. If a candidate decodes but its chain breaks, the file is walked from its first byte instead. A
task owns the records of the members that start inside its range. A file that doesn't start with a member, or in which
something else follows a member, is an error, wherever the damage lies.

Defined results: a null html is an empty payload; of records with equal payloads of at least `least` bytes the
one with the largest page_id is the response and the others revisit it; rows that repeat both that page_id and
the payload are all responses, as are rows without an id whose payload no row with an id has; control characters
of a URL are percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shared_path, shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
#: Longer than any stored block of a deflate stream.
PROOF = 1 << 17
_READ = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (as Spark writes them) and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_id(page_id: int | None) -> str:
    """A UUID of the free-form version 8 that holds the page's id."""
    digits = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-8000-{'8001' if page_id is None else '8000'}-{digits[12:]:0>12}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8000-8000-0{8}([0-9a-f]{4})>", record or "")
    if not m:
        return None
    n = int("".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def member(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, path: str, *, least: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives into the folder `path`; returns path, records and bytes of each.

    One shuffle of the payloads, by their digests; a digest that many pages share is split among tasks by the
    join, as nothing above it needs its rows together. A task that runs twice leaves one file under its name.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    tops = pages.select(F.sha1(html.cast("binary")).alias("sha1"), "page_id", F.octet_length(html).alias("n")).where(F.col("n") >= least)
    tops = tops.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "top")
    joined = known.join(tops, "sha1", "left").select("page_id", "url", "html", "sha1", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        task = TaskContext.get()
        name, trial = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        records = size = 0
        with fs.open_output_stream(trial, compression=None) as out:
            for batch in batches:
                for page_id, url, text, sha1, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = member(page_id, url, text.encode(), sha1, top, top is not None and page_id != top)
                    out.write(data)
                    records, size = records + 1, size + len(data)
        if records:
            fs.move(trial, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        else:
            fs.delete_file(trial)

    return cut(joined.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Archive:
    """One open archive."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file, self.uri = fs.open_input_file(path), uri
        self.size = self.file.size()

    def end_of_member(self, at: int) -> int | None:
        """Where the member that starts at `at` ends, or None if there is no WARC member."""
        unpack, head, pos = zlib.decompressobj(31), b"", at
        try:
            while not unpack.eof:
                data = self.file.read_at(min(_READ, self.size - pos), pos)
                if not data:
                    return None
                pos += len(data)
                out = unpack.decompress(data, _READ)
                while True:
                    head += out[: max(0, 5 - len(head))]
                    if len(head) == 5 and head != b"WARC/":
                        return None
                    if unpack.eof or not unpack.unconsumed_tail:
                        break
                    out = unpack.decompress(unpack.unconsumed_tail, _READ)
        except zlib.error:
            return None
        return pos - len(unpack.unused_data) if len(head) == 5 else None

    def chain(self, at: int, upto: int) -> tuple[list[int], bool]:
        """Starts of the members from `at` to `upto`, and whether they follow one another without a break.

        What follows the last one has to be a member too, so a damaged member is found by whoever owns the one before it.
        """
        starts = []
        while at < self.size:
            end = self.end_of_member(at)
            if end is None:
                return starts, False
            if at >= upto:
                break
            starts.append(at)
            at = end
        return starts, True

    def candidates(self, at: int, end: int) -> Iterator[int]:
        while at < end:
            data = self.file.read_at(min(_READ, end + len(MAGIC) - 1 - at, self.size - at), at)
            found = data.find(MAGIC)
            while found >= 0:
                if at + found < end:
                    yield at + found
                found = data.find(MAGIC, found + 1)
            at += max(1, len(data) - len(MAGIC) + 1)

    def members(self, start: int, end: int) -> list[int]:
        """Starts of all members inside the range."""
        if not start:
            return self._walk(start, end)
        doubted = False
        for at in self.candidates(start, end):
            starts, whole = self.chain(at, max(end, at + PROOF))
            if whole:
                return [s for s in starts if s < end] if not doubted else self._walk(start, end)
            doubted |= bool(starts)
        return self._walk(start, end) if doubted else []

    def _walk(self, start: int, end: int) -> list[int]:
        starts, whole = self.chain(0, end)
        if not whole:
            raise ValueError(f"{self.uri}: a member is damaged after byte {starts[-1] if starts else 0}")
        return [s for s in starts if s >= start]

    def records(self, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and block of each record of a member."""
        unpack, parts, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            data = self.file.read_at(min(_READ, self.size - pos), pos)
            pos += len(data)
            parts.append(unpack.decompress(data))
        data, pos = b"".join(parts), 0
        while data.startswith(b"WARC/", pos):
            head = data.index(b"\r\n\r\n", pos)
            fields = dict(line.split(": ", 1) for line in data[pos:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
            fields = {k.lower(): v for k, v in fields.items()}
            stop = head + 4 + int(fields["content-length"])
            yield fields, data[head + 4 : stop]
            pos = stop + 4


SCHEMA = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives (*.warc.gz) in a folder: SCHEMA, and payload (binary) if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive, rows = Archive(uri), []
                for at in archive.members(start, min(start + split_bytes, archive.size)):
                    for fields, block in archive.records(at):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        revisit, digest = fields.get("warc-type") == "revisit", fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if not revisit and (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
                            if digest:
                                raise ValueError(f"{uri}: the payload at byte {at} doesn't match its digest")
                            digest = own
                        rows.append((uri, at, fields.get("warc-type"), page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), int(size[1]) if size else len(payload), digest, page_of(fields.get("warc-refers-to")), *[payload] * with_payload))
                    if len(rows) >= 512:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    return ranges.repartition(shuffle_partitions(spark), "path", "start").mapInArrow(run, SCHEMA + ", payload binary" * with_payload)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write `pages` as archives to the shared folder and read every record back."""
    path = shared_path(pages.sparkSession, "warc")
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)
