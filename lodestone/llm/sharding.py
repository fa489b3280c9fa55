"""Shards of near equal size by histogram sort.

Rows have a place in one order: by a hash of the text, then of the id, then by the number that a row has in the
written key table. So equal texts stand together, rows that are equal in everything can still be parted, and the
order is a shuffle of the corpus. The order is cut where the bytes below it reach each shard's share:
1. The driver proposes keys as probes; tasks count the exact bytes and rows between them, and the least and
   greatest key that they meet there.
2. A cut whose bytes are within `tolerance` of its share, or with one row left around it, is settled. Between the
   least and greatest keys around each other cut new probes are spread, and the tasks count again.
3. When all are settled, each row is sent to its range once, and numbered there; the counts below a range are known, so
   numbers run through a shard without one task having to see the whole of it.

Shards consist of ranges of at most `range_bytes` about, up to `RANGES` of them in all, so that a task sorts a range. The
driver holds probes and cuts (thousands of keys of 24 bytes), never rows.

Defined results: null text counts 16 bytes like an empty one, and its checksum is that of no bytes; a null id is
kept; equal rows are rows each, with slots of their own; a document that is larger than a shard's share makes its shard as
large as that; there may be empty shards if rows are few; an empty table gives an empty result; all columns of
the input are kept by `sharded_documents`, whose own ones are named shard and slot (columns of the input with these names
are replaced).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lodestone.llm.common import cut, scratch, shuffle_partitions

#: Bytes that a document counts beside those of its text.
EXTRA = 16
#: Probes in a round, about, and ranges in all.
PROBES, RANGES = 16_384, 8_192
_WIDTH = 24
_KEY = ("_s_text", "_s_id", "_s_row")
_END = 1 << (8 * _WIDTH)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + EXTRA
    own = {"_s_size": size, "_s_crc": F.crc32(text), "_s_text": F.xxhash64("text"), "_s_id": F.xxhash64(F.lit(1), "doc_id"), "_s_row": F.monotonically_increasing_id()}
    return docs.withColumns(own)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' keys as bytes that sort like them."""
    out = np.empty((batch.num_rows, 3), ">u8")
    for i, c in enumerate(_KEY):
        out[:, i] = batch.column(c).to_numpy().view("u8") ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view(f"S{_WIDTH}").ravel()


def _as_bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(min(k, _END - 1).to_bytes(_WIDTH, "big") for k in keys), f"S{_WIDTH}")


def _counted(probes: list[int]):
    """In a task: (cell, bytes, rows, least, greatest key) of the cells between probes; cell i holds what i probes are not above."""
    marks = _as_bytes(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(marks) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, b"\xff" * _WIDTH, f"S{_WIDTH}"), np.zeros(n, f"S{_WIDTH}")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch)
            order = np.argsort(keys)
            keys, sizes = keys[order], batch.column("_s_size").to_numpy()[order]
            cells, first, held = np.unique(np.searchsorted(marks, keys, side="right"), return_index=True, return_counts=True)
            size[cells] += np.add.reduceat(sizes, first)
            rows[cells] += held
            low, high = keys[first], keys[first + held - 1]
            least[cells] = np.where(low < least[cells], low, least[cells])
            most[cells] = np.where(high > most[cells], high, most[cells])
        at = np.flatnonzero(rows)
        full = [pa.array([bytes(k).ljust(_WIDTH, b"\0") for k in c[at]], pa.binary()) for c in (least, most)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(size[at]), pa.array(rows[at]), *full], ["cell", "size", "rows", "least", "most"])

    return run


class Splitters:
    """The keys at which the order is cut, found by counting below probes: `keys` has points (key, bytes below, rows below)."""

    def __init__(self, keyed: DataFrame, shares: list[float], tolerances: list[float]):
        """`shares` are the fractions of all bytes below each cut, rising; `tolerances` what each may miss, as such fractions."""
        narrow = keyed.select(*_KEY, "_s_size")
        self.points, self.rounds = [(0, 0, 0)], 0
        probes = [_END * i // PROBES for i in range(1, PROBES)]
        while probes:
            self.rounds += 1
            found = narrow.mapInArrow(_counted(probes), "cell int, size long, rows long, least binary, most binary").groupBy("cell")
            cells = {r.cell: r for r in found.agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most")).collect()}
            self._learn(probes, cells)
            probes = self._next(shares, tolerances)
        below = [p[1] for p in self.points]
        self.cuts = [self._best(s * below[-1], below) for s in shares]

    def _learn(self, probes: list[int], cells: dict) -> None:
        """Known points, from all cells: sums below them are exact, as every round counts all rows."""
        size, rows = 0, 0
        found = {k: (b, n) for k, b, n in self.points}
        for cell in range(len(probes) + 1):
            if cell:
                found[probes[cell - 1]] = (size, rows)
            if cell in cells:
                r = cells[cell]
                found[int.from_bytes(r.least, "big")] = (size, rows)
                size, rows = size + r.size, rows + r.rows
                found[int.from_bytes(r.most, "big") + 1] = (size, rows)
        self.points = sorted((k, b, n) for k, (b, n) in found.items())

    def _around(self, wanted: float, below: list[int]) -> tuple[int, int]:
        """The points next to the place with `wanted` bytes below: the last one that has no more, the first that has more."""
        hi = bisect.bisect_right(below, wanted)
        return hi - 1, min(hi, len(below) - 1)

    def _best(self, wanted: float, below: list[int]) -> tuple[int, int, int]:
        lo, hi = self._around(wanted, below)
        return self.points[lo] if wanted - below[lo] <= below[hi] - wanted else self.points[hi]

    def _next(self, shares: list[float], tolerances: list[float]) -> list[int]:
        below = [p[1] for p in self.points]
        open_: dict[tuple[int, int], int] = {}
        total = below[-1]
        for s, t in zip(shares, tolerances, strict=True):
            lo, hi = self._around(s * total, below)
            off = min(s * total - below[lo], below[hi] - s * total)
            if off > t * total and self.points[hi][2] - self.points[lo][2] > 1:
                open_[lo, hi] = open_.get((lo, hi), 0) + 1
        each, probes = max(8, PROBES // max(1, sum(open_.values()))), set()
        for (lo, hi), n in open_.items():
            a, b, m = self.points[lo][0], self.points[hi][0], min(each * n, PROBES)
            probes |= {a + (b - a) * i // (m + 1) for i in range(1, m + 1)} - {a, b}
        return sorted(probes)


def _ranges(total: int, shards: int, range_bytes: int, partitions: int) -> int:
    """Ranges in each shard."""
    return max(1, min(RANGES // shards, max(-(-total // (shards * range_bytes)), -(-2 * partitions // shards))))


def _placed(keyed: DataFrame, shards: int, tolerance: float, range_bytes: int) -> DataFrame:
    """A written `_keyed` table with shard and slot."""
    total = keyed.agg(F.sum("_s_size")).first()[0] or 0
    if not total:
        return keyed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    parts = _ranges(total, shards, range_bytes, shuffle_partitions(keyed.sparkSession))
    n = shards * parts
    within = [(tolerance if i % parts == 0 else 0.25 / parts) / shards for i in range(1, n)]
    cuts = Splitters(keyed, [i / n for i in range(1, n)], within).cuts
    marks = _as_bytes([c[0] for c in cuts])
    before = np.array([0, *[c[2] for c in cuts]], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(marks, _keys(batch), side="right")
            start = before[at] - before[at // parts * parts]
            own = [pa.array(at.astype(np.int32)), pa.array((at // parts).astype(np.int32)), pa.array(start)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "_s_range", "shard", "_s_start"])

    schema = StructType(list(keyed.schema.fields)).add("_s_range", IntegerType()).add("shard", IntegerType()).add("_s_start", LongType())
    dealt = keyed.mapInArrow(run, schema)
    order = Window.partitionBy("_s_range").orderBy(*_KEY)
    return dealt.withColumn("slot", (F.col("_s_start") + F.row_number().over(order) - 1).cast("long")).drop("_s_range", "_s_start")


def shard(docs: DataFrame, *, shards: int = 40, tolerance: float = 0.001, range_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of `docs` (doc_id, text). Texts are read once and not moved."""
    keyed = cut(_keyed(docs.select("doc_id", "text")).drop("text"), "shard-keys")
    return _placed(keyed, shards, tolerance, range_bytes).select("doc_id", F.col("_s_size").alias("size"), F.col("_s_crc").alias("text_crc32"), "shard", "slot")


def sharded_documents(docs: DataFrame, *, shards: int = 40, tolerance: float = 0.001, range_bytes: int = 64 << 20) -> DataFrame:
    """The rows of `docs` with shard and slot, each range of a shard in the order of its slots; whole rows are exchanged once."""
    kept = docs.drop("shard", "slot")
    rows = _keyed(kept.select("doc_id", "text", F.struct("*").alias("_s_doc"))).drop("doc_id", "text")
    return _placed(cut(rows, "shard-rows"), shards, tolerance, range_bytes).select("_s_doc.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write `docs` as Parquet with a folder for each shard, to be read in the order of slot."""
    with scratch() as own_cut:
        own_cut(sharded_documents(docs, **options), "shards").write.partitionBy("shard").parquet(path)
