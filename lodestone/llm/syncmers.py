"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the least hash among its s-mers is that of its first or its last
one. Whether it is depends on the k-mer alone, so equal stretches of two texts have equal anchors wherever
they stand. A fingerprint holds all distinct anchors of the whole text, with where each first stands, and up to which
hash it is complete. Callers may ask for smaller ones: with a `share` below 1 only anchors with hashes in the lowest
`share` of their range stay, and the `least` lowest ones at any rate. Two fingerprints
are compared by the anchors up to the lower of their bounds that match in the same order (the longest chain of
matches with rising positions), as the Dice share: about the share of either text that the other has too.

Defined results: null texts count as empty; the fingerprint of an empty text is empty, is 1 alike to itself and
0 to any other; a text too short for a syncmer has its whole text as one anchor; equal texts have equal
fingerprints. The next document is that with the next lower doc_id (after the last the first); rows that share a
doc_id share the next one, and as a next document they are represented by the one whose text is least; a null
doc_id is the lowest; a lone document is its own next one. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shuffle_partitions

K, S, LEAST, SHARE = 16, 8, 512, 1.0
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams, for n a power of two: each doubling joins two halves."""
    h, have = codes, 1
    while have < n:
        h = _mixed(h[:-have] * _BASE + h[have:])
        have *= 2
    return h


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all closed syncmers of a text, by position. k and s are powers of two."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < k:
        whole = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "little")
        return np.array([whole] * bool(text), np.uint64), np.zeros(int(bool(text)), np.int64)
    inner = _grams(_mixed(codes + _BASE), s)
    window = k - s + 1
    least, have = inner, 1
    while have * 2 <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[: len(inner) - window + 1], least[window - have :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[window - 1 :] == least))
    # The k-mer's own hash, from its inner s-mers' that tile it.
    outer = inner[at]
    for j in range(s, k, s):
        outer = _mixed(outer * _BASE + inner[at + j])
    return outer, at


def fingerprint(text: str | None, k: int = K, s: int = S, least: int = LEAST, share: float = SHARE) -> str:
    """Base64 of 32-bit numbers: the highest hash up to which it is complete, the hashes, and their first positions."""
    h, at = anchors(text or "", k, s)
    if not len(h):
        return ""
    hashes, first = np.unique(h >> np.uint64(32), return_index=True)
    bound = 2**32 - 1
    if len(hashes) > least:
        bound = max(int(hashes[least - 1]), int(share * 2**32) - 1)
        n = int(np.searchsorted(hashes, bound, side="right"))
        hashes, first = hashes[:n], first[:n]
    return base64.b64encode(np.concatenate([[bound], hashes, at[first]]).astype("<u4").tobytes()).decode()


def likeness(one: str, other: str) -> float:
    """0 to 1: Dice's share of the hashes up to the lower bound that match in the same order."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    (a, h, p), (b, g, q) = ((int(x[0]), *x[1:].reshape(2, -1)) for x in (np.frombuffer(base64.b64decode(y), "<u4").astype(np.int64) for y in (one, other)))
    h, g = (x[: np.searchsorted(x, min(a, b), side="right")] for x in (h, g))
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    order = np.lexsort((-q[j], p[i]))
    chain: list[int] = []
    for to in q[j][order].tolist():
        if not chain or to > chain[-1]:
            chain.append(to)
        else:
            chain[bisect_left(chain, to)] = to
    return 2 * len(chain) / (len(h) + len(g))


def with_next(docs: DataFrame, extra) -> DataFrame:
    """Every row of (doc_id, text) goes, in ascending order within a bucket of ids, through `extra(rows)`.

    Buckets are ranges of doc_id. The row before a bucket's first one, in ascending order, is the last one of
    the bucket below, so a bucket's last row is sent to the next one too. One shuffle of the texts; no more
    than one id for each bucket comes to the driver.
    """
    spark = docs.sparkSession
    n = 2 * shuffle_partitions(spark)
    found = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    splits = [int(x) for x in sorted(set(found or ()))]
    bucket = _below(splits, F.col("doc_id"))
    tops = {r.bucket: r.top for r in docs.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    # The highest id precedes all others, as the next document after the last is the first.
    to = dict(zip(used, [*used[1:], used[0]], strict=True)) if used else {}
    filled = range(len(splits) + 1)
    top, goes = _longs([tops.get(i) for i in filled]), _longs([to.get(i) for i in filled])
    keyed = docs.select("doc_id", "text", bucket.alias("bucket"))
    index = F.col("bucket") + 1
    guest = F.when(F.col("doc_id").eqNullSafe(F.element_at(top, index)), F.struct(F.element_at(goes, index).alias("bucket"), F.lit(0).alias("own")))
    sent = keyed.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct(F.col("bucket").cast("long").alias("bucket"), F.lit(1).alias("own")), guest))).alias("to"))
    sent = sent.select("doc_id", "text", "to.bucket", "to.own")
    return extra(sent.repartition(n, "bucket").sortWithinPartitions("bucket", "own", "doc_id", "text"))


def _longs(values: list[int | None]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _below(splits: list[int], value):
    """How many of the sorted `splits` lie below `value`, by a search in two steps; 0 for null."""
    if not splits:
        return F.when(value.isNull(), 0).otherwise(0)
    step = max(1, int(len(splits) ** 0.5))
    parts = [splits[i : i + step] for i in range(0, len(splits), step)]
    part = F.size(F.filter(_longs([p[0] for p in parts]), lambda x: x < value))
    inside = F.size(F.filter(F.element_at(F.array(*map(_longs, parts)), part), lambda x: x < value))
    return F.when(value.isNull() | (part == 0), 0).otherwise((part - 1) * step + inside)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, *, k: int = K, s: int = S, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, current, before = None, None, None  # current: (own, id), text, fingerprint; before: of the last lower id
        for batch in batches:
            rows = []
            for doc_id, text, to, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if to != bucket:
                    bucket, current, before = to, None, None
                mark = None
                if current is None or current[0] != (own, doc_id):
                    mark = fingerprint(text, k, s, least, share)
                    before, current = current, ((own, doc_id), text, mark)
                if not own:
                    continue
                if mark is None:
                    mark = current[2] if text == current[1] else fingerprint(text, k, s, least, share)
                following = before or current
                changed = edited(text, following[1])
                other = fingerprint(changed, k, s, least, share)
                rows.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, following[2])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select("doc_id", "text"), lambda rows: rows.mapInArrow(run, schema))


def fingerprints(docs: DataFrame, *, k: int = K, s: int = S, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(v.as_py(), k, s, least, share) for v in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")
