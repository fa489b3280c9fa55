"""Whitening of vectors by principal components, found by cyclic Jacobi rotations.

1. Tasks sum up the whole numbers x = floor(1024 * c) + 100000 of each dimension, exactly.
2. Tasks sum the products of centred entries, (n * x - S) / n with a whole numerator, into the covariance.
3. The driver turns the covariance by Jacobi rotations, in rounds that pair each dimension with each other one once a
   sweep, until no entry off the diagonal counts beside the roots of its two diagonal ones. That test is relative, so
   small eigenvalues come out as accurately as large ones.
4. The components, sorted by falling eigenvalue and divided by its root, go to all tasks.

What is kept in one place is a matrix of d x d numbers for each length d of vectors that occurs; models give few lengths.

Defined results: vectors that are null or hold null or non-finite entries take no part; a null id is kept as it
is; vectors of unequal lengths are fitted and whitened apart, each length as a table of its own; empty vectors have no
components and give no rows; equal rows count each time. Entries whose floor is beyond 2^62 count as that. A
component's sign makes its largest entry positive. Where a component has no variance (one vector, or fewer vectors
than dimensions), `whitened` is null, and it takes no part in `identity_error`, which is null where no component has
variance; without any variance at all `explained` is null. A `deviation` that no long holds is null. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

SCALE, SHIFT, MOST = 1024, 100_000, 2**62
EPS = float(np.finfo(float).eps)


@dataclass
class Fit:
    """What is known of the vectors of one length: how many, exact sums, falling eigenvalues and their components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self, most: int) -> np.ndarray:
        """The first components over the roots of their eigenvalues, as columns; NaN where there is no variance."""
        values = self.values[:most]
        root = np.where(values > len(self.values) * EPS * self.values[0], np.sqrt(np.maximum(values, 0)), np.nan)
        return self.vectors[:, :most] / root

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: whole numbers of 64 bits where they fit, else of any size."""
        if self.n * (float(np.abs(x.astype(float)).max(initial=0)) + SHIFT) >= MOST / 2:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.where(F.col("embedding").isNotNull()).where(~bad & (F.size("embedding") > 0))


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, whole numbers of these rows) for each length of vectors in a batch of (vec_id, embedding)."""
    column = batch.column(1)
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, whole(values[starts[rows][:, None] + np.arange(d)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of vectors and sum of each dimension, by length."""
    found: dict[int, list] = {}
    for batch in batches:
        for d, _, x in by_length(batch):
            safe = float(np.abs(x.astype(float)).max()) * len(x) < MOST
            n, sums = found.setdefault(d, [0, [0] * d])
            found[d] = [n + len(x), [a + int(b) for a, b in zip(sums, (x if safe else x.astype(object)).sum(axis=0), strict=True)]]
    rows = [(d, i, n, Decimal(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["d", "i", "n", "s"])


def _scattered(means: dict[int, Fit]):
    """A task's sums of products of centred entries (the upper triangle), by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                c = means[d].centred(x)
                found[d] = found.get(d, 0.0) + c.T @ c
        for d, m in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["d", "i", "j", "v"])

    return run


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix.

    A sweep is d - 1 rounds; the pairs of a round share no dimension, so they are turned at once.
    """
    a, d = np.array(matrix, float), len(matrix)
    v, floor = np.eye(d), EPS**2 * float(np.trace(np.abs(matrix)))
    seats = np.arange(d + d % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            one, two = seats[:half], seats[half:][::-1]
            p, q = np.minimum(one, two), np.maximum(one, two)
            p, q = p[q < d], q[q < d]
            off = np.abs(a[p, q]) > np.maximum(EPS * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            p, q = p[off], q[off]
            if len(p):
                turned = True
                tau = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
                a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
                a[p, q] = a[q, p] = 0.0
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], v[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(d)] < 0, -1.0, 1.0)


def fit(vectors: DataFrame) -> dict[int, Fit]:
    """The fit of all usable rows of `vectors` (vec_id, embedding), for each length of vectors."""
    rows, found = usable(vectors), {}
    sums = rows.mapInArrow(_summed, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # As many rows as dimensions, for each length.
    for r in sums.orderBy("d", "i").collect():
        own = found.setdefault(r.d, Fit(r.n, [], np.empty(0), np.empty(0), 0.0))
        own.sums.append(int(r.s))
    if found:
        products = rows.mapInArrow(_scattered(dict(found)), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
        matrices = {d: np.zeros((d, d)) for d in found}
        for r in products.collect():
            matrices[r.d][r.i, r.j] = matrices[r.d][r.j, r.i] = r.v / found[r.d].n
        for d, own in found.items():
            own.values, own.vectors = jacobi(matrices[d])
            own.trace = float(np.trace(matrices[d]))
    return found


def apply(vectors: DataFrame, fits: dict[int, Fit], components: int) -> DataFrame:
    """(vec_id, d, deviation, z) of all usable rows: the exact squared deviation and the whitened entries."""
    matrices = {d: f.matrix(components) for d, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_length(batch):
                off = fits[d].deviations(x)
                if off.dtype != object and float(np.abs(off.astype(float)).max()) ** 2 * d >= MOST:
                    off = off.astype(object)
                squares = [s if s < 2**63 else None for s in map(int, (off * off).sum(axis=1))]
                z = fits[d].centred(x) @ matrices[d]
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(z), d, np.int32)), pa.array(squares, pa.int64()), lists], ["vec_id", "d", "deviation", "z"])

    return usable(vectors).mapInArrow(run, "vec_id long, d int, deviation long, z array<double>")


def identity_errors(whitened: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """The largest absolute entry of the whitened entries' covariance less the identity, for each length."""
    most = max(min(d, components) for d in fits)
    entry = [F.get("z", F.lit(i)) for i in range(most)]
    means = {r.d: r for r in whitened.groupBy("d").agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(entry)]).collect()}
    found: dict[int, float | None] = {}
    for d, r in means.items():
        live = [i for i in range(min(d, components)) if r[f"m{i}"] is not None]
        pairs = [(i, j) for i in live for j in live if i <= j]
        sums = [F.avg((entry[i] - r[f"m{i}"]) * (entry[j] - r[f"m{j}"])) for i, j in pairs]
        row = whitened.where(F.col("d") == d).agg(*sums).first() if sums else ()
        found[d] = max((abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True)), default=None)
    return found


def whiten(vectors: DataFrame, *, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component up to `components`."""
    spark, fits = vectors.sparkSession, fit(vectors)
    schema = "d int, component int, n long, explained double, identity_error double"
    if not fits:
        facts = spark.createDataFrame([], schema)
        done = apply(vectors, fits, components)
    else:
        done = cut(apply(vectors, fits, components), "whitened")
        errors = identity_errors(done, fits, components)
        rows = [(d, k + 1, f.n, float(f.values[k]) / f.trace if f.trace > 0 else None, errors[d]) for d, f in fits.items() for k in range(min(d, components))]
        facts = spark.createDataFrame(rows, schema)
    long = done.select("vec_id", "d", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    # At most `components` rows for each length of vectors.
    return long.join(F.broadcast(facts), ["d", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
