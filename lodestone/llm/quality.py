"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are binned by their quantiles in the training rows; trees are grown on histograms of gradients and
are flattened into arrays, which a task walks for all rows of a batch at once, one level at a time.

The trees are fitted on a bounded sample of labelled rows (`sample_rows`, the rows whose hashed ids are the
smallest). Labels, language, source and ids are no inputs of a score.

Defined results: null texts count as empty; empty texts get a score; a row with a null id is not held out;
rows that repeat are scored alike; labels that are null or not 0 or 1 are ignored, and without any labels of
both kinds every score is the share of label 1 (0.5 if there are none); other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

#: Most rows that the trees are fitted on.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs",
    "upper", "digits", "symbols", "marks", "stops", "spaces", "other_bytes", "capital_words", "shouted_words",
    "marked_words", "symbol_words", "mean_line", "repeated_lines", "lines_per_word", "sentence_words", "compressed", "longest_word",
)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:"
_MARKS = b"!?"
_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _STOPS + _MARKS)


def _compressed(raw: bytes, piece: int = 1 << 20) -> int:
    """Length of the whole of `raw` compressed; what comes out is counted piece by piece and not kept."""
    packer = zlib.compressobj(1)
    return sum(len(packer.compress(raw[i : i + piece])) for i in range(0, len(raw), piece)) + len(packer.flush())


def statistics(text: str | None) -> list[float]:
    """The document statistics named in STATISTICS, over the whole text."""
    text = text or ""
    raw = text.encode()
    n_bytes, n_chars, words, lines = max(1, len(raw)), len(text), text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / n_bytes

    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False)))
    distinct = counts.keys()
    ends = Counter([w[-1] for w in words])
    starts = Counter([w[0] for w in words])
    capital = sum(k for c, k in starts.items() if c.isupper())
    shouted = sum(counts[w] for w in distinct if len(w) > 1 and w.isupper())
    marked = sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,;:")
    symbol = sum(counts[w] for w in distinct if not w[0].isalnum() or not w[-1].isalnum() and w[-1] not in ".,;:!?")
    sentences = ends["."] + ends["!"] + ends["?"]
    return [
        math.log1p(n_chars), math.log1p(len(words)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes <= 3).mean()),
        len(counts) / n ** 0.8, max(counts.values(), default=0) / n, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), share(_STOPS), share(_SPACES), (n_bytes - n_chars) / n_bytes if raw else 0.0,
        capital / n, shouted / n, marked / n, symbol / n, math.log1p(n_chars / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n,
        len(words) / (1 + sentences), _compressed(raw) / n_bytes, math.log1p(int(sizes.max())),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is a node whose children are itself."""

    edges: list[np.ndarray]
    base: float
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x) if len(self.roots) else 0, step):
            bins = self.binned(x[at : at + step])
            node, row = np.repeat(self.roots[None], len(bins), 0), np.arange(len(bins))[:, None]
            for _ in range(self.depth):
                node = np.where(bins[row, self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
            out[at : at + step] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, smooth: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, each grown level by level on gradient histograms."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        none = np.zeros(0, np.int64)
        return Trees([np.zeros(0)] * x.shape[1], math.log(share / (1 - share)), none, none, none, none, none, np.zeros(0), 0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = y.mean()
    trees = Trees(edges, math.log(share / (1 - share)), *[np.zeros(0, np.int64)] * 5, np.zeros(0), depth)
    b, (n, m) = trees.binned(x), x.shape
    flat = b.astype(np.int64) + np.arange(m) * bins
    raw = np.full(n, trees.base)
    roots, feature, split, left, right, value = [], [], [], [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = len(feature)
        roots.append(root)
        level, node = [root], np.full(n, root)
        for c in (feature, split):
            c.append(0)
        left.append(root), right.append(root), value.append(-g.sum() / (h.sum() + smooth) * rate)
        for _ in range(depth):
            place = np.full(len(feature), -1)
            place[level] = np.arange(len(level))
            own = place[node]
            rows = np.flatnonzero(own >= 0)
            at = (own[rows, None] * (m * bins) + flat[rows]).ravel()
            shape = (len(level), m, bins)
            size = shape[0] * m * bins
            hg, hh, hn = (np.bincount(at, np.repeat(w[rows], m), size).reshape(shape).cumsum(axis=2) for w in (g, h, np.ones(n)))
            tg, th, tn = hg[:, :1, -1:], hh[:, :1, -1:], hn[:, :1, -1:]
            gain = hg**2 / (hh + smooth) + (tg - hg) ** 2 / (th - hh + smooth) - tg**2 / (th + smooth)
            gain[(hn < least) | (tn - hn < least)] = -1
            best, deeper = gain.reshape(len(level), -1).argmax(axis=1), []
            for k, parent in enumerate(level):
                j, s = divmod(int(best[k]), bins)
                if gain[k, j, s] <= 1e-6:
                    continue
                feature[parent], split[parent] = j, s
                for gg, hh_, side in ((hg[k, j, s], hh[k, j, s], left), (tg[k, 0, 0] - hg[k, j, s], th[k, 0, 0] - hh[k, j, s], right)):
                    child = len(feature)
                    side[parent] = child
                    feature.append(0), split.append(0), left.append(child), right.append(child), value.append(-gg / (hh_ + smooth) * rate)
                    deeper.append(child)
            f, s, lo, hi = map(np.array, (feature, split, left, right))
            node = np.where(b[np.arange(n), f[node]] <= s[node], lo[node], hi[node])
            level = deeper
            if not level:
                break
        raw += np.array(value)[node]
    trees.roots, trees.feature, trees.bin, trees.left, trees.right = (np.array(c, np.int64) for c in (roots, feature, split, left, right))
    trees.value = np.array(value)
    return trees


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _statistics_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            stats = pa.array([statistics(v.as_py()) for v in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], stats], [*keep, "stats"])

    return rows.select("text", *keep).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", stats array<double>")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Trees fitted on at most `sample_rows` labelled rows that are not held out."""
    wanted = labels.select(F.col("doc_id").alias("_q_id"), F.col(label).cast("int").alias("_q_label")).where("_q_label in (0, 1) and _q_id is not null").where(~held_out(F.col("_q_id")))
    # The smallest hashes: the same rows in every run, and no more than the bound, which is what makes the broadcast safe.
    wanted = wanted.orderBy(F.xxhash64("_q_id", F.lit(7)), "_q_id", "_q_label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_q_id"))
    got = _statistics_of(rows, ["doc_id", "_q_label"]).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "stats").limit(2 * sample_rows).collect()
    x = np.array([r.stats for r in got], float).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r._q_label for r in got], float), **options)


def score(docs: DataFrame, trees: Trees, *, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` of every row, score and predicted."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = np.array([statistics(v.as_py()) for v in batch.column("text")], float).reshape(batch.num_rows, len(STATISTICS))
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    wanted = dict.fromkeys(["text", *keep])
    return docs.select(*wanted).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text)."""
    out = score(docs, train(docs, labels, **options), threshold=threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their columns."""
    columns = docs.columns
    # So that no column of docs clashes with those of a score; the text keeps its name and goes to the tasks once.
    at = columns.index("text")
    names = ["text" if i == at else f"_q{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    kept = score(plain, train(docs, labels, **options), threshold=threshold, keep=tuple(names)).where("predicted = 1")
    return kept.select(*names).toDF(*columns)
