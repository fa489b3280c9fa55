"""Best-two-fit packing of token sequences.

Only lengths matter to packing, and there are at most `capacity` of them, so the plan is made on the table of
counts by length: bounded whatever the input. A bin is filled greedily, longest piece first; then its smallest
piece is replaced by the two unpacked pieces that fill its expanded gap best, if they fill it better than that
piece did. The same pattern is repeated for as many bins as the counts allow, then the next is sought.
Documents get their places by their rank among the pieces of their length; ranks come from per-bucket counts,
so no length is ranked in one task.

Defined results: null and empty texts have no ids and give no piece; documents longer than the capacity are
cut in whole capacities, the last piece may be shorter; every row is packed by itself, repeated or not; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, cut, join_counted, slices
from lodestone.llm.tokens import load

CAPACITY = 2048
#: Buckets in which the pieces of one length are ranked.
BUCKETS = 64

#: Words that a task remembers, and characters of the longest that it remembers.
REMEMBERED_WORDS = 200_000
REMEMBERED_CHARS = 64

_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
#: The pre-tokenizer parts these from a plain word before them, and keeps them together.
_MARKS = ".,;:!?#$%&*|()"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def letter_pieces(tokenizer) -> dict[int, str] | None:
    """What the library makes of each letter of a plain word before its model sees it.

    None if the model doesn't get plain words whole, letter by letter, capital letters as small ones.
    """
    def seen(text: str) -> str | None:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        got = tokenizer.pre_tokenizer.pre_tokenize_str(text) if tokenizer.pre_tokenizer else []
        return got[0][0] if len(got) == 1 else None

    table = {ord(c): seen(c) for c in _LETTERS}
    small = pc.utf8_lower(_LETTERS).as_py()
    if None in table.values() or _LETTERS.translate(table) != small.translate(table) or seen(_LETTERS) != small.translate(table):
        return None
    ids = [t.id for t in tokenizer.model.tokenize(small.translate(table))]
    return table if ids == tokenizer.encode(_LETTERS, add_special_tokens=False).ids else None


class _Places(dict):
    """Places of words in the table of ids; a new word gets the next place and is noted."""

    def __init__(self, words: Iterable[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Ids of one task's texts, each followed by `end`.

    The word tokenizer never joins what white space parts, so each distinct word of the texts is encoded once, and its
    ids stand in a table. Plain words are kept in small letters, without the marks behind them. When the table has more
    than `most` words, the half of them that most calls asked for stays.
    """

    def __init__(self, path: str, end: tuple[int, ...] = (), most: int = REMEMBERED_WORDS, longest: int = REMEMBERED_CHARS):
        self.tokenizer, self.end, self.most, self.longest = load(path), np.asarray(end, "<u4"), most, longest
        self.model, self.letters = self.tokenizer.model, letter_pieces(self.tokenizer)
        # The empty word has place 0 and no ids.
        self.places, self.table = _Places([""]), np.zeros(0, "<u4")
        self.starts, self.sizes, self.uses = np.zeros((3, 1), np.int64)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode(pa.array([text], pa.string()))[0].tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        last = pc.list_value_length(split).to_numpy().cumsum(dtype=np.int64)
        sizes = np.append(sizes, len(self.end))
        starts = sizes.cumsum() - sizes
        ids, ends = _taken(np.concatenate([ids, self.end]), starts, sizes, np.insert(words.indices.to_numpy(), last, len(sizes) - 1))
        return ids, ends[last + np.arange(len(last))]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one behind the other, and how many each has."""
        if not len(words):
            return self.table[:0], self.sizes[:0]
        base = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.match_substring_regex(base, f"^{_PLAIN.pattern}$"), self.letters is not None)
        marks = pc.utf8_ltrim(words, characters=_LETTERS)
        parts = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(base), words), pc.if_else(plain, marks, "")]).dictionary_encode()
        places = np.fromiter(map(self.places.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(parts.dictionary))
        if self.places.new:
            self._learn()
        self.uses[places] += 1
        ids, ends = _taken(self.table, self.starts, self.sizes, places[parts.indices.to_numpy()].reshape(2, -1).T.ravel())
        if len(self.places) > self.most:
            self._forget()
        return ids, np.diff(ends[1::2], prepend=0)

    def _learn(self) -> None:
        """Plain words go to the model as the library would hand them to it, the others to the whole tokenizer."""
        new, self.places.new = self.places.new, []
        plain = [w for w in new if self.letters and (w.isascii() and w.isalpha() or _PLAIN.fullmatch(w))]
        known = set(plain)
        rest = [w for w in new if w not in known]
        ids, sizes = [], []
        for piece in "\n".join(plain).translate(self.letters).split("\n") if plain else ():
            tokens = self.model.tokenize(piece)
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
        for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            ids += e.ids
            sizes.append(len(e.ids))
        at = np.fromiter(map(self.places.__getitem__, plain + rest), np.int64, len(new))
        sizes = np.asarray(sizes, np.int64)
        self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.starts, self.sizes, self.uses))
        self.starts[at], self.sizes[at] = len(self.table) + sizes.cumsum() - sizes, sizes
        self.table = np.concatenate([self.table, np.asarray(ids, "<u4")])

    def _forget(self) -> None:
        words = list(self.places)
        often = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        keep = [0, *(i for i in often.tolist() if i and self.uses[i] > 1 and len(words[i]) <= self.longest)]
        self.table, ends = _taken(self.table, self.starts, self.sizes, np.array(keep))
        self.places, self.uses, self.sizes = _Places(words[i] for i in keep), self.uses[keep] // 2, self.sizes[keep]
        self.starts = ends - self.sizes


def _taken(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands in the table at the places, and where that of each place ends."""
    own = sizes[places]
    ends = own.cumsum()
    return table[np.arange(own.sum()) + np.repeat(starts[places] - ends + own, own)], ends


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) rows as pieces: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, (end_id,))  # of this task: a worker goes on to other work
        for rows in slices(batches, 1):
            ids, ends = encoder.encode(rows.column(1))
            sizes = np.diff(ends, prepend=0)
            cuts = -(-sizes // capacity)
            took = np.repeat(np.arange(len(sizes)), cuts)
            k = np.arange(len(took)) - np.repeat(cuts.cumsum() - cuts, cuts)
            start = k * capacity
            length = np.minimum(sizes[took] - start, capacity)
            bounds, raw = np.concatenate([[0], length.cumsum()]), memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(bounds.tolist())]
            arrays = [rows.column(0).take(pa.array(took)), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype("i4"))))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Patterns of bins by best-two-fit: (first bin, number of bins, lengths in the bin, longest first)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns, first = [], 0
    while left.any():
        own = np.zeros_like(left)  # what the bin under way holds
        gap, lengths = capacity, []
        while True:
            fit = np.flatnonzero((left - own)[: gap + 1] > 0)
            if not len(fit):
                break
            # As many of the longest as fit, though at most as many as there are.
            longest = int(fit[-1])
            n = min(gap // longest, int(left[longest] - own[longest]))
            own[longest] += n
            gap -= n * longest
            lengths += [longest] * n
        if gap and len(lengths) > 1:
            smallest = lengths[-1]
            own[smallest] -= 1
            room = gap + smallest
            pair = best_two(left - own, room)
            if pair and sum(pair) > smallest:
                own[pair[0]] += 1
                own[pair[1]] += 1
                lengths[-1:] = pair
            else:
                own[smallest] += 1
        held = np.flatnonzero(own)
        times = int((left[held] // own[held]).min())
        left[held] -= times * own[held]
        patterns.append((first, times, sorted(lengths, reverse=True)))
        first += times
    return patterns


def best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked lengths whose sum is the largest up to `room`."""
    have = np.flatnonzero(left[: room + 1] > 0)
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1  # the largest partner of each
    other = have[np.maximum(at, 0)]
    good = (at >= 0) & ((other != have) | (left[have] > 1))
    # A length that is there once can't be its own partner; the next smaller one is.
    alone = (at > 0) & ~good
    other, good = np.where(alone, have[np.maximum(at - 1, 0)], other), good | alone
    if not good.any():
        return None
    total = np.where(good, have + other, -1)
    k = int(total.argmax())
    return [int(have[k]), int(other[k])]


def slots(patterns: list[tuple[int, int, list[int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, in rank order: (ranks before, first bin, offset in the bin)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for first, times, lengths in patterns:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((ranks.get(length, 0), first, offset))
            ranks[length] = ranks.get(length, 0) + times
            offset += length
    return found


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs` with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return place(cut(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pack-pieces"), capacity)


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    spark, names = cut_pieces.sparkSession, [c for c in cut_pieces.columns if c != "length"]
    bucketed = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity x BUCKETS rows, whatever the input.
    offsets = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    found = slots(plan({r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    ranks = {length: np.array([s[0] for s in own]) for length, own in found.items()}
    places = {length: np.array([s[1:] for s in own]) for length, own in found.items()}
    ranked = join_counted(bucketed, offsets.select("length", "bucket", "before"), ["length", "bucket"], rows=max(BROADCAST_ROWS, CAPACITY * BUCKETS))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(order) - 1).select(*names, "length", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros((2, len(length)), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                at = np.searchsorted(ranks[n], rank[own], side="right") - 1
                out[0, own] = places[n][at, 0] + rank[own] - ranks[n][at]
                out[1, own] = places[n][at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out[0]), pa.array(out[1])], [*names, "length", "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in cut_pieces.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*names, "length"]) + ", sequence_id long, offset long"
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(run, schema).select(*wanted, *[c for c in names if c not in wanted])
