"""N-gram Jaccard join by prefixes under several global token orders.

A document is the set of its distinct word shingles. Documents that link share a shingle within their prefixes
(the first n - ceil(t n) + 1 shingles) under any one order of all shingles, so candidates have to share one under
each of several orders before they are verified. All orders put shingles that many documents hold last, by counts
over the whole corpus, and differ in how they rank the rest.

1. Texts whose words are the same form a class; one representative stands for it.
2. A class posts its prefix under the first order and all its shingles of low rank. Postings are dealt by shingle
   (by class as well for shingles that very many documents hold); those that only one class holds go at once. Up to
   the rank that the postings of both of two classes reach, a shingle that no other class posts is one that the other
   doesn't have. With too many of these between them they can't link.
3. In each shingle's group the members are held against one hub only, the member with the least share of such
   shingles, which is what the others were copied from or close to it. What links is joined into preliminary
   components, so that a large group of near copies costs as many pairs as it has members.
4. Members of a large group that are in different components then try a few partners each, some from the group's
   largest component and some from anywhere in it, in rounds that go on while they join components. Among near
   copies of one text nearly all are one component after this, so few pairs are left between components.
5. Between members of different components every pair is a candidate that lengths, shingles without a match,
   and the measured overlaps of both with their group's hub don't rule out: two sets share of the hub at most what neither
   lacks, and besides it what can be common to their rests, by bitmaps of both. So no link between components is lost, and links inside one
   can't change it.
6. Counting sketches bound what the sets of a candidate can share: bucket by bucket the smaller count. Texts are
   fetched for the pairs that pass; these must also share a prefix shingle under the other orders; then the sets
   are compared.

Defined results: letters A to Z are lower-cased, words are parted by ASCII white space; texts of fewer words than
a shingle has are one shingle; null texts and texts without words have no shingles, link with nothing and are
components of their own; rows that repeat are copies; rows that share an id are one node, whatever their texts; rows
without an id link with nothing and have no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, SPACE, WORD, cut, join_counted, scratch, slices, small_batches
from lodestone.llm.components import components

WORDS = 5
#: Similarity as a ratio of whole numbers.
SIMILAR = (80, 100)
ORDERS = 3
#: Shingles that are counted before a task hands on those it met often.
COUNTED = 3_000_000
#: Most shingles whose counts are sent to all tasks. It bounds a broadcast of 8 MB each for ids and ranks; which
#: shingles are in it only ranks them, and any order gives the same links.
FREQUENT = 1_000_000
_OFTEN = 4
#: Shares of the range of ranks. Infrequent shingles below the first are all posted; up to which of the others
#: its prefix reaches is kept for each class.
REACHES = (1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
#: Postings of shingles that were counted at least 2 to this power times are dealt by class as well.
HOT = 13
#: Bits that hold a share of a class's size, rounded down.
_BITS, _FULL = 12, 4095
#: Rows of two numbers that may be broadcast: some 100 MB in a task's memory.
_IDS = 1_000_000
#: Pairs up to which texts are fetched at once, without sketches before.
_UNSIFTED = 20_000
#: Texts or sketches for each of the tasks that write those of few pairs, and fewest tasks.
_TEXTS, _TASKS = 5_000, 8
#: Shingles of the corpus, and pairs, for each of the tasks that a step's tables are written in at most.
_SHINGLES, _PAIRS = 250_000, 2_000
#: Members from which on a group's pairs are bounded by measured overlaps with its hub, and its members try partners.
CROWDED = 12
#: Most rounds of trials; what they leave apart is compared pair by pair.
TRIALS = 4
#: Rounds end when fewer than one in so many trials join two components.
YIELD = 50
#: Buckets (a power of two) of the bitmaps that keep what of a hub's shingles a member lacks, and what it has besides.
BUCKETS = 256
#: Buckets of a class's counting sketch.
SKETCH = 512

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_rng = np.random.default_rng(5)
_TABLE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, np.uint64)
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the radix and of its inverse, modulo 2^64."""
    while len(_powers[0]) < n:
        have = len(_powers[0])
        for i, r in enumerate((_RADIX, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(r, have, 1 << 64))])
    return _powers


def shingles(raws: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each lower-cased text."""
    joined = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    up, down = _grown(len(joined))
    white = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[joined] * up[: len(joined)], dtype=np.uint64)])
    word = _mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raws]))
    n = len(word)
    if n >= words:
        grams = word[: n - words + 1] * _PLACES[0]
        for i in range(1, words):
            grams = grams + word[i : n - words + 1 + i] * _PLACES[i]
        grams = _mixed(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n, similar: tuple[int, int] = SIMILAR):
    return n - (similar[0] * n + similar[1] - 1) // similar[1] + 1


def ranks(tokens: np.ndarray, order: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for each shingle by which the order sorts: frequent ones last, by their counts' magnitudes."""
    own = _mixed(tokens ^ _PLACES[40 + order]) >> np.uint64(1) if order else tokens >> np.uint64(1)
    ids, levels = frequent
    if len(ids):
        at = np.minimum(np.searchsorted(ids, tokens), len(ids) - 1)
        hit = ids[at] == tokens
        own[hit] = np.uint64(1 << 63) | (levels[at[hit]] << np.uint64(56)) | (own[hit] >> np.uint64(8))
    return own


def prefix(tokens: np.ndarray, order: int, frequent, similar=SIMILAR) -> np.ndarray:
    """The prefix shingles in their order."""
    p = prefix_length(len(tokens), similar)
    own = ranks(tokens, order, frequent)
    first = np.argpartition(own, p - 1)[:p] if p < len(own) else np.arange(len(own))
    return tokens[first[np.argsort(own[first])]]


def _key(raw: bytes) -> tuple[int, int]:
    """128 bits of the words' sequence."""
    digest = hashlib.md5(b" ".join(raw.split())).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _raws(column: pa.Array) -> list[bytes]:
    return [(v.as_py() or "").encode().lower() for v in column]


def _parts(raws: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about so many bytes."""
    at, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(raws):
        yield at, len(raws)


def _longs(*columns, names: list[str]) -> pa.RecordBatch:
    signed = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(signed, names)


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows (kind 0, doc_id, hi, lo, n) of all documents, and (kind 1, null, shingle, 0, count) of shingles a task met often."""
    names = ["kind", "doc_id", "hi", "lo", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set = set()

        def met_often() -> pa.RecordBatch:
            # Sorted in place: one that stands `_OFTEN` places apart from itself was met so often.
            ids = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            ids.sort()
            first = ids[: max(0, len(ids) - _OFTEN + 1)]
            often = np.unique(first[first == ids[_OFTEN - 1 :]])
            n = np.searchsorted(ids, often, side="right") - np.searchsorted(ids, often, side="left")
            return _longs(np.ones(len(often), np.int64), pa.nulls(len(often), pa.int64()), often, np.zeros(len(often), np.int64), n, names=names)

        for batch in slices(batches, 1):
            raws = _raws(batch.column(1))
            for a, b in _parts(raws):
                keys = [_key(r) for r in raws[a:b]]
                sets = shingles(raws[a:b], words)
                for k, s in zip(keys, sets, strict=True):
                    if k not in seen:
                        seen.add(k)
                        held.append(s)
                yield _longs(np.zeros(b - a, np.int64), batch.column(0)[a:b], [k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets], names=names)
                if sum(map(len, held)) > COUNTED:
                    yield met_often()
                    seen.clear()
        yield met_often()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind long, doc_id long, hi long, lo long, n long")


def _postings(docs: DataFrame, frequent, words: int, similar, hot_level: int = HOT) -> DataFrame:
    """(token, cls, facts) of prefixes and low shingles under the first order; copies within a batch once.

    `facts` is the class's size, the magnitude of the shingle's count, whether it is hot, and the number of reaches that lie below its rank. One
    more row for each class, with itself as token and facts below 0, holds how many reaches its postings cover, and
    which share of its shingles lies below each.
    """
    names, cuts = ["token", "cls", "facts"], np.array([int(r * 2**63) for r in REACHES], np.uint64)
    shifts = np.arange(len(REACHES)) * _BITS + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in slices(batches, 0):
            raws = _raws(batch.column(0))
            for a, b in _parts(raws):
                rows: list[tuple] = []
                keys = [_key(r)[1] for r in raws[a:b]]
                for c, s in zip(keys, shingles(raws[a:b], words), strict=True):
                    if c in known or not len(s):
                        continue
                    known.add(c)
                    own, p = ranks(s, 0, frequent.value), prefix_length(len(s), similar)
                    last = np.partition(own, p - 1)[p - 1]
                    chosen = (own <= last) | (own < cuts[0])
                    tokens, own = s[chosen], own[chosen]
                    level = np.searchsorted(cuts, own, side="right")
                    hot = own >= np.uint64(hot_level << 56 | 1 << 63)
                    below = np.bincount(level, minlength=len(cuts) + 1)[: len(cuts)].cumsum() * _FULL // len(s)
                    covered = max(1, int(np.searchsorted(cuts, last, side="right")))
                    about = ~(np.bitwise_or.reduce(below << shifts) | covered)
                    often = np.where(own >> np.uint64(63), own >> np.uint64(56) & np.uint64(63), np.uint64(0)).astype(np.int64)
                    rows.append((np.append(tokens.view(np.int64), c), np.full(len(own) + 1, c), np.append(len(s) << 14 | often << 8 | hot << 4 | level, about)))
                if len(known) > 100_000:
                    known.clear()
                if rows:
                    yield _longs(*map(np.concatenate, zip(*rows, strict=True)), names=names)

    return docs.select("text").mapInArrow(run, "token long, cls long, facts long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token and class: one of each class for the tokens that several classes hold or that are hot, and the classes' own rows."""
    names = ["token", "cls", "facts"]
    held = None  # the last row so far, and whether it was handed on
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held:
            columns = [np.concatenate([[h], c]) for h, c in zip(held[0], columns, strict=True)]
        token, cls, facts = columns
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        copy = np.zeros(len(token), bool)
        copy[1:] = same & (cls[1:] == cls[:-1])
        fresh = np.flatnonzero(~copy)
        first = token[fresh]
        grouped = (facts[fresh] < 0) | ((facts[fresh] & 16) > 0)
        grouped[1:] |= first[1:] == first[:-1]
        grouped[:-1] |= first[1:] == first[:-1]
        out = fresh[grouped]
        if held and held[1] and len(out) and out[0] == 0:
            out = out[1:]
        # Rows of the group under way come with the next batch's first row, which is the last of this one.
        last = fresh[-1]
        held = ([c[last] for c in columns], bool(grouped[-1]) or bool(held and held[1] and last == 0))
        if len(out):
            yield _longs(*[c[out] for c in columns], names=names)


def _verified(pairs: DataFrame, texts: DataFrame, frequent, words: int, similar, orders: int, n_pairs: int) -> DataFrame:
    """The (a, b) pairs of classes with their representatives, how much they share, whether they link, and by bucket which of a's shingles b lacks and which it has besides."""
    names = ["a", "b", "rep_a", "rep_b", "shared", "linked", "lacks", "extras"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in slices(batches, 4, 5):
            one, other = _raws(batch.column(4)), _raws(batch.column(5))
            new = list({r for r in [*one, *other] if r not in known})
            if sum(map(len, known)) > 16 << 20:
                known.clear()
                new = list({*one, *other})
            for a, b in _parts(new):
                for r, s in zip(new[a:b], shingles(new[a:b], words), strict=True):
                    known[r] = (s, [np.sort(prefix(s, k, frequent.value, similar)) for k in range(1, orders)])
            shared, linked, lacks, extras = [], [], [], []
            for x, y in zip(one, other, strict=True):
                (x, first), (y, second) = known[x], known[y]
                held = _held(x, y)
                n = int(held.sum())
                candidates = all(_held(p, q).any() for p, q in zip(first, second, strict=True))
                shared.append(n)
                linked.append(int(candidates and similar[1] * n >= similar[0] * (len(x) + len(y) - n)))
                lacks.append(_bitmap(x[~held]))
                extras.append(_bitmap(y[~_held(y, x)]))
            columns = [*batch.columns[:4], shared, linked, lacks, extras]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    left = texts.select(F.col("cls").alias("a"), F.col("rep").alias("rep_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("rep").alias("rep_b"), F.col("text").alias("text_b"))
    full = right.join(_few(pairs, n_pairs), "b").join(left, "a").select("a", "b", "rep_a", "rep_b", "text_a", "text_b")
    return full.coalesce(_tasks(n_pairs)).mapInArrow(run, "a long, b long, rep_a long, rep_b long, shared long, linked long, lacks array<long>, extras array<long>")


def _tasks(n_pairs: int) -> int:
    return max(_TASKS, n_pairs // _PAIRS)


def _few(pairs: DataFrame, n_pairs: int) -> DataFrame:
    return F.broadcast(pairs) if n_pairs <= BROADCAST_ROWS else pairs


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """BUCKETS bits, set where a shingle falls, as 64-bit numbers."""
    bits = np.zeros(BUCKETS, np.uint8)
    bits[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which members of the sorted set x are in the sorted set y."""
    if not len(x) or not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _could_link(size_a: str, size_b: str, overlap: str, similar: tuple[int, int]) -> str:
    """SQL: lengths fit, and `overlap` shared shingles would be enough."""
    n, d = similar
    return f"least({size_a}, {size_b}) * {d} >= greatest({size_a}, {size_b}) * {n} and ({overlap}) * {n + d} >= ({size_a} + {size_b}) * {n}"


def _share(packed: str, k: str | int) -> str:
    """SQL: the number at reach k of a packed long, whose lowest three bits say how many reaches it covers."""
    return f"(shiftright({packed}, {k} * {_BITS} + 3) & {_FULL})"


def _met(shared: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Postings (token, cls, size, lone, low, often) of shared tokens whose class can be in a link.

    `lone` packs, for each reach that the class covers, which share of its shingles lies below and has no match, as
    no other class posts them.
    """
    n, d = similar
    own = Window.partitionBy("cls")
    seen = shared.withColumn("about", F.max(F.when(F.col("facts") < 0, F.bitwise_not("facts"))).over(own)).withColumns({
        f"met_{k}": F.count_if((F.col("facts") >= 0) & (F.col("facts").bitwiseAND(15) <= k)).over(own) for k in range(len(REACHES))
    })
    member = seen.where("facts >= 0").withColumn("size", F.expr("shiftright(facts, 14)"))
    lone = [f"shiftleft(greatest(0L, {_share('about', k)} * size div {_FULL} - met_{k}) * {_FULL} div size, {k * _BITS + 3})" for k in range(len(REACHES))]
    member = member.withColumn("lone", F.expr(" | ".join(["(about & 7)", *lone])))
    return member.where(f"{_rest('', '0')} * {d} >= size * {n}").select("token", "cls", "size", "lone", F.expr("facts & 15 = 0 as low"), F.expr("shiftright(facts, 8) & 63 as often"))


def _rest(a: str, k: str) -> str:
    """SQL: how many of a class's shingles may have a match."""
    return f"({a}size - {_share(f'{a}lone', k)} * {a}size div {_FULL})"


def _most(a: str, b: str) -> str:
    """SQL: what two classes share at most, by what is lone up to where both reach."""
    k = f"cast(least({a}lone & 7, {b}lone & 7) - 1 as int)"
    return f"least({_rest(a, k)}, {_rest(b, k)})"


def _open(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of the tokens whose members are in different components, with each member's component as root."""
    member = join_counted(member, roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parted = member.groupBy("token").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root")).where("low_root <> high_root")
    return member.join(parted.select("token"), "token")


def _trials(member: DataFrame, turn: int, tasks: int) -> DataFrame:
    """(token, n, pairs, partners) of the groups of `member`: their members, their pairs between components, and partners to try.

    In even turns groups of the same members have the same few partners, from their largest component and from anywhere; in odd ones each
    group has its own of its largest component, so that those who are still apart from it try many of it.
    """
    alike = turn % 2 == 0
    by = [F.xxhash64(F.lit(4 * turn + i), *([] if alike else ["token"]), "cls").alias("by") for i in range(4)]
    two = member.groupBy("token", "root").agg(F.count("*").alias("n"), *[
        F.min(F.struct(by[i], "cls", "size", "lone", "root")).alias(f"p{i}") for i in range(4)
    ]).coalesce(tasks)
    one = two.groupBy("token").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("same"), F.max(F.struct("n", F.col("p0.root").alias("root"), "p0", "p1")).alias("most"), F.min("p2").alias("p2"), F.min("p3").alias("p3")
    )
    return one.select("token", "n", F.expr("(n * n - same) div 2 as pairs"), F.array("most.p0", "most.p1", *["p2", "p3"] * alike).alias("partners")).coalesce(tasks)


def link(docs: DataFrame, *, words: int = WORDS, similar: tuple[int, int] = SIMILAR, orders: int = ORDERS, crowded: int = CROWDED, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, class_id (the least doc_id with the same words), component_id of every row of `docs` (doc_id, text).

    `crowded` and `hot` change what the search costs, never its links.
    """
    with scratch() as own_cut, small_batches(docs.sparkSession):
        return cut(_linked(docs.select("doc_id", "text"), own_cut, words, similar, orders, crowded, hot), "link")


def _linked(docs: DataFrame, cut, words: int, similar: tuple[int, int], orders: int, crowded: int, hot_level: int) -> DataFrame:
    spark = docs.sparkSession
    survey = cut(_survey(docs, words), "link-survey")
    # Postings are no more than shingles. Little is not dealt to more tasks than it can use, however many partitions the session has.
    tasks = max(_TASKS, (survey.where("kind = 0").agg(F.sum("n")).first()[0] or 0) // _SHINGLES)
    met = survey.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")).coalesce(tasks).where("n >= 16").orderBy(F.desc("n"), "hi").limit(FREQUENT)
    met = met.select("hi", F.least(F.floor(F.log2("n")), F.lit(60)).cast("long").alias("level")).toArrow()
    ids, levels = met.column("hi").to_numpy().view(np.uint64), met.column("level").to_numpy().astype(np.uint64)
    by_id = np.argsort(ids)
    frequent = spark.sparkContext.broadcast((ids[by_id], levels[by_id]))

    rows = survey.where("kind = 0").drop("kind")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")).coalesce(tasks)
    classes = cut(classes.select("hi", F.col("lo").alias("cls"), "rep"), "link-classes")

    # A hot token's classes are dealt to many tasks; nothing below needs a token's rows together.
    hot = (F.col("facts") >= 0) & (F.col("facts").bitwiseAND(16) > 0)
    deal = F.when(hot, F.xxhash64("token", F.pmod("cls", F.lit(1024)))).otherwise(F.col("token"))
    dealt = _postings(docs.where("doc_id is not null"), frequent, words, similar, hot_level).repartition(deal).coalesce(tasks).sortWithinPartitions("token", "cls")
    shared = cut(dealt.mapInArrow(_shared, "token long, cls long, facts long"), "link-shared")
    n, d = similar
    met = cut(_met(shared, similar).coalesce(tasks), "link-met")
    cut.drop(shared)

    # Members against hubs. In larger groups those that can't link with the hub are measured too, for what it says
    # about their other pairs.
    group = met.groupBy("token").agg(F.min(F.struct(F.expr(_share("lone", 0)).alias("part"), "cls", "size", "lone")).alias("hub"), F.count("*").alias("members"))
    group = group.where("members > 1").select("token", "members", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("cls", "size", "lone")])
    member = dealt_members = cut(met.join(group, "token").coalesce(tasks), "link-members")
    cut.drop(met)
    stars = member.where("cls <> hub_cls").groupBy("cls", "hub_cls").agg(*[F.any_value(c).alias(c) for c in ("size", "lone", "hub_size", "hub_lone")], F.max(F.col("members") >= crowded).alias("crowded"))
    stars = stars.where(F.expr(_could_link("size", "hub_size", _most("", "hub_"), similar)) | F.col("crowded")).select(F.col("hub_cls").alias("a"), F.col("cls").alias("b"), "crowded")
    stars = cut(stars.coalesce(tasks), "link-stars")

    def of_classes(pairs: DataFrame, n_pairs: int, with_text: bool) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        name = "link-texts" if with_text else "link-sketches"
        if n_pairs <= BROADCAST_ROWS:
            wanted = classes.join(F.broadcast(wanted), "cls", "left_semi").select(F.col("rep").alias("doc_id"), F.col("cls"))
            return cut(_of_class(docs.join(F.broadcast(wanted), "doc_id"), words, with_text).coalesce(max(_TASKS, n_pairs // _TEXTS)), name)
        wanted = cut(classes.join(wanted.distinct(), "cls").select(F.col("rep").alias("doc_id"), F.col("cls")), "link-wanted")
        return cut(_of_class(join_counted(docs, wanted, "doc_id", rows=_IDS), words, with_text), name)

    def links(pairs: DataFrame) -> DataFrame:
        likely, n_pairs = pairs.select("a", "b"), pairs.count()
        if n_pairs > _UNSIFTED:
            sketches = of_classes(pairs, n_pairs, False)
            likely = cut(_plausible(pairs, sketches, similar, n_pairs), "link-likely")
            cut.drop(sketches)
            n_pairs = likely.count()
        texts = of_classes(likely, n_pairs, True)
        found = cut(_verified(likely, texts, frequent, words, similar, orders, n_pairs), "link-links")
        cut.drop(texts)
        return found

    first = links(stars)
    roots = components(first.where("linked = 1").select("a", "b"))

    # The smaller of two that link lacks at most this many of the other's shingles, lone ones included, so among any
    # one more of its shingles is one of the other's. The other posts it too if it is low; those of the smallest
    # groups are taken. Classes with too few low ones look for partners by all they post.
    lacks = F.expr(f"floor(size * {d - n} / {n + d}) + 1 - {_share('lone', 0)} * size div {_FULL}")
    own = Window.partitionBy("cls", "low")
    member = member.withColumn("asks", F.when(F.col("low"), F.row_number().over(own.orderBy("members", "token")) <= lacks).otherwise(False))
    member = member.withColumn("asks", F.col("asks") | (F.count_if("low").over(Window.partitionBy("cls")) < lacks))
    columns = ["token", "members", "cls", "size", "lone", "hub_cls", "hub_size", "often", "asks"]
    member = cut(_open(member.select(*columns), roots).coalesce(tasks), "link-open")
    cut.drop(dealt_members)
    edges, tried = first.where("linked = 1").select("a", "b", "rep_a", "rep_b"), stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(TRIALS):
        # A group is open or closed as a whole, so its number of members still holds.
        many = member.where(F.col("members") >= crowded)
        groups = cut(_trials(many, turn, tasks), "link-groups")
        n_rows, n_pairs = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if n_pairs <= crowded * n_rows:
            break
        near = many.join(groups.select("token", F.explode("partners").alias("y")), "token").where("root <> y.root").where(_could_link("size", "y.size", _most("", "y."), similar))
        near = near.select(F.least("cls", "y.cls").alias("a"), F.greatest("cls", "y.cls").alias("b"), F.lit(False).alias("crowded")).coalesce(tasks).distinct()
        near = cut(near.join(tried, ["a", "b"], "left_anti").coalesce(tasks), "link-trials")
        joined = links(near).where("linked = 1").select("a", "b", "rep_a", "rep_b")
        edges = edges.unionByName(joined)
        tried = tried.unionByName(near.select("a", "b"))
        closed, member = member, cut(_open(member.select(*columns), components(edges.select("a", "b"))).coalesce(tasks), "link-open")
        cut.drop(closed)
        if joined.count() * YIELD < near.count():
            break
    # What each shares with its group's hub, lacks of it and has besides; all of itself and nothing if it is the hub.
    measured = first.select(F.col("a").alias("hub_cls"), F.col("b").alias("cls"), F.col("shared").alias("met"), "lacks", "extras")
    hub, none = F.col("cls") == F.col("hub_cls"), F.array_repeat(F.lit(0).cast("long"), BUCKETS // 64)
    member = member.join(measured, ["hub_cls", "cls"], "left").withColumns({"met": F.when(hub, F.col("size")).otherwise(F.col("met")), **{c: F.when(hub, none).otherwise(F.col(c)) for c in ("lacks", "extras")}})
    words_ = range(BUCKETS // 64)
    # Shingles besides the hub's that fall in a bucket with another one.
    member = member.withColumn("slack", F.col("size") - F.col("met") - reduce(add, [F.bit_count(F.col("extras")[i]) for i in words_]))
    # By bucket, the shingles of groups with the same hub that a class asks for before this one, in the first order. The
    # hub holds them all, and who posts this one posts all that it holds before it; so who doesn't lack one of them has
    # met the class there already.
    rank = ["often", F.expr("shiftrightunsigned(token, 1)"), "token"]
    before = Window.partitionBy("cls", "hub_cls").orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    earlier = [F.coalesce(F.bit_or(F.when(F.expr(f"(token & {BUCKETS - 1}) div 64") == i, bit)).over(before), F.lit(0)) for i in words_]
    member = member.select("token", "cls", "size", "root", "hub_cls", "hub_size", "met", "lacks", "extras", "slack", "lone", "often", "asks")
    x, y = member.where("asks").withColumn("earlier", F.array(*earlier)).alias("x"), member.drop("hub_cls", "often").alias("y")
    met_before = " | ".join(f"(x.earlier[{i}] & ~y.lacks[{i}])" for i in words_)
    # Both have of the hub at most what neither lacks, and besides it at most what falls in buckets of both.
    lacking = " + ".join(f"bit_count(x.lacks[{i}] | y.lacks[{i}])" for i in words_)
    besides = " + ".join(f"bit_count(x.extras[{i}] & y.extras[{i}])" for i in words_)

    def through_hub(of_hub: str, also: str) -> str:
        return f"coalesce({of_hub} + least({also}, x.size - x.met, y.size - y.met), x.size)"

    bounds = [_most("x.", "y."), through_hub(f"least(x.met, y.met, x.hub_size - ({lacking}))", f"{besides} + least(x.slack, y.slack)")]
    bounded = " and ".join(_could_link("x.size", "y.size", b, similar) for b in bounds)
    rest = x.join(y, F.expr(f"x.token = y.token and (x.size, x.cls) < (y.size, y.cls) and x.root <> y.root and coalesce(({met_before}) = 0, true) and {bounded}"))
    rest = rest.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.lit(False).alias("crowded")).coalesce(tasks).distinct()
    last = links(cut(rest.join(tried, ["a", "b"], "left_anti").coalesce(tasks), "link-rest"))

    edges = edges.unionByName(last.where("linked = 1").select("a", "b", "rep_a", "rep_b")).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # Rows that share an id are one node: their classes' representatives are joined.
    twice = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("lo").alias("low"), F.max("lo").alias("high"), F.collect_set("lo").alias("los")).where("low <> high")
    twice = twice.select("doc_id", F.explode("los").alias("cls")).join(classes, "cls")
    edges = edges.unionByName(twice.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(edges).select(F.col("node").alias("rep"), "root")
    known = join_counted(classes, final, "rep", "left").select("hi", F.col("cls").alias("lo"), "rep", F.coalesce("root", "rep").alias("root"))
    out = rows.join(known, ["hi", "lo"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))


def _of_class(rows: DataFrame, words: int, with_text: bool) -> DataFrame:
    """(cls, rep, text or sketch) of rows whose text is of the class; another row may have the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            raws = _raws(batch.column(2))
            own = pa.array([_key(r)[1] == c for r, c in zip(raws, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            if not with_text:
                raws = [r for r, o in zip(raws, own.to_pylist(), strict=True) if o]
                sketches = pa.array([_sketch(x) for a, b in _parts(raws) for x in shingles(raws[a:b], words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.filter(own) for c in batch.columns[:2]), sketches], ["cls", "rep", "sketch"])
            else:
                yield batch.filter(own)

    kept = rows.select("cls", F.col("doc_id").alias("rep"), "text").mapInArrow(run, "cls long, rep long, " + ("text string" if with_text else "sketch binary"))
    return kept.dropDuplicates(["cls", "rep"])


def _sketch(tokens: np.ndarray) -> bytes:
    """How many shingles each bucket holds; 255 stands for any number from there on."""
    return np.minimum(np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _plausible(pairs: DataFrame, texts: DataFrame, similar: tuple[int, int], n_pairs: int) -> DataFrame:
    """The pairs whose sketches allow a link, and all crowded ones, as their overlap is asked for."""
    n, d = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (3, 4))
            most = np.minimum(one, other).sum(axis=1, dtype=np.int64)
            both = one.sum(axis=1, dtype=np.int64) + other.sum(axis=1, dtype=np.int64)
            full = (one == 255).any(axis=1) | (other == 255).any(axis=1)
            keep = full | (most * (n + d) >= both * n) | np.array(batch.column(2).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    # Classes whose 64-bit ids are the same have a row each; a pair passes if any of them does.
    left = texts.select(F.col("cls").alias("a"), F.col("sketch").alias("one"))
    right = texts.select(F.col("cls").alias("b"), F.col("sketch").alias("other"))
    full = right.join(_few(pairs, n_pairs), "b").join(left, "a").select("a", "b", "crowded", "one", "other")
    return full.coalesce(_tasks(n_pairs)).mapInArrow(run, "a long, b long").distinct().coalesce(_tasks(n_pairs))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component: that whose id names it. Rows without an id or without words stay.

    Where several rows have that id, one stays for each of their different texts (copies in other spacing or case are no
    different ones).
    """
    columns = docs.columns
    found = link(docs, **options).where("doc_id is not null and n_shingles > 0").groupBy("doc_id")
    kept = cut(found.agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("kept"), F.count("*").alias("n")).where("kept").select(F.col("doc_id").alias("_l_id"), "n"), "link-kept")
    plain = docs.withColumn("_l_words", F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)) & F.col("doc_id").isNotNull())
    # Whole texts are sorted only where an id has several rows.
    once, more = (kept.where(n).select("_l_id") for n in ("n = 1", "n > 1"))
    chosen = plain.where("_l_words").withColumn("_l_id", F.col("doc_id").cast("long"))
    out = join_counted(chosen, once, "_l_id").select(*columns).unionByName(plain.where("not _l_words").select(*columns))
    if more.isEmpty():
        return out
    words = F.translate(F.regexp_replace(F.btrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d")), SPACE, " "), _CAPITALS, _CAPITALS.lower())
    unique = Window.partitionBy("doc_id", "_l_same").orderBy("text")
    chosen = join_counted(chosen, more, "_l_id").withColumn("_l_same", F.md5(words)).withColumn("_l_n", F.row_number().over(unique)).where("_l_n = 1")
    return out.unionByName(chosen.select(*columns))
