"""Ranked lexical search over a tiered index, exact in whole numbers.

The index: documents go in blocks of at most `BLOCK_DOCS`, as they are read; a posting list holds a term's documents in
one block, with their impacts (the term's weight times its saturation in the document). Postings of high impact are the
first tier, the others lower ones. The bounds between tiers come from the weights at quantiles of all postings.
For every term, the highest impact in the tiers below a tier is its residual bound.

The search: items are scored from the first tier. A document's score is known to be what it has met, and to be
no more than that and the residual bounds of the terms that it hasn't met. If an item's residual bounds together
are less than its k-th best known score, no document that was not met can be among its best: only those whose upper
bound reaches that score are looked up, in all tiers, and their scores are exact. Items without that proof fall through
to the next tier; in the last one nothing is residual.

Items go in blocks of about `ITEMS`, each against all documents; a block's terms and bounds go to the tasks.
Scores of an item and a block of documents are numbers in arrays, and only k of them, or the candidates, leave the task.

Defined results: terms are maximal runs of letters and digits of ASCII and of all other characters, A-Z lower-cased; a
null or empty text has none and isn't counted in N; without such documents, or without terms, an item has no result;
each row is a document and each row of items is an item, whatever its id; equal scores go by id, null ids last, then in
the order of reading; scores of 0 don't count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_counted, scratch

#: Documents and bytes of text in a block of the index (a longer text is one alone), and items in a block of the search, at most.
BLOCK_DOCS, BLOCK_BYTES, ITEMS = 4096, 16 << 20, 256
#: Shares of all postings above the bounds between tiers, about.
SHARES = (0.125, 0.5)
#: A posting as it is read, and as it is kept.
_READ = np.dtype([("at", "<u2"), ("tf", "<u4"), ("n", "<u4")])
_KEPT = np.dtype([("at", "<u2"), ("impact", "<i8")])
#: Bytes as they are in terms; what belongs to none is a space. All bytes of characters beyond ASCII belong to terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Index:
    """`documents` (block, ids) and `postings` (term, block, and for each tier a list and its highest impact)."""

    documents: DataFrame
    postings: DataFrame
    tiers: int


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Records as binary values of `counts` records each; null where there are none."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32) * values.dtype.itemsize
    lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
    return pc.if_else(pa.array(counts > 0), lists, pa.scalar(None, pa.binary()))


def _unpacked(lists: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of binary values without nulls, and how many each has."""
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task: a row of ids and numbers of words without a term, then a row for each term."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        column, start = batch.column(1).cast(pa.binary()), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + BLOCK_DOCS, max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))))
            size = min(stop, batch.num_rows) - start
            # What is left of a text is words with spaces between; an empty one gives an empty word.
            texts = [(t or b"").translate(_TABLE).strip() for t in column.slice(start, size).to_pylist()]
            split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
            n = np.where([bool(t) for t in texts], pc.list_value_length(split).to_numpy(zero_copy_only=False), 0)
            words = split.flatten()
            coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
            key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + np.repeat(np.arange(size), n), return_counts=True)
            own = np.empty(len(key), _READ)
            own["at"], own["tf"], own["n"] = key % size, tf, n[key % size]
            lists = _packed(own, np.bincount(key // size, minlength=len(coded.dictionary)))
            ids, sizes = batch.column(0).slice(start, size).to_pylist(), n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))], _RAW)
            rows, none = len(lists), pa.nulls(len(lists), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), coded.dictionary, lists, none, none], _RAW)
            number, start = number + 1, start + size


_RAW = ["block", "term", "list", "ids", "sizes"]


def _impacts(n_docs: int, n_terms: int, bounds: list[int]):
    """Posting lists with the weights of their terms, as lists of impacts for each tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            read, lengths = _unpacked(batch.column("list"), _READ)
            tf, n = read["tf"].astype(np.int64), read["n"].astype(np.int64)
            m = 25 + (75 * n * n_docs) // n_terms
            own = np.empty(len(read), _KEPT)
            own["at"] = read["at"]
            own["impact"] = np.repeat(batch.column("w").to_numpy(), lengths) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            tier, row = np.searchsorted(-np.array(bounds, np.int64), -own["impact"], side="left"), np.repeat(np.arange(len(lengths)), lengths)
            lists, tops = [], []
            for t in range(len(bounds) + 1):
                here = tier == t
                counts = np.bincount(row[here], minlength=len(lengths))
                top = np.zeros(len(lengths), np.int64)
                np.maximum.at(top, row[here], own["impact"][here])
                lists.append(_packed(own[here], counts))
                tops.append(pa.array(top, mask=counts == 0))
            names = [f"{x}_{t}" for x in ("tier", "top") for t in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), *lists, *tops], ["term", "block", *names])

    return run


def build(docs: DataFrame, *, shares: tuple[float, ...] = SHARES) -> Index | None:
    """The index of all rows of `docs` (doc_id, text), written to the shared folder; None if no text has a term."""
    with scratch() as own_cut:
        inverted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_inverted, "block long, term string, list binary, ids array<long>, sizes array<long>")
        raw = own_cut(inverted, "tiered-raw")
        documents = raw.where("term is null").select("block", "ids", "sizes")
        total = documents.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            return None
        lists = raw.where("term is not null").select("term", "block", "list")
        weight = F.floor(1000 * F.ln(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1)))
        held = lists.groupBy("term").agg((F.sum(F.octet_length("list")) / _READ.itemsize).cast("long").alias("df"))
        weights = own_cut(held.select("term", "df", weight.cast("long").alias("w")), "tiered-weights")
        # As many rows as weights differ: some ten thousand.
        by_weight = weights.groupBy("w").agg(F.sum("df").alias("n")).orderBy(F.desc("w")).collect()
        bounds = [1_000_000_000 // 1800 * w for w in _quantiles([(r.w, r.n) for r in by_weight], shares)]  # at a saturation of mean length
        columns = [f"{x}_{t} {kind}" for x, kind in (("tier", "binary"), ("top", "long")) for t in range(len(bounds) + 1)]
        tiered = lists.join(weights.select("term", "w"), "term").mapInArrow(_impacts(total.docs, total.terms, bounds), ", ".join(["term string, block long", *columns]))
        return Index(cut(documents.select("block", "ids"), "tiered-documents"), cut(tiered, "tiered-postings"), len(bounds) + 1)


def _quantiles(held: list[tuple[int, int]], shares: tuple[float, ...]) -> list[int]:
    """For each share the largest value that at least so much of what is held, in falling order, doesn't fall short of."""
    total, upto, found = sum(n for _, n in held), 0, []
    for value, n in held:
        upto += n
        while len(found) < len(shares) and upto >= shares[len(found)] * total:
            found.append(value)
    return found


class Asked:
    """A block of items: for each term the (item, repeats) that ask for it."""

    def __init__(self, texts: list[str | None]):
        self.by_term: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for word, n in Counter(terms(text)).items():
                self.by_term.setdefault(word.decode(), []).append((i, n))
        self.size = len(texts)

    def only(self, items: set[int]) -> dict[str, list[tuple[int, int]]]:
        kept = {t: [x for x in asked if x[0] in items] for t, asked in self.by_term.items()}
        return {t: asked for t, asked in kept.items() if asked}


def _scored(asked: dict[str, list[tuple[int, int]]], size: int, k: int, residual: dict[str, int] | None = None, cutoffs: dict[int, int] | None = None, named: bool = False):
    """Scores in a block of documents, from its posting lists and its row of ids.

    Leaves the k best known scores of each item; with `cutoffs`, the documents of these items whose upper bound reaches them;
    if `named`, those that a row without term and ids names (positions in `at`, items in `impact`) and whose score is above 0.
    """
    rest = np.zeros(size, np.int64)
    for term, own in asked.items():
        for item, n in own:
            rest[item] += n * (residual or {}).get(term, 0)

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        words, lists = block["term"].to_pylist(), block["list"]
        ids, wanted = pa.array([], pa.int64()), None
        for row, word in enumerate(words):
            if word is None and block["ids"][row].is_valid:
                ids = block["ids"][row].values
            elif word is None:
                wanted = block["at"][row].values.to_numpy(), block["item"][row].values.to_numpy()
        absent, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        known = np.zeros((size, len(ids)), np.int64)
        upper = np.repeat(rest[:, None], len(ids), axis=1) if cutoffs else None
        for row, word in enumerate(words):
            if word is not None:
                own = np.frombuffer(lists[row].as_buffer(), _KEPT)
                where, values = own["at"].astype(np.int64), own["impact"]
                for item, n in asked[word]:
                    known[item, where] += n * values
                    if cutoffs:
                        upper[item, where] += n * (values - residual.get(word, 0))
        items, places = [], []
        if named:
            items, places = [wanted[1]], [wanted[0]]
        else:
            for item in range(size):
                if cutoffs:
                    found = np.flatnonzero(upper[item] >= cutoffs[item]) if item in cutoffs else []
                else:
                    found = np.flatnonzero(known[item])
                    if len(found) > k:
                        found = found[known[item, found] >= np.partition(known[item, found], len(found) - k)[len(found) - k]]
                        found = found[np.lexsort((found, ids[found], absent[found], -known[item, found]))[:k]]
                items.append(np.full(len(found), item))
                places.append(found)
        items, places = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (items, places))
        score = known[items, places]
        keep = score > 0 if not cutoffs else slice(None)
        items, places, score = items[keep], places[keep], score[keep]
        columns = [pa.array(items.astype(np.int32)), pa.array(np.full(len(items), block["block"][0].as_py())), pa.array(places.astype(np.int32)), pa.array(ids[places], mask=absent[places]), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["item", "block", "at", "doc_id", "score"])

    return run


_OUT = "item int, block long, at int, doc_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: Index, asked: Asked, k: int, own_cut, counts: dict | None) -> DataFrame:
    """(item, block, at, doc_id, score, rank) of a block of items."""
    spark = index.postings.sparkSession
    extra = {"ids": "array<long>", "at": "array<int>", "item": "array<int>", "term": "string", "list": "binary"}
    columns = ["block", "term", "list", "ids", "at", "item"]

    def full(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in extra.items() if c not in rows.columns}).select(*columns)

    def lists(of: dict, upto: int) -> DataFrame:
        """The lists of these terms in the tiers up to one; lower tiers are columns that are not read."""
        tiers = [F.col(f"tier_{t}") for t in range(min(upto + 1, index.tiers))]
        rows = join_counted(index.postings, spark.createDataFrame([(t,) for t in of], "term string"), "term", "left_semi")
        joined = F.concat(*[F.coalesce(t, F.lit(b"")) for t in tiers]).alias("list")
        return full(rows.where(reduce(or_, [t.isNotNull() for t in tiers])).select("block", "term", joined))

    documents = full(index.documents)
    # As many rows as the block's items have terms.
    words = spark.createDataFrame([(t,) for t in asked.by_term], "term string")
    tops = join_counted(index.postings, words, "term", "left_semi").groupBy("term").agg(*[F.max(f"top_{t}").alias(f"top_{t}") for t in range(index.tiers)])
    tops = {r.term: [r[f"top_{t}"] or 0 for t in range(index.tiers)] for r in tops.collect()}
    pending, results = {i for own in asked.by_term.values() for i, _ in own}, []
    for tier in range(index.tiers):
        of, last = asked.only(pending), tier == index.tiers - 1
        if not of:
            break
        residual = {t: max(tops.get(t, [])[tier + 1 :], default=0) for t in of}
        rows = lists(of, tier).unionByName(documents)
        best = _best(own_cut(rows.groupBy("block").applyInArrow(_scored(of, asked.size, k), _OUT), "tiered-best"), k)
        rest = Counter()
        for t, own in of.items():
            for item, n in own:
                rest[item] += n * residual[t]
        if last or not any(rest.values()):
            results.append(best.where(F.col("item").isin(*sorted(pending))))
            break
        cutoffs = {r.item: r.score for r in best.where(F.col("rank") == k).select("item", "score").collect()}
        proven = {item for item, score in cutoffs.items() if rest[item] < score}
        if counts is not None:
            counts[f"proven in tier {tier}"] = counts.get(f"proven in tier {tier}", 0) + len(proven)
        if proven:
            of = asked.only(proven)
            reach = lists(of, tier).unionByName(documents).groupBy("block").applyInArrow(_scored(of, asked.size, k, residual, {i: cutoffs[i] for i in proven}), _OUT)
            reach = own_cut(reach.select("item", "block", "at"), "tiered-reach")
            if counts is not None:
                counts["looked up"] = counts.get("looked up", 0) + reach.count()
            # In a block there are no more than its documents times the items.
            named = full(reach.groupBy("block").agg(F.collect_list(F.struct("at", "item")).alias("x")).select("block", F.col("x.at").alias("at"), F.col("x.item").alias("item")))
            rows = lists(of, index.tiers).unionByName(documents).join(named.select("block"), "block", "left_semi").unionByName(named)
            results.append(_best(rows.groupBy("block").applyInArrow(_scored(of, asked.size, k, named=True), _OUT), k))
            pending -= proven
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def search(index: Index | None, items: DataFrame, *, k: int = 10, block: int = ITEMS, counts: dict | None = None) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every row of `items` (item_id, text).

    `counts`, if given, gets the numbers of items proven in a tier above the last, and of documents looked up for them.
    """
    spark, asked_rows = items.sparkSession, items.select("item_id", "text").where("text is not null")
    kind = asked_rows.schema["item_id"].dataType
    done = None
    if index is not None:
        blocks = max(1, math.ceil(asked_rows.count() / block))
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        for b in range(blocks):
            own = asked_rows.where(number == b).collect()
            asked = Asked([r.text for r in own])
            if not asked.by_term:
                continue
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item int, item_id {kind.simpleString()}")
            with scratch() as own_cut:
                found = _search_block(index, asked, k, own_cut, counts).join(F.broadcast(names), "item")
                found = cut(found.select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "tiered-found")
            done = done.unionByName(found) if done is not None else found
    if done is None:
        done = asked_rows.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return done
