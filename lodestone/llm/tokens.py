"""Token counts with overlap resynchronisation.

A huge document is encoded in chunks that overlap, with offsets. Two neighbouring chunks are spliced at a
stable common boundary inside their overlap: a place between a visible character and a space that a visible
character follows. The byte-level pre-tokenizer always starts a piece at such a place whatever stands before
it, merges never leave a piece, and no special token holds a space, so both chunks must start a token there;
that both do is checked too. Where an overlap holds no such place, it is doubled until it does or until the
chunk reaches the document's end.

In shorter texts the same places part the text into short strings of which most recur. Each distinct one is
encoded by the library once for each worker and remembered, up to a fixed number of bytes.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row is counted by itself, repeated or
not; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of more characters are encoded in overlapping chunks of so many.
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
#: Bytes that a worker spends on remembered strings, and characters of the longest that it remembers.
REMEMBERED_BYTES = 80 << 20
REMEMBERED_CHARS = 64
_SLOT = 110

_STABLE = re.compile(r"(?<=\S)(?= \S)")
_LOOSE = re.compile(r"\s\s")
_MARKS = frozenset(".,;:!?#$%&*|()")
_WORD_MARKS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|()]+)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def load(path: str):
    """The library's own tokenizer with the file's defaults, but without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def stable_parts(text: str) -> list[str]:
    """The text, parted at every stable boundary."""
    if _LOOSE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _STABLE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class _Known(dict):
    """Values by key; keys that were asked for in vain are kept aside, so that nobody has to look for gaps."""

    def __init__(self):
        self.vain: list = []

    def __missing__(self, key):
        self.vain.append(key)


class Memo:
    """Values of short strings, up to a number of bytes; then it starts anew. Longer strings are never kept."""

    def __init__(self, value_many, most: int = REMEMBERED_BYTES, longest: int = REMEMBERED_CHARS):
        self.value_many, self.most, self.longest = value_many, most, longest
        self.known, self.held = _Known(), 0

    def all(self, keys: list[str]) -> list:
        values = list(map(self.known.__getitem__, keys))
        if self.known.vain:
            new, self.known.vain = set(self.known.vain), []
            fresh = self._learn(new)
            values = [fresh[k] if v is None else v for k, v in zip(keys, values, strict=True)]
        return values

    def _learn(self, new: set[str]) -> dict:
        # A word of letters with punctuation behind it is two pieces to either pre-tokenizer.
        joint = {k: m.groups() for k in new if k[-1:] in _MARKS and (m := _WORD_MARKS.fullmatch(k))}
        single = {x for pair in joint.values() for x in pair} | (new - joint.keys())
        fresh = {x: self.known[x] for x in single if x in self.known}
        unknown = [x for x in single if x not in fresh]
        fresh.update(zip(unknown, self.value_many(unknown), strict=True))
        fresh.update({k: fresh[x] + fresh[y] for k, (x, y) in joint.items()})
        if self.held > self.most:
            self.known, self.held = _Known(), 0
        kept = {k: v for k, v in fresh.items() if len(k) <= self.longest and k not in self.known}
        self.known.update(kept)
        self.held += sum(map(getsizeof, kept)) + sum(map(getsizeof, kept.values())) + _SLOT * len(kept)
        return fresh


class Counter:
    """Token counts of one worker, which remembers what short strings came to."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.memo = Memo(lambda texts: [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def count(self, text: str) -> int:
        if len(text) > self.chunk:
            return sum(n for _, _, n in self.spans(text))
        return sum(self.memo.all(stable_parts(text))) if text else 0

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens) of the spliced stretches of a huge text."""
        start, at, left = 0, 0, None  # stretch under way; where the left chunk starts; its token starts
        end = min(len(text), self.chunk)
        left = self._starts(text, at, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                stop = min(len(text), begin + self.chunk + overlap)
                right = self._starts(text, begin, stop)
                cut = self._common(text, begin, end, set(left), set(right), start)
                if cut or stop == len(text) and begin == start:
                    break
                if begin == start:  # the whole stretch overlaps and holds no boundary: it has to grow
                    end, left = stop, right
                    if end == len(text):
                        break
                overlap *= 2
            if not cut:
                left, at, end = right, begin, stop
                break
            yield start, cut, sum(start <= x < cut for x in left)
            start, at, end, left = cut, begin, stop, right
        yield start, len(text), sum(x >= start for x in left)

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of text[begin:end] start; bytes of one character share their start."""
        return [begin + a for a, _ in self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets]

    @staticmethod
    def _common(text: str, begin: int, end: int, left: set[int], right: set[int], start: int) -> int:
        """The last stable boundary after `start` within text[begin:end] that both encodings share, or 0."""
        at = end - 1
        while (at := text.rfind(" ", max(begin, start) + 1, at)) > 0:
            if not text[at - 1].isspace() and not text[at + 1].isspace() and at in left and at in right:
                return at
        return 0


_counters: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit, n_chunks.

    `tokenizer` is the path of a tokenizer file that every executor can open; byte-level BPE.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault((path, chunk, overlap), Counter(path, chunk, overlap))
        for batch in batches:
            n_bytes, n_tokens, n_chunks = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
                n_chunks.append(-(-len(text) // chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(n_chunks, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
