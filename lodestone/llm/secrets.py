"""Secret scans with DataFrame functions alone.

Three fixed patterns (assign, access, hex) give the base spans. The method adds spans of kind entropy: runs of a
character class that no pattern names but that look random. A window slides over each such candidate; counts of
its characters are kept up to date by the one that enters and the one that leaves, and with them the sum that
Shannon's entropy needs. Where some window's entropy reaches the class's threshold, the stretch from the first to
the end of the last such window is a span, unless the allow-list knows the candidate. Placeholders and counted-up
alphabets part a run, so that a key beside one is judged by itself. Stretches of several classes that overlap are one
span. Of a stretch that base spans overlap, what they leave is the span; words that a sign joins to a base span
(user_ before a hex run) are left out.

Positions come from the lengths of the stretches between matches, in code points, end exclusive.

Defined results: null texts count as empty and have no spans; every row is scanned by itself, repeated or not; an
empty table gives an empty result; other columns are ignored (and kept by `redacted`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Maximal runs, so a least length within the pattern finds the same as one that is asked for afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[secret]"

WINDOW = 20
#: Characters of a candidate that are handled at once.
PIECE = 256
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Known to be harmless within a run, which they part: placeholders, their words, counted-up alphabets.
HARMLESS = "(?i:example|sample|placeholder|changeme|x{6}|0123456789|" + "|".join(_LETTERS[i : i + 8] for i in range(19)) + ")"


def _runs(of: str, end: str = "") -> str:
    """Maximal runs of a class, parted by what is harmless."""
    return f"(?=[{of}]{{20}})(?:(?<![{of}])|(?<={HARMLESS}))(?:(?!{HARMLESS})[{of}]){{20,}}+{end}"


#: Character classes: candidate pattern and the least entropy of a window, in bits for each character.
CLASSES = {
    "hexadecimal": (_runs("0-9A-Fa-f"), 3.0),
    "lower": (_runs("a-z0-9_-"), 3.55),
    "base64": (_runs("A-Za-z0-9+/_-", "={0,2}"), 3.75),
}
# Words in one case or capitalised, as camel case too; letters in any other mixture of cases are left to the entropy.
_WORD = "(?:[a-z]++|(?:[A-Z](?![a-z]))*+)(?:[A-Z][a-z]{2,}+)*+"
#: Candidates that are known to be harmless as a whole: without letters, identifiers and paths made of words, UUIDs.
ALLOWED = rf"(?i)^[^a-z]*$|^(?-i:(?:{_WORD}[-_/+])*+{_WORD})[0-9]{{0,4}}={{0,2}}$|^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$"
#: What joins words to a key.
_JOINT = "^[-_/+]|[-_/+]$"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_SPANS = "array<struct<start:int,end:int>>"
_ROW = 128


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) of each of the `found` matches of `pattern`.

    Spans are put into rows of _ROW, and rows into one array, as adding to an array copies it.
    """
    none = F.array().cast(_SPANS)
    # The last gap has no match behind it.
    steps = F.slice(F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("own"))), F.lit(1), F.size(found))

    def step(acc: Column, x: Column) -> Column:
        start, full = acc.pos + x.gap, F.size(acc.row) >= _ROW
        row = F.concat(F.when(full, none).otherwise(acc.row), F.array(_span(start, start + x.own)))
        return F.struct((start + x.own).alias("pos"), row.alias("row"), F.when(full, F.concat(acc.rows, F.array(acc.row))).otherwise(acc.rows).alias("rows"))

    begin = F.struct(F.lit(0).alias("pos"), none.alias("row"), F.array().cast(f"array<{_SPANS}>").alias("rows"))
    return F.when(F.size(found) > 0, F.aggregate(steps, begin, step, lambda acc: F.flatten(F.concat(acc.rows, F.array(acc.row))))).otherwise(none)


def _hot_in_piece(piece: Column, least: float, window: int) -> Column:
    """(start, end) within a short piece of the windows whose entropy reaches `least`; start is -1 if none does."""
    # Entropy of a window is log2(w) - s / w with s the sum of n log2 n over its counts n.
    def term(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)

    def changed(counts: Column, at: Column, n: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(n), F.slice(counts, at + 1, F.lit(len(_ALPHABET))))

    w = F.lit(window)
    letters = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    # What enters the window at each step, and what leaves it (0: nothing does yet).
    steps = F.zip_with(letters, F.slice(F.concat(F.array_repeat(F.lit(0), window), letters), F.lit(1), F.length(piece)), lambda x, y: F.struct(x.alias("enters"), y.alias("leaves")))

    def step(acc: Column, x: Column) -> Column:
        came, left = F.element_at(acc.counts, x.enters), F.when(x.leaves > 0, F.element_at(acc.counts, x.leaves))
        same, at = x.leaves == x.enters, acc["at"] + 1
        s = acc.s + F.when(same, 0.0).otherwise(term(came + 1) - term(came) + F.when(x.leaves > 0, term(left - 1) - term(left)).otherwise(0.0))
        more = changed(acc.counts, x.enters, came + 1)
        counts = F.when(same, acc.counts).when(x.leaves > 0, changed(more, x.leaves, left - 1)).otherwise(more)
        hot = (at >= w) & (F.log2(w.cast("double")) - s / w >= least - 1e-9)
        return F.struct(at.alias("at"), counts.alias("counts"), s.alias("s"), F.when(hot & (acc.start < 0), at - w).otherwise(acc.start).alias("start"), F.when(hot, at).otherwise(acc.end).alias("end"))

    begin = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(steps, begin, step, lambda acc: F.struct(acc.start.alias("start"), acc.end.alias("end")))


def hot_stretch(candidate: Column, least: float, window: int = WINDOW) -> Column:
    """(start, end) within the candidate of the windows whose entropy reaches `least`; start is -1 if none does.

    Candidates of any length are taken in pieces that overlap by a window less one, so the work grows with the length.
    """
    pieces = F.regexp_extract_all(candidate, F.lit(rf"(?s)(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))

    def place(piece: Column, i: Column) -> Column:
        return F.struct((i * PIECE).alias("at"), _hot_in_piece(piece, least, window).alias("in"))

    def join(acc: Column, x: Column) -> Column:
        hot = x["in"].start >= 0
        return F.struct(F.when(hot & (acc.start < 0), x["at"] + x["in"].start).otherwise(acc.start).alias("start"), F.when(hot, x["at"] + x["in"].end).otherwise(acc.end).alias("end"))

    return F.aggregate(F.transform(pieces, place), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), join)


def _stretch_in_text(least: float, window: int):
    return lambda x: F.struct(x.span.start.alias("at"), hot_stretch(x.candidate, least, window).alias("in"))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _merged(spans: Column) -> Column:
    """Spans by start, those that overlap as one."""

    def step(acc: Column, span: Column) -> Column:
        last = F.element_at(acc, -1)
        over = (F.size(acc) > 0) & (span.start < F.try_element_at(acc, F.lit(-1)).end)
        return F.when(over, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_span(last.start, F.greatest(last.end, span.end))))).otherwise(F.concat(acc, F.array(_span(span.start, span.end))))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def _uncovered(spans: Column, known: Column) -> Column:
    """What the `known` spans, by start, leave of each of the spans."""

    def left(span: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            before = F.when(k.start > acc.pos, F.array(_span(acc.pos, k.start))).otherwise(F.array().cast(_SPANS))
            inside = (k.start < span.end) & (k.end > acc.pos)
            return F.struct(F.when(inside, k.end).otherwise(acc.pos).alias("pos"), F.when(inside, F.concat(acc.out, before)).otherwise(acc.out).alias("out"))

        begin = F.struct(span.start.alias("pos"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(known, begin, step, lambda acc: F.when(acc.pos < span.end, F.concat(acc.out, F.array(_span(acc.pos, span.end)))).otherwise(acc.out))

    return F.flatten(F.transform(spans, left))


def _of_kind(i: int):
    return lambda x: F.struct(x.start.alias("start"), F.lit(i).alias("kind"), x.end.alias("end"))


def scan(docs: DataFrame, *, text: str = "text", allowed: str = ALLOWED, window: int = WINDOW) -> DataFrame:
    """`docs` with the columns _s_assign, _s_access, _s_hex and _s_entropy: arrays of (start, end) spans by start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    out = docs.withColumns({f"_s_m_{k}": matches(whole, p) for k, p in (base | {c: p for c, (p, _) in CLASSES.items()}).items()})
    placed = {f"_s_{k}": located(whole, p, F.col(f"_s_m_{k}")) for k, p in base.items()}
    keys = F.when(F.size("_s_m_assign") > 0, F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(2)))
    long_keys = F.filter(F.arrays_zip(placed["_s_assign"].alias("span"), F.coalesce(keys, F.array().cast("array<string>")).alias("key")), lambda x: F.length(x.key) >= 12)
    placed["_s_assign"] = F.when(F.size("_s_m_assign") > 0, F.transform(long_keys, lambda x: x.span)).otherwise(F.array().cast(_SPANS))
    for c, (pattern, least) in CLASSES.items():
        found = F.col(f"_s_m_{c}")
        pairs = F.arrays_zip(located(whole, pattern, found).alias("span"), found.alias("candidate"))
        plausible = F.filter(pairs, lambda x: ~x.candidate.rlike(allowed))
        hot = F.transform(plausible, _stretch_in_text(least, window))
        spans = F.transform(F.filter(hot, lambda x: x["in"].start >= 0), lambda x: F.struct((x["at"] + x["in"].start).alias("start"), (x["at"] + x["in"].end).alias("end")))
        placed[f"_s_{c}"] = F.when(F.exists(found, lambda x: ~x.rlike(allowed)), spans).otherwise(F.array().cast(_SPANS))
    out = out.withColumns(placed)
    known = F.array_sort(F.concat("_s_assign", "_s_access", "_s_hex"))
    hot = _merged(F.concat(*[f"_s_{c}" for c in CLASSES]))
    cut = F.exists(hot, lambda h: F.exists(known, lambda k: (k.start < h.end) & (h.start < k.end)))

    def word(span: Column) -> Column:
        rest = F.substr(whole, span.start + 1, span.end - span.start)
        return rest.rlike(allowed) & rest.rlike(_JOINT) & F.exists(known, lambda k: (k.start == span.end) | (k.end == span.start))

    entropy = F.when(cut, F.filter(_uncovered(hot, known), lambda span: ~word(span))).otherwise(hot)
    any_hot = F.greatest(*[F.size(f"_s_{c}") for c in CLASSES]) > 0
    out = out.withColumn("_s_entropy", F.when(any_hot, entropy).otherwise(F.array().cast(_SPANS)))
    return out.drop(*[f"_s_m_{k}" for k in [*base, *CLASSES]], *[f"_s_{c}" for c in CLASSES])


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, by start and then by kind, comma-joined."""
    own = [F.transform(F.col(f"_s_{k}"), _of_kind(i)) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    every = F.array_sort(F.concat(*own))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every row of `docs` (doc_id, text)."""
    found = scan(docs.select("doc_id", "text"), **options)
    counts = [F.size(f"_s_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


def redacted(docs: DataFrame, *, mask: str = MASK, **options) -> DataFrame:
    """`docs` with every span of its text replaced by `mask` and n_chars, if there, brought up to date."""
    columns = docs.columns
    found = scan(docs, **options)
    spans = F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in KINDS]))
    whole = F.col("text")

    def step(acc: Column, span: Column) -> Column:
        new = span.start >= acc.pos
        before = F.when(new, F.concat(F.substr(whole, acc.pos + 1, span.start - acc.pos), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc.pos, span.end).alias("pos"), F.concat(acc.out, before).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate(spans, begin, step, lambda acc: F.concat(acc.out, F.substr(whole, acc.pos + 1, F.length(whole))))
    out = found.withColumn("_s_text", F.when(F.size(spans) > 0, clean).otherwise(whole))
    return out.select(*[F.col("_s_text").alias(c) if c == "text" else F.coalesce(F.when(F.size(spans) > 0, F.length("_s_text").cast("long")), F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in columns])
