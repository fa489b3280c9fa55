"""The library's functions for SQL: temporary functions of a session, in SQL themselves, so that Catalyst sees through them.

| Function | Gives |
|-|-|
| `code_tokenize(text)` | distinct sorted code tokens |
| `query_intent(text)` | the intent of a query |
| `cosine_sim(a, b)` | cosine of two vectors; 0 where it isn't defined |
| `chunk_lines(file, content, size, stride)` | a table of overlapping windows of lines, for LATERAL |

Nulls: no tokens, intent Unknown, cosine 0, no chunks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.functions import intent, text


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _tokenize() -> str:
    looked = f"array_join(filter(d, w -> w rlike {_raw(text._BORDER)}), ' ')"
    parts = f"concat_ws(' ', array_join(d, ' '), regexp_replace({looked}, {_raw(text._CAMEL)}, ' '), regexp_replace({looked}, {_raw(text._DIGITS)}, ' '))"
    words = f"array_distinct(split(regexp_replace(coalesce(t, ''), {_raw(text._NOT_ALNUM)}, ' '), ' '))"
    return f"array_sort(array_remove(array_distinct(element_at(transform(array({words}), d -> split(lower({parts}), ' ')), 1)), ''))"


def _intent() -> str:
    chain = [f"when t rlike {_raw(p)} then '{label}'" for label, p in intent.CHAIN]
    chain += [f"when trim(t) rlike {_raw(p)} then '{label}'" for label, p in (("Conceptual", intent.LONG_PROSE), ("Definition", intent.IDENTIFIER))]
    return f"case {' '.join(chain)} else 'Unknown' end"


def _cosine() -> str:
    def dot(a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

    norms = f"sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})"
    return f"case when a is null or b is null or size(a) <> size(b) or size(a) = 0 or {norms} = 0 then 0D else {dot('a', 'b')} / ({norms}) end"


def _chunks() -> str:
    rows = r"case when coalesce(body, '') = '' then array() else split(regexp_replace(body, r'\r?\n\z', ''), r'\r?\n', -1) end"
    last = "greatest(cast(ceil((size(r) - win) / step) as int), 0)"
    spans = f"transform(sequence(0, {last}), i -> named_struct('b', i * step + 1, 'e', least(i * step + win, size(r))))"
    inner = f"select r, explode({spans}) as s from (select {rows} as r) where size(r) > 0"
    return f"select concat_ws(':', path, s.b, s.e), cast(s.b as int), cast(s.e as int), array_join(slice(r, s.b, s.e - s.b + 1), '\\n') from ({inner})"


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; done again it changes nothing."""
    start = "create or replace temporary function"
    spark.sql(f"{start} code_tokenize(t string) returns array<string> return {_tokenize()}")
    spark.sql(f"{start} query_intent(t string) returns string return {_intent()}")
    spark.sql(f"{start} cosine_sim(a array<double>, b array<double>) returns double return {_cosine()}")
    spark.sql(f"{start} chunk_lines(path string, body string, win int, step int) returns table(chunk_id string, start_line int, end_line int, content string) return {_chunks()}")
