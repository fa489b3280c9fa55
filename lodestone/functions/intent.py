"""Query intent: an ordered chain of patterns, and the lane weights that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns in order, first match wins. The last two look at the trimmed text and mind case.
CHAIN = (
    ("Usage", r"(?iU)\b(tested by|co-occurs)\b"),
    ("Definition", r"(?iU)\b(implements|derives from|aliased as)\b"),
    ("BugDebt", r"(?iU)\b(raises|documented by)\b"),
    ("Definition", r"(?iU)\b(definition|interface|schema|model|enum)\b|\b[A-Za-z][a-zA-Z0-9]+\s+(definition|struct|class|interface|type|schema|enum|trait|model)\b"),
    ("BugDebt", r"(?iU)\b(error\s+handling|deprecated|legacy|missing\s+validation|hardcoded)\b"),
    ("Usage", r"(?iU)\b(where is|callers of|who calls|uses of|usages|called by)\b"),
    ("Definition", r"(?iU)\b(fn |struct |impl |trait |enum |type |def |class |function |define)\b"),
    ("Conceptual", r"(?iU)\b(how does|what is|explain|overview|architecture|design|why)\b"),
    ("BugDebt", r"(?iU)\b(TODO|FIXME|HACK|panic!|unwrap\(\)|bug|error|crash|fail)\b"),
)
# Six pieces or more without any of the marks ( ) : _ . ; written without nested repeats, as this engine backtracks.
LONG_PROSE = r"(?U)^[^():_.](?:[^():_.\s]*+\s[^():_.]){5}[^():_.]*\z"
# Fixed value: identifiers in camel case, or with an acronym in front.
IDENTIFIER = r"(?U)\b(?:[A-Z][a-z]+[A-Z][a-zA-Z0-9]*|[A-Z]{2,}(?:[0-9]+[A-Za-z][a-zA-Z0-9]*|[0-9]+|[A-Z][a-z][a-zA-Z0-9]*))\b"
# Alpha (vector lane), beta (lexical lane), and whether the graph is consulted.
WEIGHTS = {"Definition": (0.3, 0.7, False), "Usage": (0.5, 0.5, True), "Conceptual": (0.8, 0.2, False), "BugDebt": (0.1, 0.9, False), "Unknown": (0.6, 0.4, False)}


def intent(text: Column) -> Column:
    found = F
    for label, pattern in CHAIN:
        found = found.when(text.rlike(pattern), label)
    trimmed = F.trim(text)
    return found.when(trimmed.rlike(LONG_PROSE), "Conceptual").when(trimmed.rlike(IDENTIFIER), "Definition").otherwise("Unknown")


def domain_intent(text: Column, terms: Sequence[str]) -> Column:
    """Unknown becomes Definition where the text holds a domain term, in either case."""
    plain, lowered = intent(text), F.lower(text)
    hit = F.lit(False)
    for t in terms:
        if t.strip():
            hit = hit | lowered.contains(t.strip().lower())
    return F.when((plain == "Unknown") & hit, "Definition").otherwise(plain)


def weights(label: Column) -> Column:
    """struct(alpha, beta, use_graph) of an intent."""
    out = F
    for name, (alpha, beta, graph) in WEIGHTS.items():
        out = out.when(label == name, F.struct(F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), F.lit(graph).alias("use_graph")))
    return out
