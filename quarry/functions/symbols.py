"""Symbols of compiler indexes as column expressions: what their descriptors name, outermost first, and of what kind each is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "local "
#: Kinds by a descriptor's suffix (fixed values); a callable's is "().", a parameter stands in brackets.
SUFFIXES = {"/": "module", "#": "class", ".": "function", ":": "field", "!": "function"}
_QUOTED = r"`(?:[^`]|``)*`"
_NAME = rf"(?:{_QUOTED}|[^`/#.:!()\[\]]+)"
#: A parameter, a type parameter, a callable, or a name with one of the suffixes.
DESCRIPTOR = rf"\((?:{_QUOTED}|[^`)]*)\)|\[(?:{_QUOTED}|[^`\]]*)\]|{_NAME}(?:\([^)]*\)\.|[/#.:!])"


def is_local(symbol: Column) -> Column:
    """Whether a symbol never leaves its document."""
    return symbol.startswith(LOCAL)


def unquoted(name: Column) -> Column:
    return F.when(name.startswith("`"), F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit("``"), F.lit("`"))).otherwise(name)


def descriptors(symbol: Column) -> Column:
    """An array of (name, kind); empty for a local, null or malformed symbol. Scheme, manager, package and version come before, each ended by a space."""
    parts = F.split(symbol, " ", 5)
    text = F.when(is_local(symbol) | (F.size(parts) < 5), "").otherwise(F.get(parts, F.lit(4)))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])

    def read(raw: Column) -> Column:
        inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
        called = F.regexp_replace(raw, r"\([^)]*\)\.$", "")
        bare = F.substring(raw, F.lit(1), F.length(raw) - 1)
        return (
            F.when(F.substring(raw, 1, 1).isin("(", "["), F.struct(unquoted(inner).alias("name"), F.lit("field").alias("kind")))
            .when(raw.endswith(").") & (called != raw), F.struct(unquoted(called).alias("name"), F.lit("method").alias("kind")))
            .otherwise(F.struct(unquoted(bare).alias("name"), F.try_element_at(kinds, F.substring(raw, -1, 1)).alias("kind")))
        )

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DESCRIPTOR), F.lit(0)), read)
