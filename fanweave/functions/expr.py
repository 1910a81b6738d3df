"""Scalar expressions used across the library (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that results depend on (must stay exactly as written).
# Default vertex attribute for ids that only appear on follow edges.
UNKNOWN = "Unknown"
# Edge type written with every extracted edge.
DIRECTED = "Directed"
# Community size bands: exactly 1, 2-4, 5-9, 10 and more.
SIZE_BANDS = ("1", "2-4", "5-9", "10+")
# Sub-network extraction band: 10 <= size < 20.
EXTRACT_MIN, EXTRACT_MAX = 10, 20
# Fraction of a creator's fan edges that form the fan sample.
FAN_SAMPLE_FRACTION = 0.1
# Node class used by the graph export.
EXPORT_CLASS = "marked"
# PageRank: reset probability and tolerance; label propagation steps.
RESET_PROB = 0.15
TOLERANCE = 0.0001
LPA_STEPS = 40
# ---------------------------------------------------------------------------


def to_long(c: Column | str, source_type: T.DataType | None = None) -> Column:
    """Any value -> string -> 64-bit integer (ANSI mode raises on bad input).

    When the source column is already integral the detour through text is
    skipped (same value, no per-row string formatting and parsing)."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(source_type, T.IntegralType):
        return col.cast("long")
    return col.cast("string").cast("long")


def required(name: str) -> Column:
    """Column ``name``, which must not be null: a null ends the query with an error."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"null in column {name}")).cast("long")) \
        .alias(name)


def to_str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def floor_fraction(n: Column, fraction: float) -> Column:
    """floor(fraction * n) as a long (the fan-sample size)."""
    return F.floor(n * F.lit(fraction)).cast("long")


def size_band(n: Column) -> Column:
    """Community size band label: 1, 2-4, 5-9, 10+."""
    return (F.when(n == 1, F.lit(SIZE_BANDS[0]))
            .when(n < 5, F.lit(SIZE_BANDS[1]))
            .when(n < 10, F.lit(SIZE_BANDS[2]))
            .otherwise(F.lit(SIZE_BANDS[3])))


def members_line(key: Column, members: Column) -> Column:
    """Format ``key->a,b,c`` for a (bounded) list of members."""
    return F.concat(key.cast("string"), F.lit("->"), F.array_join(members, ","))


def edge_key(src: Column, dst: Column) -> Column:
    """Unambiguous edge id ``src-dst`` (plain concatenation would confuse 1,23 and 12,3)."""
    return F.concat_ws("-", src.cast("string"), dst.cast("string"))


def round6(c: Column) -> Column:
    """Output rounding for floating results."""
    return F.round(c, 6)


def tie_key(c: Column) -> Column:
    """Ranking key for ties: rank rounded to 9 places (summation order moves the last bits)."""
    return F.round(c, 9)
