"""Sanitizers: Column to Column, NULL stays NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Sanitizer = Callable[[Column], Column]
_EDGES = r"(?U)^\s+|\s+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", "-"), r"[^\p{L}\p{N}-]", "")


def url_encode(c: Column) -> Column:
    """Every byte but ASCII letters and digits is percent-encoded."""
    out = F.url_encode(c)
    for plain, coded in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clamp(low: int, high: int) -> Sanitizer:
    return lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


clamp_unsigned = clamp


def round_to_scale(scale: int) -> Sanitizer:
    """Half goes to the even neighbour."""
    return lambda c: F.bround(c, scale)


def timezone(target: int, current: Column | int | None = None) -> Sanitizer:
    """Local fields moved from the current offset (minutes) to the target's.

    Without a current offset it is that of the column's own offset column (else 0), which a write
    sets to the target where there is a date-time.
    """

    def move(c: Column, stored: Column | None = None) -> Column:
        now = current if current is not None else 0 if stored is None else F.coalesce(stored, F.lit(0))
        return F.timestamp_add("MINUTE", F.lit(target) - (now if isinstance(now, Column) else F.lit(now)), c)

    move.offset = target
    return move


def utc(current: Column | int | None = None) -> Sanitizer:
    return timezone(0, current)
