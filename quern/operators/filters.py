"""Filters lowered to boolean Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as K
from ..errors import InvalidQuery
from ..functions.json_order import json_key, literal_key
from ..functions.patterns import json_predicate, like_regex
from ..query import Filter, Json

#: Finds a name: its Column, its type, and whether it can be NULL.
Scope = Callable[[str], tuple[Column, K.Kind, bool]]


def to_column(f: Filter, scope: Scope, ansi: bool = False, positive: bool = True) -> Column:
    """The filter as a Column.

    NULL is an ordinary value: it equals NULL, and is above or below a type's values as the type
    says (ansi: comparisons with it do not match). In positive position a comparison stays bare, so that it reaches the
    scan as a pushed filter; under NOT it is made never-NULL.
    """
    if f.op in ("and", "or"):
        parts = [to_column(p, scope, ansi, positive) for p in f.parts]
        return reduce(lambda a, b: a & b if f.op == "and" else a | b, parts)
    if f.op == "not":
        return ~to_column(f.parts[0], scope, ansi, False)
    c, kind, nullable = scope(f.column)
    safe = lambda x: x if positive or not nullable else F.coalesce(x, F.lit(False))
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "like":
        if kind.name != "text" or not isinstance(f.value, str):
            raise InvalidQuery(f"LIKE needs text: {f.column}")
        prefix = f.value.rstrip("%")
        if f.value.endswith("%") and not any(x in prefix for x in "%_\\"):
            return safe(c.startswith(prefix))
        return safe(c.rlike(like_regex(f.value)))
    if f.op == "json":
        if kind.name != "json" or not isinstance(f.value, Json):
            raise InvalidQuery(f"a JSON filter needs a JSON column: {f.column}")
        return json_predicate(c, f.value)
    if f.op == "in":
        values = [kind.literal(v) for v in f.value]
        known = [F.lit(v).cast(kind.spark) for v in values if v is not None]
        out = safe(c.isin(known)) if known else F.lit(False)
        return out | c.isNull() if None in values else out
    value = kind.literal(f.value)
    if value is None:
        if f.op in ("eq", "ne"):
            return c.isNull() if f.op == "eq" else c.isNotNull()
        strict = c.isNotNull() if (f.op in ("gt", "ge")) != kind.null_high else F.lit(False)
        return F.lit(False) if ansi else strict | c.isNull() if f.op in ("ge", "le") else strict
    want = F.lit(value).cast(kind.spark)
    if f.op == "eq":
        return safe(c == want)
    if f.op == "ne":
        return safe(c != want) if ansi or not nullable else (c != want) | c.isNull()
    if f.op not in ("gt", "lt", "ge", "le"):
        raise InvalidQuery(f"unknown filter {f.op}")
    x = sort_key(c, kind)
    if kind.name == "json":
        want = F.lit(literal_key(value))
    compared = {"gt": x > want, "lt": x < want, "ge": x >= want, "le": x <= want}[f.op]
    if kind.name == "json":  # unparsable texts have no key
        compared = F.coalesce(compared, F.lit(False))
    if nullable and not ansi and (f.op in ("gt", "ge")) == kind.null_high:
        return compared | c.isNull()
    return safe(compared)


def sort_key(c: Column, kind: K.Kind) -> Column:
    """What the type's values are compared by: themselves, but JSON texts by a key."""
    return json_key(c) if kind.name == "json" else c


def order(c: Column, kind: K.Kind, ascending: bool) -> Column:
    """Sort order with NULL in its type's place."""
    c = sort_key(c, kind)
    last = kind.null_high == ascending
    if ascending:
        return c.asc_nulls_last() if last else c.asc_nulls_first()
    return c.desc_nulls_last() if last else c.desc_nulls_first()
