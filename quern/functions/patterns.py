"""LIKE patterns and JSON paths."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..query import Json


def like_regex(pattern: str) -> str:
    """A whole-string regex: % is any run, _ one character, a backslash takes the next as it is; one at the end goes."""
    out, literal, chars = [], [], iter(pattern)

    def flush() -> None:
        if literal:
            out.append("\\Q" + "".join(literal).replace("\\E", "\\E\\\\E\\Q") + "\\E")
            literal.clear()

    for c in chars:
        if c == "\\":
            c = next(chars, "")
            literal.append(c)
        elif c in "%_":
            flush()
            out.append(".*" if c == "%" else ".")
        else:
            literal.append(c)
    flush()
    return f"(?s)\\A{''.join(out)}\\z"


def parse_path(path: str) -> list[str | int]:
    """Steps of a path like a.b[0].c or [0].a."""
    steps: list[str | int] = []
    if not path:
        raise InvalidQuery("the JSON path is empty")
    i, name_due = 0, True
    while i < len(path):
        c = path[i]
        if c == ".":
            if name_due or i + 1 == len(path):
                raise InvalidQuery(f"misplaced dot in JSON path {path!r}")
            i, name_due = i + 1, True
        elif c == "[":
            if steps and name_due:
                raise InvalidQuery(f"misplaced bracket in JSON path {path!r}")
            end = path.find("]", i)
            inner = path[i + 1 : end] if end > 0 else ""
            if not (inner.isascii() and inner.isdigit()):
                raise InvalidQuery(f"bad index in JSON path {path!r}")
            steps.append(int(inner))
            i, name_due = end + 1, False
        elif c == "]" or not name_due:
            raise InvalidQuery(f"stray character in JSON path {path!r}")
        else:
            end = min([k for k in (path.find(".", i), path.find("[", i), path.find("]", i)) if k >= 0], default=len(path))
            steps.append(path[i:end])
            i, name_due = end, False
    if name_due:
        raise InvalidQuery(f"JSON path {path!r} ends early")
    return steps


def spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in steps)


def _at(v: Column, steps: list[str | int]) -> Column:
    return F.try_variant_get(v, spark_path(steps), "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _whole(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")


def _numeric(kind: Column) -> Column:
    return _whole(kind) | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _typed(v: Column, value: Any) -> tuple[Column, Column, Column]:
    """(the variant has the literal's type, the variant's value, the literal)."""
    if isinstance(value, bool):
        return _kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"), F.lit(value)
    if isinstance(value, (int, float, Decimal)):
        return _numeric(_kind(v)), F.try_variant_get(v, "$", "decimal(38,10)"), F.lit(Decimal(str(value))).cast("decimal(38,10)")
    if isinstance(value, str):
        return _kind(v) == "STRING", F.try_variant_get(v, "$", "string"), F.lit(value)
    raise InvalidQuery(f"{value!r} can't be compared with JSON values")


def _contains(v: Column, needle: Any) -> Column:
    """v holds needle: objects by keys, arrays by elements in any order, an array also a scalar."""
    no = F.lit(False)
    if isinstance(needle, dict):
        out = F.coalesce(_kind(v).startswith("OBJECT"), no)
        for key, x in needle.items():
            out = out & _contains(_at(v, [key]), x)
        return out
    elements = F.try_variant_get(v, "$", "array<variant>")
    is_array = F.coalesce(_kind(v).startswith("ARRAY"), no)
    if isinstance(needle, list):
        out = is_array
        for x in needle:
            out = out & F.coalesce(F.exists(elements, _holds(x)), no)
        return out
    return _equal(v, needle) | (is_array & F.coalesce(F.exists(elements, lambda e: _equal(e, needle)), no))


def _holds(needle: Any):
    return lambda e: _contains(e, needle)


def _equal(v: Column, value: Any) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    same, got, want = _typed(v, value)
    if not isinstance(value, (bool, str)):  # 1 and 1.0 are different numbers
        whole = _whole(_kind(v))
        same = same & (whole if isinstance(value, int) else ~whole)
    return F.coalesce(same & (got == want), F.lit(False))


def _once(v: Column, predicate: Callable[[Column], Column]) -> Column:
    """The predicate of a value that is worked out once a row: a filter shares no subexpressions. Pays where it is named many times."""
    return F.exists(F.array(v), predicate)


def json_predicate(c: Column, f: Json) -> Column:
    """Never-NULL predicate over a JSON text column; NULL and unparsable texts do not match."""
    v, no = F.try_parse_json(c), F.lit(False)
    if f.op == "contains":
        needle = json.loads(f.value) if isinstance(f.value, str) else f.value
        return F.coalesce(_contains(v, needle), no)
    at = _at(v, parse_path(f.path))
    if f.op == "has_key":
        return at.isNotNull()
    is_null = lambda x: F.coalesce(F.is_variant_null(x), no)
    if f.op == "is_null":
        return c.isNotNull() & (at.isNull() | is_null(at))
    if f.op == "not_null" or (f.op == "ne" and f.value is None):
        return at.isNotNull() & ~is_null(at)
    if f.op == "in":
        return _once(at, lambda x: reduce(lambda a, b: a | b, [is_null(x) if y is None else _loose(x, y, "eq") for y in f.value], no))
    if f.value is None:
        return is_null(at) if f.op == "eq" else no
    if f.op == "ne":
        return at.isNotNull() & ~_loose(at, f.value, "eq")
    # an explicit null is above numbers and booleans, and below text
    high = not isinstance(f.value, str)
    null_too = f.op in (("gt", "ge") if high else ("lt", "le"))
    return _loose(at, f.value, f.op) | (is_null(at) if null_too else no)


def _loose(v: Column, value: Any, op: str) -> Column:
    same, got, want = _typed(v, value)
    compared = {"eq": got == want, "gt": got > want, "lt": got < want, "ge": got >= want, "le": got <= want}[op]
    return F.coalesce(same & compared, F.lit(False))
