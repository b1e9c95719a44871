"""The order of JSON values, as binary keys that compare byte by byte."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _encoder() -> Callable[[Any], bytes | None]:
    """Made of closures only, so that it reaches the executors by value."""

    def text(s: str) -> bytes:
        # a text ends lower than any text that goes on
        return s.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\1"

    def number(x: int | float) -> bytes:
        rest = 0
        if isinstance(x, int):
            if -(1 << 63) <= x < 1 << 64:
                rest = x - int(float(x))
            try:
                x = float(x)
            except OverflowError:
                x = float("inf") if x > 0 else float("-inf")
        bits = struct.unpack(">Q", struct.pack(">d", x))[0]
        bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
        return struct.pack(">QH", bits, rest + 0x8000)

    def value(v: Any) -> bytes:
        if v is None:
            return b"\1"
        if isinstance(v, bool):
            return b"\2\1" if v else b"\2\0"
        if isinstance(v, (int, float)):
            return b"\3" + number(v)
        if isinstance(v, str):
            return b"\4" + text(v)
        if isinstance(v, list):
            return b"\5" + b"".join(map(value, v)) + b"\0"
        return b"\6" + b"".join(b"\1" + text(k) + value(v[k]) for k in sorted(v)) + b"\0"

    def no_constant(name: str) -> None:
        raise ValueError(name)

    def key(document: str | None) -> bytes | None:
        if document is None:
            return None
        try:
            return value(json.loads(document, parse_constant=no_constant))
        except (ValueError, RecursionError):
            return None

    return key


def literal_key(document: str) -> bytes:
    """The key of a literal's text."""
    return _encoder()(document)


def json_key(c: Column) -> Column:
    """A binary key in the order of JSON values.

    null, booleans (false first), numbers, texts (by code point), arrays (by elements, a prefix
    first), objects (by their sorted keys, each with its value, a prefix first). Numbers compare by
    value: 1 and 1.0 have one key, and whole numbers of 64 bits are exact. NULL and unparsable texts
    have a NULL key. Spark has no order for nested JSON, so this one is computed in Arrow batches,
    and only for columns that are ordered or compared.
    """
    key = _encoder()

    def keys(documents: pd.Series) -> pd.Series:
        return documents.map(key)

    keys.__annotations__ = {"documents": pd.Series, "return": pd.Series}
    return F.pandas_udf(keys, "binary")(c)
