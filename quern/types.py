"""Column types: Spark type, place of NULL in the order, literals and ranges."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidQuery


@dataclass(frozen=True)
class Kind:
    """A column type. null_high: NULL is greater than its values, else smaller."""

    name: str
    spark: T.DataType
    null_high: bool
    low: int | None = None
    high: int | None = None
    tag: str | None = None

    @property
    def integer(self) -> bool:
        return self.low is not None

    @property
    def numeric(self) -> bool:
        return self.integer or self.name in ("decimal", "float32", "float64")

    def literal(self, value: Any) -> Any:
        """A Python value coerced to this type; an impossible one is an InvalidQuery."""
        if value is None:
            return None
        try:
            if self.integer:
                if isinstance(value, bool) or int(value) != value or not self.low <= value <= self.high:
                    raise ValueError
                return int(value)
            if self.name == "decimal":
                return Decimal(str(value))
            if self.name in ("float32", "float64"):
                return float(value)
            if self.name == "boolean":
                if not isinstance(value, bool):
                    raise ValueError
                return value
            if self.name == "uuid":
                return str(uuid.UUID(str(value)))
            if self.name == "json":
                return canonical_json(value)
            if self.name == "date":
                return value if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else dt.date.fromisoformat(value)
            if self.name == "datetime":
                return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
            if self.name == "blob":
                return bytes(value)
            if self.name == "text" and not isinstance(value, str):
                raise ValueError
            return value
        except (TypeError, ValueError, ArithmeticError):
            raise InvalidQuery(f"{value!r} is not a value of type {self.name}") from None


def canonical_json(value: Any) -> str:
    """Text with sorted keys, so that equal documents are equal keys."""
    return json.dumps(json.loads(value) if isinstance(value, str) else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _int(name: str, spark: T.DataType, bits: int, signed: bool) -> Kind:
    return Kind(name, spark, signed, -(1 << bits - 1) if signed else 0, (1 << bits - signed) - 1)


INT8, INT16, INT32, INT64 = (_int(f"int{b}", t, b, True) for b, t in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())))
UINT8, UINT16, UINT32, UINT64 = (_int(f"uint{b}", t, b, False) for b, t in ((8, T.ShortType()), (16, T.IntegerType()), (32, T.LongType()), (64, T.DecimalType(20, 0))))
BOOLEAN = Kind("boolean", T.BooleanType(), True)
TEXT = Kind("text", T.StringType(), False)
BLOB = Kind("blob", T.BinaryType(), True)
DATE = Kind("date", T.DateType(), True)
#: Local fields; a companion column holds the offset where one is kept.
DATETIME = Kind("datetime", T.TimestampNTZType(), True)
UUID = Kind("uuid", T.StringType(), False)
JSON = Kind("json", T.StringType(), True)
FLOAT32, FLOAT64 = Kind("float32", T.FloatType(), True), Kind("float64", T.DoubleType(), True)


def decimal(scale: int = 10, precision: int = 38) -> Kind:
    return Kind("decimal", T.DecimalType(precision, scale), True)


def custom(tag: str, spark: T.DataType | None = None) -> Kind:
    """A type of the user's own: stored in its encoding, whose order is the type's order."""
    return Kind("custom", spark or T.BinaryType(), False, tag=tag)


#: Kinds by name, for snapshots.
KINDS = {k.name: k for k in (INT8, INT16, INT32, INT64, UINT8, UINT16, UINT32, UINT64, BOOLEAN, TEXT, BLOB, DATE, DATETIME, UUID, JSON, FLOAT32, FLOAT64)}


def widens(old: Kind, new: Kind) -> bool:
    """Each value of an integer type fits the other one."""
    return old.integer and new.integer and old != new and new.low <= old.low and old.high <= new.high
