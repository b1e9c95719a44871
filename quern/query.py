"""The query language: filters, JSON filters, aggregates, and a builder. All of it goes to JSON and back."""

from __future__ import annotations

import base64
import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal
from typing import Any


#: Literals that JSON has no form for: by tag, the type, how it is written, how it is read.
_TYPED = {
    "datetime": (dt.datetime, dt.datetime.isoformat, dt.datetime.fromisoformat), "date": (dt.date, dt.date.isoformat, dt.date.fromisoformat),
    "decimal": (Decimal, str, Decimal), "uuid": (uuid.UUID, str, uuid.UUID),
    "blob": ((bytes, bytearray), lambda x: base64.b64encode(x).decode(), lambda x: base64.b64decode(x, validate=True)),
}


def literal_to_json(value: Any) -> Any:
    """A literal as JSON: plain, or {"type": tag, "value": text}; sequences by element."""
    if isinstance(value, (list, tuple)):
        return [literal_to_json(x) for x in value]
    for tag, (kind, write, _) in _TYPED.items():
        if isinstance(value, kind):
            return {"type": tag, "value": write(value)}
    return value


def literal_from_json(x: Any) -> Any:
    if isinstance(x, list):
        return tuple(literal_from_json(v) for v in x)
    if isinstance(x, dict) and set(x) == {"type", "value"}:
        return _TYPED[x["type"]][2](x["value"])
    return x


@dataclass(frozen=True)
class Json:
    """op: contains (value), has_key (path), or a comparison of what a path leads to."""

    op: str
    path: str | None = None
    value: Any = None

    @classmethod
    def contains(cls, value: Any) -> Json:
        return cls("contains", None, value)

    @classmethod
    def has_key(cls, path: str) -> Json:
        return cls("has_key", path)

    @classmethod
    def extract(cls, path: str, op: str, value: Any = None) -> Json:
        """op: eq ne gt lt ge le in is_null not_null."""
        return cls(op, path, value)


@dataclass(frozen=True)
class Filter:
    op: str
    column: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def and_(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def or_(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def not_(self) -> Filter:
        return Filter("not", parts=(self,))

    __and__, __or__, __invert__ = and_, or_, not_

    def to_json(self) -> dict:
        out: dict = {"op": self.op}
        if self.parts:
            return out | {"parts": [p.to_json() for p in self.parts]}
        value = {"json": asdict(self.value)} if isinstance(self.value, Json) else literal_to_json(self.value)
        return out | {"column": self.column, "value": value}

    @classmethod
    def from_json(cls, x: dict) -> Filter:
        if "parts" in x:
            return cls(x["op"], parts=tuple(map(cls.from_json, x["parts"])))
        value = x.get("value")
        if isinstance(value, dict) and set(value) == {"json"}:
            return cls(x["op"], x["column"], Json(**value["json"]))
        return cls(x["op"], x["column"], literal_from_json(value))


def _compare(op: str):
    return lambda column, value: Filter(op, column, value)


eq, ne, gt, lt, ge, le, like, json_filter = map(_compare, ("eq", "ne", "gt", "lt", "ge", "le", "like", "json"))


def in_(column: str, values) -> Filter:
    return Filter("in", column, tuple(values))


def is_null(column: str) -> Filter:
    return Filter("is_null", column)


def not_null(column: str) -> Filter:
    return Filter("not_null", column)


@dataclass(frozen=True)
class Join:
    how: str
    table: str
    left: str
    right: str


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None


def count(column: str | None = None) -> Aggregate:
    return Aggregate("count", column)


def _aggregate(name: str):
    return lambda column: Aggregate(name, column)


sum_, avg, min_, max_ = map(_aggregate, ("sum", "avg", "min", "max"))


@dataclass(frozen=True)
class Query:
    columns: tuple[str, ...] | None = None
    eager: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()
    where: Filter | None = None
    distinct: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    having: Filter | None = None
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None

    def to_json(self) -> str:
        x = asdict(self) | {"where": self.where and self.where.to_json(), "having": self.having and self.having.to_json()}
        return json.dumps(x)

    @classmethod
    def from_json(cls, text: str) -> Query:
        x = json.loads(text)
        for k in ("eager", "distinct", "group_by"):
            x[k] = tuple(x[k])
        x |= {"columns": None if x["columns"] is None else tuple(x["columns"]), "joins": tuple(Join(**j) for j in x["joins"]), "order_by": tuple(map(tuple, x["order_by"]))}
        x |= {k: x[k] and Filter.from_json(x[k]) for k in ("where", "having")}
        return cls(**x)


@dataclass(frozen=True)
class QueryBuilder:
    query: Query = field(default_factory=Query)

    def _with(self, **changes) -> QueryBuilder:
        return QueryBuilder(replace(self.query, **changes))

    def build(self) -> Query:
        return self.query

    def all(self) -> QueryBuilder:
        return self._with(columns=None)

    def field(self, name: str) -> QueryBuilder:
        return self.fields(name)

    def fields(self, *names: str) -> QueryBuilder:
        return self._with(columns=tuple(dict.fromkeys((*(self.query.columns or ()), *names))))

    def with_(self, table: str) -> QueryBuilder:
        return self._with(eager=tuple(dict.fromkeys((*self.query.eager, table))))

    def _join(self, how: str, table: str, left: str, right: str) -> QueryBuilder:
        return self._with(joins=(*self.query.joins, Join(how, table, left, right)))

    def inner_join(self, table: str, left: str, right: str) -> QueryBuilder:
        return self._join("inner", table, left, right)

    def left_join(self, table: str, left: str, right: str) -> QueryBuilder:
        return self._join("left", table, left, right)

    def right_join(self, table: str, left: str, right: str) -> QueryBuilder:
        return self._join("right", table, left, right)

    def full_join(self, table: str, left: str, right: str) -> QueryBuilder:
        return self._join("full", table, left, right)

    def distinct(self, *columns: str) -> QueryBuilder:
        return self._with(distinct=columns)

    def group_by(self, *columns: str) -> QueryBuilder:
        return self._with(group_by=columns)

    def having(self, f: Filter) -> QueryBuilder:
        return self._with(having=f)

    def order_by_asc(self, column: str) -> QueryBuilder:
        return self._with(order_by=(*self.query.order_by, (column, True)))

    def order_by_desc(self, column: str) -> QueryBuilder:
        return self._with(order_by=(*self.query.order_by, (column, False)))

    def limit(self, n: int) -> QueryBuilder:
        return self._with(limit=n)

    def offset(self, n: int) -> QueryBuilder:
        return self._with(offset=n)

    def filter(self, f: Filter | None) -> QueryBuilder:
        return self._with(where=f)

    def and_where(self, f: Filter) -> QueryBuilder:
        return self._with(where=self.query.where & f if self.query.where else f)

    def or_where(self, f: Filter) -> QueryBuilder:
        return self._with(where=self.query.where | f if self.query.where else f)


def builder() -> QueryBuilder:
    return QueryBuilder()
