"""Table definitions and the catalog."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from . import types as K
from .errors import TableError, TableNotFound, UnknownColumn

RID = "_rid"


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: K.Kind
    nullable: bool = False
    primary_key: bool = False
    unique: bool = False
    auto_increment: bool = False
    foreign_key: ForeignKey | None = None
    default: Any = None
    #: Of a date-time: the column that holds its offset from UTC in minutes.
    offset: str | None = None
    renamed_from: tuple[str, ...] = ()
    sanitizers: tuple[Callable[[Column], Column], ...] = ()
    validators: tuple[Callable[[Column], Column], ...] = ()

    def snapshot(self) -> dict:
        spark = self.kind.spark.simpleString()
        fk = self.foreign_key
        return {"name": self.name, "kind": self.kind.name, "type": spark, "tag": self.kind.tag, "nullable": self.nullable, "primary_key": self.primary_key, "unique": self.unique, "auto_increment": self.auto_increment, "foreign_key": [fk.table, fk.column] if fk else None}


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    indexes: tuple[Index, ...] = ()
    #: Migration hooks: a value for an added column; a new Column from the old one.
    defaults: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)
    transforms: dict[str, Callable[[Column], Column]] = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if len({c.name for c in self.columns}) != len(self.columns):
            raise TableError(f"{self.name}: a column name repeats")
        for c in self.columns:
            if c.offset and (c.offset not in self or c.kind.name != "datetime" or not self[c.offset].kind.integer):
                raise TableError(f"{self.name}.{c.name}: its offset needs an integer column beside a date-time")

    def __getitem__(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise UnknownColumn(f"{self.name} has no column {name}")

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.primary_key), None)

    def foreign_keys(self, table: str | None = None) -> list[ColumnDef]:
        return [c for c in self.columns if c.foreign_key and table in (None, c.foreign_key.table)]

    def struct(self, rid: bool = False) -> T.StructType:
        fields = [T.StructField(c.name, c.kind.spark, True) for c in self.columns]
        return T.StructType(fields + ([T.StructField(RID, T.LongType(), True)] if rid else []))

    def snapshot(self) -> dict:
        found = {(i.columns, i.unique) for i in self.indexes} | {((c.name,), True) for c in self.columns if c.primary_key or c.unique}
        return {"name": self.name, "columns": [c.snapshot() for c in self.columns], "indexes": sorted([list(c), u] for c, u in found)}


class Catalog(dict):
    """Table definitions by name."""

    def __init__(self, *tables: TableDef):
        super().__init__({t.name: t for t in tables})

    def __missing__(self, name: str) -> TableDef:
        raise TableNotFound(name)

    def referencing(self, table: str) -> list[tuple[TableDef, ColumnDef]]:
        """Columns of all tables whose foreign key leads to `table`."""
        return [(t, c) for t in self.values() for c in t.foreign_keys(table)]

    def snapshot(self) -> dict:
        return {n: t.snapshot() for n, t in sorted(self.items())}


def digest(snapshot: dict) -> str:
    return hashlib.sha256(json.dumps(snapshot, sort_keys=True).encode()).hexdigest()
