"""Schema migrations: snapshot difference, plan, policy, and one atomic application."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import types as K
from .errors import ConstraintViolation, DestructiveOperation, IncompatibleType, MigrationError, MissingDefault, TransformFailed
from .schema import RID, Catalog, TableDef, digest
from .sources.warehouse import Warehouse

#: Kinds of operations, in the order in which a plan runs them.
ORDER = ("create_table", "drop_index", "drop_column", "rename_column", "relax_column", "widen_column", "transform_column", "add_column", "tighten_column", "add_index", "drop_table")
DESTRUCTIVE = ("drop_table", "drop_column")
_FLAGS = ("nullable", "unique", "auto_increment", "primary_key", "foreign_key")


@dataclass(frozen=True)
class Op:
    kind: str
    table: str
    column: str | None = None
    detail: Any = None

    @property
    def destructive(self) -> bool:
        return self.kind in DESTRUCTIVE


def diff(old: dict, catalog: Catalog) -> list[Op]:
    """Operations that lead from stored snapshots to the catalog."""
    ops = [Op("drop_table", name) for name in old if name not in catalog]
    for name, table in catalog.items():
        new = table.snapshot()
        if name not in old:
            ops.append(Op("create_table", name))
            continue
        was, taken = {c["name"]: c for c in old[name]["columns"]}, set()
        for c in new["columns"]:
            before = was.get(c["name"])
            if before is None:
                source = next((o for o in table[c["name"]].renamed_from if o in was and o not in table), None)
                if source is None:
                    ops.append(Op("add_column", name, c["name"]))
                    continue
                ops.append(Op("rename_column", name, c["name"], source))
                before = was[source]
            taken.add(before["name"])
            if (before["kind"], before["type"], before["tag"]) != (c["kind"], c["type"], c["tag"]):
                ops.append(Op("widen_column" if _widens(before, c) else "transform_column", name, c["name"], [before["type"], c["type"]]))
            changed = {f: [before[f], c[f]] for f in _FLAGS if before[f] != c[f]}
            tight = {f: v for f, v in changed.items() if (f == "nullable" and not v[1]) or (f in ("unique", "primary_key", "foreign_key") and v[1])}
            if tight:
                ops.append(Op("tighten_column", name, c["name"], tight))
            if loose := {f: v for f, v in changed.items() if f not in tight}:
                ops.append(Op("relax_column", name, c["name"], loose))
        ops += [Op("drop_column", name, c) for c in was if c not in taken]
        one, two = ({(tuple(sorted(c)), u) for c, u in x["indexes"]} for x in (old[name], new))
        ops += [Op("drop_index", name, None, list(i)) for i in sorted(one - two)] + [Op("add_index", name, None, list(i)) for i in sorted(two - one)]
    return ops


def _widens(a: dict, b: dict) -> bool:
    return a["kind"] in K.KINDS and b["kind"] in K.KINDS and K.widens(K.KINDS[a["kind"]], K.KINDS[b["kind"]])


def plan(old: dict, catalog: Catalog) -> list[Op]:
    return sorted(diff(old, catalog), key=lambda op: ORDER.index(op.kind))


def apply(warehouse: Warehouse, catalog: Catalog, allow_destructive: bool = False) -> list[Op]:
    """Rewrite each changed table once, check it, and swap one manifest with the new snapshots."""
    manifest = warehouse.manifest()
    ops = plan(manifest["snapshots"], catalog)
    if not allow_destructive and (bad := [o for o in ops if o.destructive]):
        raise DestructiveOperation(", ".join(f"{o.kind} {o.table} {o.column or ''}".strip() for o in bad))
    images: dict[str, DataFrame] = {}
    tighten: list[Op] = []
    for op in ops:
        if op.kind == "create_table":
            manifest["tables"].setdefault(op.table, {"parts": [], "autoincrement": {}})
        elif op.kind == "drop_table":
            manifest["tables"].pop(op.table, None)
        elif op.kind.endswith("_column"):
            df = images.get(op.table)
            if df is None:
                df = _stored(warehouse, manifest, op.table)
            images[op.table] = _step(df, op, catalog[op.table])
            if op.kind in ("tighten_column", "add_column"):
                tighten.append(op)
    written: list[str] = []
    try:
        for name, df in images.items():
            t = catalog[name]
            part = warehouse.write(name, df.select(*[F.col(f"`{c.name}`").cast(c.kind.spark).alias(c.name) for c in t.columns], RID))
            written.append(part)
            manifest["tables"][name] = {"autoincrement": manifest["tables"].get(name, {}).get("autoincrement", {}), "parts": [part]}
        for op in tighten:
            _check(warehouse, manifest, catalog, op)
        snapshot = catalog.snapshot()
        warehouse.commit(manifest | {"snapshots": snapshot, "hash": digest(snapshot)})
    except MigrationError:
        for part in written:
            warehouse.drop_part(part)
        raise
    except Exception as e:
        for part in written:
            warehouse.drop_part(part)
        raise TransformFailed(str(e).splitlines()[0]) from e
    return ops


def _stored(warehouse: Warehouse, manifest: dict, name: str) -> DataFrame:
    columns = manifest["snapshots"][name]["columns"]
    schema = ", ".join(f"`{c['name']}` {c['type']}" for c in columns) + f", {RID} long"
    parts = manifest["tables"].get(name, {}).get("parts", [])
    if not parts:
        return warehouse.spark.createDataFrame([], schema)
    return warehouse.spark.read.schema(schema).parquet(*[f"{warehouse.root}/{p}" for p in parts])


def _step(df: DataFrame, op: Op, t: TableDef) -> DataFrame:
    if op.kind == "drop_column":
        return df.drop(op.column)
    if op.kind == "rename_column":
        return df.withColumnRenamed(op.detail, op.column)
    if op.kind == "widen_column":
        return df.withColumn(op.column, F.col(f"`{op.column}`").cast(t[op.column].kind.spark))
    if op.kind == "transform_column":
        hook = t.transforms.get(op.column)
        if hook is None:
            raise IncompatibleType(f"{t.name}.{op.column}: {op.detail[0]} to {op.detail[1]} needs a transform")
        x = F.col(f"`{op.column}`")
        made = hook(x)
        failed = F.raise_error(F.lit(f"{t.name}.{op.column}: the transform gave no value"))
        return df.withColumn(op.column, F.when(x.isNull(), F.lit(None)).when(made.isNull(), failed).otherwise(made).cast(t[op.column].kind.spark))
    if op.kind == "add_column":
        c = t[op.column]
        value = t.defaults.get(op.column, c.default)
        if callable(value):
            value = value()
        if value is None and not c.nullable:
            if df.isEmpty():
                return df.withColumn(op.column, F.lit(None).cast(c.kind.spark))
            raise MissingDefault(f"{t.name}.{op.column}")
        return df.withColumn(op.column, F.lit(c.kind.literal(value)).cast(c.kind.spark))
    return df


def _check(warehouse: Warehouse, manifest: dict, catalog: Catalog, op: Op) -> None:
    t, c = catalog[op.table], catalog[op.table][op.column]
    df, x = warehouse.read(manifest, t), F.col(f"`{op.column}`")
    flags = {"unique": c.unique, "primary_key": c.primary_key, "foreign_key": bool(c.foreign_key), "nullable": c.nullable} if op.kind == "add_column" else {f: bool(v[1]) for f, v in op.detail.items()}
    if flags.get("nullable") is False and not df.where(x.isNull()).isEmpty():
        raise ConstraintViolation(f"{t.name}.{op.column} holds NULL")
    if (flags.get("unique") or flags.get("primary_key")) and not df.groupBy(x).count().where("count > 1").isEmpty():
        raise ConstraintViolation(f"{t.name}.{op.column} holds repeated values")
    if flags.get("foreign_key"):
        there = warehouse.read(manifest, catalog[c.foreign_key.table]).select(F.col(f"`{c.foreign_key.column}`").alias("__k"))
        if not df.where(x.isNotNull()).join(there, x == F.col("__k"), "left_anti").isEmpty():
            raise ConstraintViolation(f"{t.name}.{op.column} refers to missing rows")


__all__ = ["Op", "apply", "diff", "plan"]
