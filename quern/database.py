"""The engine's face: queries, writes, transactions, migrations, permissions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import acl as A
from . import migrations
from .errors import (
    AutoincrementOverflow, BrokenForeignKeyReference, ForeignKeyConstraintViolation, InvalidQuery, MissingNonNullableField, PrimaryKeyConflict,
    SanitizeError, SchemaDrift, TransactionError, UniqueViolation, ValidationError,
)
from .operators import relational
from .operators.filters import to_column
from .query import Aggregate, Filter, Query
from .schema import RID, Catalog, ColumnDef, TableDef, digest
from .sources.warehouse import Warehouse, numbered

RESTRICT, CASCADE = "restrict", "cascade"
Rows = DataFrame | list[dict[str, Any]] | dict[str, Any]


class Images:
    """Tables as a statement or a transaction sees them: committed parts, rows added, or a whole new image."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read = read
        self.added: dict[str, list[DataFrame]] = {}
        self.whole: dict[str, DataFrame] = {}
        #: Committed parts of a replaced table in which nothing changed, which stay as they are.
        self.untouched: dict[str, list[str]] = {}

    def read(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, self.added.get(name, []), self.whole.get(name) if name in self.whole else self._read(name))

    def add(self, name: str, rows: DataFrame) -> None:
        self.added.setdefault(name, []).append(rows)

    def replace(self, name: str, image: DataFrame) -> None:
        self.whole[name] = image
        self.added.pop(name, None)


@dataclass
class Transaction:
    id: int
    owner: str | None
    ops: list[Callable[[Images, bool], int]] = field(default_factory=list)


class Database:
    """A session over a catalog.

    With `root`, tables are managed in a versioned warehouse; with `frames`, they are read-only
    external frames. `identity` is checked against the stored grants, where there are any.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str | None = None, frames: dict[str, DataFrame] | None = None, identity: str | None = None, ansi: bool = False):
        self.spark, self.catalog, self.identity, self.ansi = spark, catalog, identity, ansi
        self.frames = {} if frames is None else frames
        self.warehouse = Warehouse(spark, root) if root else None
        self.transaction: Transaction | None = None
        if self.warehouse and self.warehouse.manifest()["hash"] is None:
            snapshot = catalog.snapshot()
            self.warehouse.commit(self.warehouse.manifest() | {"snapshots": snapshot, "hash": digest(snapshot)})

    # reads

    def _gate(self, table: str, bit: int) -> None:
        self.catalog[table]
        if not self.warehouse:
            return
        manifest = self.warehouse.manifest()
        if manifest["hash"] != digest(self.catalog.snapshot()):
            raise SchemaDrift("the tables' stored schema differs; migrate first")
        if (acl := A.Acl.of(manifest["acl"])) is not None:
            acl.require(self.identity, table, bit)

    def _base(self) -> Callable[[str], DataFrame]:
        if not self.warehouse:
            return lambda name: self.frames[self.catalog[name].name]
        manifest = self.warehouse.manifest()
        return lambda name: self.warehouse.read(manifest, self.catalog[name])

    def _reader(self) -> Callable[[str], DataFrame]:
        images = Images(self._base())
        for op in self.transaction.ops if self.transaction else ():
            op(images, False)
        return images.read

    def select(self, table: str, query: Query | None = None, early: bool = False) -> DataFrame:
        """early: a page without an order may be any page, and the scan stops when it is full."""
        self._gate(table, A.READ)
        return relational.select(self.catalog, self._reader(), table, query or Query(), self.ansi, early)

    def select_raw(self, table: str, query: Query | None = None) -> DataFrame:
        """The table's own columns only."""
        df = self.select(table, query)
        return df.select(*[F.col(f"`{c}`") for c in self.catalog[table].names if c in df.columns])

    def select_join(self, table: str, query: Query) -> DataFrame:
        for name in (table, *[j.table for j in query.joins]):
            self._gate(name, A.READ)
        return relational.select_join(self.catalog, self._reader(), table, query, self.ansi)

    def run(self, table: str, query: Query) -> DataFrame:
        return (self.select_join if query.joins else self.select_raw)(table, query)

    def aggregate(self, table: str, query: Query, *functions: Aggregate) -> DataFrame:
        self._gate(table, A.READ)
        return relational.aggregate(self.catalog, self._reader(), table, query, list(functions), self.ansi)

    # foreign keys

    def orphans(self, table: str, column: str) -> DataFrame:
        """The table's rows whose foreign key leads to no row."""
        self._gate(table, A.READ)
        return self._orphans(Images(self._reader()), self.catalog[table], self.catalog[table][column], self._reader()(table))

    def referenced(self, table: str, child: str, column: str) -> DataFrame:
        """The table's rows that a row of the child leads to by its foreign key."""
        self._gate(table, A.READ)
        self._gate(child, A.READ)
        read, c = self._reader(), self.catalog[child][column]
        return read(table).join(read(child).select(F.col(f"`{column}`").alias("__k")), F.col(f"`{c.foreign_key.column}`") == F.col("__k"), "left_semi")

    def _orphans(self, images: Images, t: TableDef, c: ColumnDef, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """Of the rows, those whose key is in neither the parent table's image nor `more` rows of it. NULL leads nowhere and is allowed."""
        there = images.read(c.foreign_key.table).select(F.col(f"`{c.foreign_key.column}`").alias("__k"))
        if more is not None:
            there = there.union(more.select(F.col(f"`{c.foreign_key.column}`")))
        return rows.where(F.col(f"`{c.name}`").isNotNull()).join(there, F.col(f"`{c.name}`") == F.col("__k"), "left_anti")

    # writes

    def insert(self, table: str, rows: Rows) -> int:
        self._gate(table, A.INSERT)
        staged, n = self._staged(self.catalog[table], rows)
        return self._apply(lambda images, check: self._insert(images, self.catalog[table], staged, n, check), self._check_insert(table, staged))

    def update(self, table: str, patch: dict[str, Any], where: Filter | None = None) -> int:
        self._gate(table, A.UPDATE)
        t = self.catalog[table]
        for name in patch:
            t[name]
        return self._apply(lambda images, check: self._update(images, t, patch, where, check))

    def delete(self, table: str, behavior: str = RESTRICT, where: Filter | None = None) -> int:
        self._gate(table, A.DELETE)
        if behavior not in (RESTRICT, CASCADE):
            raise InvalidQuery(behavior)
        return self._apply(lambda images, check: self._delete(images, self.catalog[table], behavior, where, check))

    def _apply(self, op: Callable[[Images, bool], int], early: Callable[[Images], None] | None = None) -> int:
        if not self.warehouse:
            raise InvalidQuery("external tables are read-only")
        if self.transaction:
            images = Images(self._base())
            for earlier in self.transaction.ops:
                earlier(images, False)
            if early:
                early(images)
            n = op(images, False)
            self.transaction.ops.append(op)
            return n
        return self._replay([op])[0]

    def _replay(self, ops: list[Callable[[Images, bool], int]]) -> list[int]:
        """Apply and check statements in order, write what changed, and swap the manifest once."""
        manifest = self.warehouse.manifest()
        images = Images(lambda name: self.warehouse.read(manifest, self.catalog[name]))
        written: list[str] = []
        try:
            counts = []
            for op in ops:
                counts.append(op(images, True))
                for name, image in list(images.whole.items()):
                    if f"{name}/" not in image.__dict__.get("_part", ""):
                        part = self._write_image(images, name, manifest)
                        written.append(part)
                        kept = self.spark.read.schema(self.catalog[name].struct(rid=True)).parquet(*[f"{self.warehouse.root}/{p}" for p in (*images.untouched.get(name, ()), part)])
                        kept._part = part
                        images.replace(name, kept)
            latest = self.warehouse.manifest()
            replaced = {name: manifest["tables"].get(name, {}).get("parts", []) for name in images.whole}
            for name in {*images.whole, *images.added}:
                entry = latest["tables"].setdefault(name, {"parts": [], "autoincrement": {}})
                if name in images.whole:
                    # parts that others have added since stay; those that were read must all be there still
                    if missing := set(replaced[name]) - set(entry["parts"]):
                        raise TransactionError(f"another session has changed {name}: {len(missing)} of the parts read are gone")
                    kept = [p for p in entry["parts"] if p not in replaced[name] or p in images.untouched.get(name, ())]
                    entry["parts"] = [*kept, images.whole[name]._part]
                for rows in images.added.get(name, []):
                    entry["parts"] = [*entry["parts"], rows._part]
            self.warehouse.commit(latest)
            return counts
        except Exception:
            for part in written:
                self.warehouse.drop_part(part)
            raise

    def _write_image(self, images: Images, name: str, manifest: dict) -> str:
        """Write a table's new image, but not the rows of committed parts that the statements leave as they are.

        A first statement's image is compared with the committed parts by row number: a part stays
        where every row is still there and the same. Later statements of a transaction write what is left.
        """
        t, parts = self.catalog[name], manifest["tables"].get(name, {}).get("parts", [])
        new = images.read(name)
        if name in images.untouched or len(parts) < 2:
            images.untouched[name] = []
            return self.warehouse.write(name, new)
        # the folder of a row's file is its part
        at = F.element_at(F.split(F.input_file_name(), "/"), -2)
        sign = F.xxhash64(*[F.col(f"`{c.name}`") for c in t.columns])
        old = self.warehouse.read(manifest, t).select(F.col(RID).alias("__r"), at.alias("__part"), sign.alias("__sign"))
        now = new.select(F.col(RID).alias("__n"), sign.alias("__now"))
        changed = old.join(now, F.col("__r") == F.col("__n"), "left").where(F.col("__now").isNull() | (F.col("__now") != F.col("__sign")))
        touched = {r[0] for r in changed.select("__part").distinct().collect()}  # names of parts, which the manifest holds as well
        images.untouched[name] = kept = [p for p in parts if p.rpartition("/")[2] not in touched]
        if kept:
            still = self.spark.read.schema(t.struct(rid=True)).parquet(*[f"{self.warehouse.root}/{p}" for p in kept]).select(F.col(RID).alias("__r"))
            new = new.join(still, F.col(RID) == F.col("__r"), "left_anti")
        return self.warehouse.write(name, new)

    def _staged(self, t: TableDef, rows: Rows) -> tuple[DataFrame, int]:
        """New rows, complete, sanitized, numbered, and written as a part."""
        if not self.warehouse:
            raise InvalidQuery("external tables are read-only")
        if isinstance(rows, DataFrame):
            given, df = set(rows.columns), rows
        else:
            rows = [rows] if isinstance(rows, dict) else rows
            given = {k for r in rows for k in r}
            df = self.spark.createDataFrame([tuple(t[c].kind.literal(r.get(c)) for c in t.names) for r in rows], t.struct()).coalesce(1)
        for name in given:
            t[name]
        manifest = self.warehouse.manifest()
        values = {}
        for c in t.columns:
            x = F.col(f"`{c.name}`").cast(c.kind.spark) if c.name in df.columns else F.lit(None).cast(c.kind.spark)
            if c.default is not None and c.name not in given:
                x = F.lit(c.kind.literal(c.default() if callable(c.default) else c.default)).cast(c.kind.spark)
            values[c.name] = x
        raw = self.warehouse.write(t.name, df.select(*[x.alias(n) for n, x in self._sanitized(t, values).items()]))
        staged = self.spark.read.schema(t.struct()).parquet(f"{self.warehouse.root}/{raw}")
        n = staged.count()
        counters = manifest["tables"].setdefault(t.name, {"parts": [], "autoincrement": {}})["autoincrement"]
        for c in t.columns:
            if c.auto_increment:
                first = counters.get(c.name, 0) + 1
                if c.kind.integer and first + n - 1 > c.kind.high:
                    raise AutoincrementOverflow(f"{t.name}.{c.name}")
                staged = numbered(staged, "__next", first)
                staged = staged.withColumn(c.name, F.coalesce(F.col(f"`{c.name}`"), F.col("__next").cast(c.kind.spark))).drop("__next")
                counters[c.name] = first + n - 1
        staged = numbered(staged, RID, manifest["ids"])
        part = self.warehouse.write(t.name, staged.select(*t.names, F.col(RID).cast("long").alias(RID)))
        self.warehouse.drop_part(raw)
        # counters are never given back, not by a rollback either
        latest = self.warehouse.manifest()
        latest["ids"] = max(latest["ids"], manifest["ids"]) + n
        latest["tables"].setdefault(t.name, {"parts": [], "autoincrement": {}})["autoincrement"] |= counters
        self.warehouse.commit(latest)
        out = self.spark.read.schema(t.struct(rid=True)).parquet(f"{self.warehouse.root}/{part}")
        out._part = part
        return out, n

    def _sanitized(self, t: TableDef, values: dict[str, Column]) -> dict[str, Column]:
        """All columns of a row after their sanitizers; those that move a date-time also set its offset column."""
        out, offsets = {}, {}
        for c in t.columns:
            x, stored = values[c.name], values[c.offset] if c.offset else None
            try:
                for f in c.sanitizers:
                    target = getattr(f, "offset", None)
                    if target is None or stored is None:
                        x = f(x)
                    else:
                        x = f(x, stored)
                        stored = F.when(x.isNotNull(), F.lit(target)).otherwise(stored)
                        offsets[c.offset] = stored
            except Exception as e:
                raise SanitizeError(f"{c.name}: {e}") from e
            out[c.name] = x
        return {c.name: offsets.get(c.name, out[c.name]).cast(c.kind.spark) for c in t.columns}

    def _validate(self, t: TableDef, rows: DataFrame) -> None:
        bad = [F.max((F.col(f"`{c.name}`").isNotNull() & ~F.coalesce(v(F.col(f"`{c.name}`")), F.lit(False))).cast("int")).alias(f"{c.name}.{i}") for c in t.columns for i, v in enumerate(c.validators)]
        if bad:
            found = rows.agg(*bad).first().asDict()
            if wrong := [k for k, v in found.items() if v]:
                raise ValidationError(f"{t.name}: {', '.join(k.rpartition('.')[0] for k in wrong)}")

    def _check_keys(self, t: TableDef, image: DataFrame, rows: DataFrame) -> None:
        """Of the rows, whose table's image includes them: primary key, unique, foreign keys, presence."""
        for c in t.columns:
            if c.primary_key or c.unique:
                k = F.col(f"`{c.name}`")
                mine = rows.select(k.alias("__k")).distinct()
                twice = image.join(mine, k.eqNullSafe(F.col("__k")), "left_semi").groupBy(k).count().where("count > 1")
                if not twice.isEmpty():
                    raise (PrimaryKeyConflict if c.primary_key else UniqueViolation)(f"{t.name}.{c.name}")

    def _check_rest(self, t: TableDef, images: Images, rows: DataFrame) -> None:
        for c in t.foreign_keys():
            if not self._orphans(images, t, c, rows, rows if c.foreign_key.table == t.name else None).isEmpty():
                raise BrokenForeignKeyReference(f"{t.name}.{c.name}")
        needed = [F.col(f"`{c.name}`").isNull() for c in t.columns if not c.nullable]
        if needed and not rows.where(reduce(lambda a, b: a | b, needed)).isEmpty():
            raise MissingNonNullableField(t.name)

    def _check_insert(self, table: str, staged: DataFrame) -> Callable[[Images], None]:
        t = self.catalog[table]

        def check(images: Images) -> None:
            self._validate(t, staged)
            self._check_keys(t, images.read(table).unionByName(staged), staged)
            self._check_rest(t, images, staged)

        return check

    def _insert(self, images: Images, t: TableDef, staged: DataFrame, n: int, check: bool) -> int:
        if check:
            self._check_insert(t.name, staged)(images)
        images.add(t.name, staged)
        return n

    def _where(self, t: TableDef, where: Filter | None) -> Column:
        return F.lit(True) if where is None else F.coalesce(to_column(where, relational.table_scope(t), self.ansi, positive=False), F.lit(False))

    def _update(self, images: Images, t: TableDef, patch: dict[str, Any], where: Filter | None, check: bool) -> int:
        old, hit = images.read(t.name), self._where(t, where)
        marked = old.withColumn("__hit", hit)
        values = {n: F.lit(t[n].kind.literal(v)).cast(t[n].kind.spark) for n, v in patch.items()}
        clean = self._sanitized(t, {c.name: values.get(c.name, F.col(f"`{c.name}`")) for c in t.columns})
        new = [F.when(F.col("__hit"), x).otherwise(F.col(f"`{n}`")).alias(n) for n, x in clean.items()]
        image = marked.select(*new, RID, "__hit")
        changed = image.where("__hit").drop("__hit")
        n = old.where(hit).count()
        if check and n:
            self._validate(t, changed)
        images.replace(t.name, image.drop("__hit"))
        key = t.key
        if key and key.name in patch:
            n += self._follow(images, t, old.where(hit).select(F.col(f"`{key.name}`").alias("__old")), values[key.name])
        if check and n:
            self._check_keys(t, images.read(t.name), changed)
            self._check_rest(t, images, changed)
        return n

    def _follow(self, images: Images, t: TableDef, old: DataFrame, new: Column) -> int:
        """Children of rows whose key changed get the new key."""
        n = 0
        for child, c in self.catalog.referencing(t.name):
            rows = images.read(child.name)
            keys = old.distinct().withColumn("__yes", F.lit(True))
            joined = rows.join(keys, F.col(f"`{c.name}`") == F.col("__old"), "left")
            n += joined.where("__yes").count()
            moved = joined.withColumn(c.name, F.when(F.col("__yes"), new.cast(c.kind.spark)).otherwise(F.col(f"`{c.name}`")))
            images.replace(child.name, moved.select(*child.names, RID))
        return n

    def _delete(self, images: Images, t: TableDef, behavior: str, where: Filter | None, check: bool) -> int:
        hit = self._where(t, where)
        rows = images.read(t.name)
        n = rows.where(hit).count()
        if not n:
            return 0
        if t.key is None or not self.catalog.referencing(t.name):
            images.replace(t.name, rows.where(~hit))
            return n
        if behavior == RESTRICT:
            gone = rows.where(hit).select(F.col(f"`{t.key.name}`").alias("__k"))
            for child, c in self.catalog.referencing(t.name) if check else ():
                if not images.read(child.name).join(gone, F.col(f"`{c.name}`") == F.col("__k"), "left_semi").isEmpty():
                    raise ForeignKeyConstraintViolation(f"{child.name}.{c.name}")
            images.replace(t.name, rows.where(~hit))
            return n
        # each level is saved, so that the next one does not find it anew
        save = self._saved if check else lambda df: df
        first = save(rows.where(hit))
        doomed = {t.name: first.select(RID)}
        frontier = [(t, first)]
        while frontier:
            parent, gone = frontier.pop()
            keys = gone.select(F.col(f"`{parent.key.name}`").alias("__k")) if parent.key else None
            for child, c in self.catalog.referencing(parent.name) if keys is not None else ():
                more = images.read(child.name).join(keys, F.col(f"`{c.name}`") == F.col("__k"), "left_semi")
                if child.name in doomed:
                    more = more.join(doomed[child.name], RID, "left_anti")
                more = save(more)
                if not more.isEmpty():
                    doomed[child.name] = doomed[child.name].union(more.select(RID)).distinct() if child.name in doomed else more.select(RID)
                    frontier.append((child, more))
        total = 0
        for name, ids in doomed.items():
            total += ids.count() if check or name == t.name else 0
        left = {name: images.read(name).join(ids, RID, "left_anti").select(*self.catalog[name].names, RID) for name, ids in doomed.items()}
        for name, image in left.items():
            images.replace(name, image)
        return total

    def _saved(self, df: DataFrame) -> DataFrame:
        """The frame written among the warehouse's scratch parts, which vacuum() clears."""
        part = self.warehouse.write("_scratch", df)
        return self.spark.read.schema(df.schema).parquet(f"{self.warehouse.root}/{part}")

    # transactions

    def begin(self) -> int:
        if self.transaction:
            raise TransactionError("a transaction is open")
        manifest = self.warehouse.manifest()
        manifest["transactions"] = manifest.get("transactions", 0) + 1
        self.warehouse.commit(manifest)
        self.transaction = Transaction(manifest["transactions"], self.identity)
        return self.transaction.id

    def _taken(self) -> Transaction:
        if not self.transaction:
            raise TransactionError("no transaction is open")
        if self.transaction.owner != self.identity:
            raise TransactionError("the transaction is another identity's")
        return self.transaction

    def commit(self) -> None:
        """Check and apply all statements in order; the first failure leaves nothing. The transaction ends either way."""
        ops = self._taken().ops
        self.transaction = None
        if ops:
            self._replay(ops)

    def rollback(self) -> None:
        self._taken()
        self.transaction = None

    # schema

    def has_drift(self) -> bool:
        return self.warehouse.manifest()["hash"] != digest(self.catalog.snapshot())

    def pending_migrations(self) -> list[migrations.Op]:
        return migrations.plan(self.warehouse.manifest()["snapshots"], self.catalog)

    def migrate(self, allow_destructive: bool = False) -> list[migrations.Op]:
        manifest = self.warehouse.manifest()
        if (acl := A.Acl.of(manifest["acl"])) is not None:
            acl.require_flag(self.identity, "migrate")
        return migrations.apply(self.warehouse, self.catalog, allow_destructive)

    # permissions

    def acl(self) -> A.Acl | None:
        return A.Acl.of(self.warehouse.manifest()["acl"])

    def change_acl(self, change: Callable[[A.Acl], None]) -> None:
        """Apply a change to the grants; the first one sets them up, later ones need manage_acl."""
        manifest = self.warehouse.manifest()
        acl = A.Acl.of(manifest["acl"])
        if acl is None:
            acl = A.Acl()
        else:
            acl.require_flag(self.identity, "manage_acl")
        change(acl)
        self.warehouse.commit(manifest | {"acl": acl.saved()})
