"""select, select_join and aggregate over bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as K
from ..errors import AggregateClauseInSelect, BrokenForeignKeyReference, InvalidQuery, JoinInsideTypedSelect, UnknownColumn
from ..query import Aggregate, Query
from ..schema import RID, Catalog, TableDef
from .filters import Scope, order, sort_key, to_column

#: Reads a table: its rows, with the row number where the table is managed.
Reader = Callable[[str], DataFrame]
#: Scale of exact sums and averages.
SCALE = 10


def table_scope(table: TableDef, prefix: str = "") -> Scope:
    def find(name: str) -> tuple[Column, K.Kind, bool]:
        c = table[name]
        return F.col(f"`{prefix}{name}`"), c.kind, c.nullable

    return find


def distinct_by(df: DataFrame, table: TableDef, names: tuple[str, ...], tie: list[Column]) -> DataFrame:
    """The first row of each key. Unknown names are NULL everywhere, so they do not part rows."""
    if not names:
        return df
    keys = [F.col(f"`{n}`") for n in names if n in table]
    if not keys:
        return df.orderBy(*tie).limit(1)
    w = W.partitionBy(*keys).orderBy(*tie)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def scan_order(df: DataFrame, table: TableDef) -> list[Column]:
    """Insertion order of managed tables; the key, or else all columns, of others."""
    if RID in df.columns:
        return [F.col(RID)]
    key = table.key
    return [F.col(f"`{key.name}`")] if key else [F.col(f"`{n}`") for n in table.names]


def _order(table: TableDef, name: str, ascending: bool, prefix: str = "") -> list[Column]:
    """Sort keys of a column: date-times that are equal go by their offset, where one is kept."""
    c = table[name]
    return [order(F.col(f"`{prefix}{x.name}`"), x.kind, ascending) for x in (c, *([table[c.offset]] if c.offset else []))]


def page(df: DataFrame, q: Query, keys: list[Column], tie: list[Column], early: bool = False) -> DataFrame:
    """Order, offset and limit. With `early`, a page without an order is any page: the scan stops when it is full."""
    paged = q.limit is not None or q.offset is not None
    if keys or (paged and not early):
        df = df.orderBy(*keys, *tie)
    if q.offset:
        df = df.offset(q.offset)
    return df.limit(q.limit) if q.limit is not None else df


def base_rows(catalog: Catalog, read: Reader, name: str, q: Query, ansi: bool) -> tuple[DataFrame, TableDef, list[Column]]:
    table, df = catalog[name], read(name)
    if q.where is not None:
        df = df.where(to_column(q.where, table_scope(table), ansi))
    tie = scan_order(df, table)
    return distinct_by(df, table, q.distinct, tie), table, tie


def select(catalog: Catalog, read: Reader, name: str, q: Query, ansi: bool = False, early: bool = False) -> DataFrame:
    """filter, distinct-by, eager parents, order, offset and limit, projection.

    A page without an order is cut in scan order; with `early`, and no distinct-by either, where the
    scan happens to be, which need not sort or read the whole table. Each eager relation adds a struct column for each foreign key that leads to its table.
    """
    if q.group_by or q.having is not None:
        raise AggregateClauseInSelect("group_by and having need aggregate()")
    if q.joins:
        raise JoinInsideTypedSelect("joins need select_join()")
    df, table, tie = base_rows(catalog, read, name, q, ansi)
    for n in q.columns or ():
        table[n]
    keys = [k for n, up in q.order_by for k in _order(table, n, up)]
    added: list[str] = []
    df = page(df, q, keys, tie, early and not q.distinct)
    for parent in q.eager:
        links = table.foreign_keys(parent)
        if not links:
            raise InvalidQuery(f"{name} has no foreign key to {parent}")
        for c in links:
            label = parent if len(links) == 1 else f"{parent}_{c.name}"
            there = read(parent).select(F.struct(*[F.col(f"`{n}`") for n in catalog[parent].names]).alias(label), F.col(f"`{c.foreign_key.column}`").alias("__key"))
            df = df.join(there, F.col(f"`{c.name}`") == F.col("__key"), "left")
            broken = F.col(f"`{c.name}`").isNotNull() & F.col("__key").isNull()
            message = F.concat(F.lit(f"{BrokenForeignKeyReference.__name__}: {name}.{c.name} = "), F.col(f"`{c.name}`").cast("string"))
            df = df.withColumn(label, F.when(broken, F.raise_error(message)).otherwise(F.col(label))).drop("__key")
            added.append(label)
    if added and keys:
        df = df.orderBy(*keys, *tie)
    wanted = [n for n in table.names if q.columns is None or n in q.columns]
    return df.select(*[F.col(f"`{n}`") for n in wanted], *added)


def select_join(catalog: Catalog, read: Reader, name: str, q: Query, ansi: bool = False) -> DataFrame:
    """Equi-joins from left to right, then filter, order, page, projection; columns are named table.column.

    NULL equals NULL in a join. A table that comes again is table#2, and so on; its plain name means
    the first. Both sides of an outer join are padded by their schema.
    """
    if not q.joins:
        raise InvalidQuery("select_join() needs a join")
    if q.group_by or q.having is not None:
        raise AggregateClauseInSelect("group_by and having need aggregate()")
    if q.distinct or q.eager:
        raise InvalidQuery("distinct and eager relations do not go with joins")
    columns: dict[str, tuple[str, str, K.Kind]] = {}
    nullable: dict[str, bool] = {}

    def load(table: str) -> tuple[DataFrame, str]:
        n = sum(label.partition("#")[0] == table for label in {x[0] for x in columns.values()}) + 1
        label = table if n == 1 else f"{table}#{n}"
        for c in catalog[table].columns:
            columns[f"{label}.{c.name}"] = (label, c.name, c.kind)
            nullable[f"{label}.{c.name}"] = c.nullable
        return read(table).select(*[F.col(f"`{c}`").alias(f"{label}.{c}") for c in catalog[table].names]), label

    def find(column: str, among: list[str] | None = None) -> str:
        if column in columns and (among is None or columns[column][0] in among):
            return column
        hits = [k for k, (label, n, _) in columns.items() if n == column and (among is None or label in among)]
        if len(hits) > 1 and len({columns[k][0].partition("#")[0] for k in hits}) > 1:
            raise InvalidQuery(f"Ambiguous column {column}")
        if not hits:
            raise UnknownColumn(column)
        return hits[0]

    df, first = load(name)
    labels = [first]
    for j in q.joins:
        right, label = load(j.table)
        right_name = j.right.rpartition(".")[2]
        a, b = find(j.left, labels), find(f"{label}.{right_name}")
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        both = nullable[a] and nullable[b]
        df = df.join(right, x.eqNullSafe(y) if both else x == y, {"full": "full_outer"}.get(j.how, j.how))
        for k, (own, _, _) in columns.items():
            if (own == label and j.how in ("left", "full")) or (own in labels and j.how in ("right", "full")):
                nullable[k] = True
        labels.append(label)

    def scope(column: str) -> tuple[Column, K.Kind, bool]:
        k = find(column)
        return F.col(f"`{k}`"), columns[k][2], nullable[k]

    if q.where is not None:
        df = df.where(to_column(q.where, scope, ansi))
    keys = []
    for n, up in q.order_by:
        label, plain, _ = columns[find(n)]
        keys += _order(catalog[label.partition("#")[0]], plain, up, f"{label}.")
    tie = [F.col(f"`{label}.{catalog[label.partition('#')[0]].key.name}`") for label in labels if catalog[label.partition("#")[0]].key]
    df = page(df, q, keys, tie)
    chosen = {k for n in q.columns or () for k, (_, plain, _) in columns.items() if n in (k, plain)}
    return df.select(*[F.col(f"`{k}`") for k in columns if q.columns is None or k in chosen])


def aggregate(catalog: Catalog, read: Reader, name: str, q: Query, functions: list[Aggregate], ansi: bool = False) -> DataFrame:
    """filter, distinct-by, grouping, having, order, page: the group columns and agg0, agg1 and so on."""
    if q.joins or q.eager:
        raise InvalidQuery("joins and eager relations do not go with aggregate()")
    table = catalog[name]
    kinds: dict[str, tuple[K.Kind, bool]] = {}
    for n in q.group_by:
        if n.startswith("agg") and n[3:].isdigit():
            raise InvalidQuery(f"group column {n} hides an aggregate")
        kinds[n] = (table[n].kind, table[n].nullable)
    exprs = []
    for i, f in enumerate(functions):
        c = table[f.column] if f.column else None
        x = F.col(f"`{f.column}`") if c else F.lit(1)
        if f.function in ("sum", "avg"):
            if c is None or not c.kind.numeric:
                raise InvalidQuery(f"{f.function} needs a numeric column")
            floating = c.kind.name.startswith("float")
            # decimals keep their own scale: a sum that needs more than 38 digits raises
            exact = c.kind.spark if c.kind.name == "decimal" else T.DecimalType(28, SCALE)
            total = F.sum(x if floating else x.cast(exact))
            x = total if f.function == "sum" else F.try_divide(total, F.count(x))
            kinds[f"agg{i}"] = (K.FLOAT64 if floating else K.decimal(max(SCALE, exact.scale)), True)
        elif f.function in ("min", "max"):
            least = F.min if f.function == "min" else F.max
            key = sort_key(x, c.kind)
            # equal keys are told apart by their text
            x = least(x) if key is x else least(F.when(key.isNotNull(), F.struct(key.alias("key"), x.alias("value"))))["value"]
            kinds[f"agg{i}"] = (c.kind, True)
        elif f.function == "count":
            x = F.count(x)
            kinds[f"agg{i}"] = (K.UINT64, False)
        else:
            raise InvalidQuery(f"unknown aggregate {f.function}")
        exprs.append(x.alias(f"agg{i}"))
    df, _, tie = base_rows(catalog, read, name, q, ansi)
    exprs = exprs or [F.count(F.lit(1)).alias("__rows")]
    df = df.groupBy(*[F.col(f"`{n}`") for n in q.group_by]).agg(*exprs) if q.group_by else df.agg(*exprs)

    def scope(n: str) -> tuple[Column, K.Kind, bool]:
        if n not in kinds:
            raise UnknownColumn(n)
        return F.col(f"`{n}`"), *kinds[n]

    def plain(f) -> None:
        if f.op in ("like", "json"):
            raise InvalidQuery(f"{f.op} does not go with having")
        for p in f.parts:
            plain(p)

    if q.having is not None:
        plain(q.having)
        df = df.where(to_column(q.having, scope, ansi))
    keys = [order(scope(n)[0], scope(n)[1], up) for n, up in q.order_by]
    df = page(df, q, keys, [F.col(f"`{n}`") for n in q.group_by])
    return df.select(*[F.col(f"`{n}`") for n in (*q.group_by, *[f"agg{i}" for i in range(len(functions))])])
