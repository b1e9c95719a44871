"""Definitions of the test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import types as K
from ..database import Database
from ..schema import Catalog, ColumnDef, ForeignKey, TableDef
from ..sources.external import Folder

_KINDS = {"i": K.INT32, "l": K.INT64, "s": K.TEXT, "d": K.FLOAT64, "t": K.DATETIME, "j": K.JSON}


def table(name: str, text: str, key: str | None = None, **parents: str) -> TableDef:
    """`text`: column:kind words; parents: column = table.column."""
    columns = []
    for word in text.split():
        c, k = word.split(":")
        parent = parents.get(c)
        columns.append(ColumnDef(c, _KINDS[k], primary_key=c == key, foreign_key=ForeignKey(*parent.split(".")) if parent else None))
    return TableDef(name, tuple(columns))


CATALOG = Catalog(
    table("region", "r_regionkey:i r_name:s", "r_regionkey"),
    table("nation", "n_nationkey:i n_name:s n_regionkey:i", "n_nationkey", n_regionkey="region.r_regionkey"),
    table("customer", "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s", "c_custkey", c_nationkey="nation.n_nationkey"),
    table("supplier", "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d", "s_suppkey", s_nationkey="nation.n_nationkey"),
    table("part", "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d", "p_partkey"),
    table("orders", "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s", "o_orderkey", o_custkey="customer.c_custkey"),
    table(
        "lineitem", "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
        None, l_orderkey="orders.o_orderkey", l_partkey="part.p_partkey", l_suppkey="supplier.s_suppkey",
    ),
    table("events", "event_id:l ts:t user_id:l event_type:s value:d props:j", "event_id", user_id="customer.c_custkey"),
    table("documents", "doc_id:l text:s lang:s source:s n_chars:l", "doc_id"),
    table("pages", "page_id:l url:s html:s", "page_id"),
    table("benchmark", "item_id:l text:s", "item_id"),
    table("labels", "doc_id:l quality:i toxic:i", None, doc_id="documents.doc_id"),
    table("conversations", "conv_id:l turn:l role:s text:s"),
)


def open_folder(spark: SparkSession, path: str) -> Database:
    return Database(spark, CATALOG, frames=Folder(spark, path))
