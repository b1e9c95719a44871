"""The engine's queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import query as q
from .. import types as K
from ..database import CASCADE, Database
from ..functions import sanitize as S
from ..functions import validate as V
from ..query import Json, builder
from ..schema import Catalog, ColumnDef, ForeignKey, TableDef
from .testdata import open_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Database], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, path: run(open_folder(spark, path))
    if sql:
        ORACLE_SQL[name] = sql


def _select(name: str, table: str, b: q.QueryBuilder, sql: str) -> None:
    _add(name, lambda db: db.select_raw(table, b.build()), sql)


def _join(name: str, table: str, b: q.QueryBuilder, sql: str) -> None:
    _add(name, lambda db: (d := db.select_join(table, b.build())).toDF(*[c.replace(".", "_").replace("#", "_") for c in d.columns]), sql)


def _aggregate(name: str, table: str, b: q.QueryBuilder, functions: list[q.Aggregate], sql: str, doubles: tuple[str, ...] = ()) -> None:
    def run(db: Database) -> DataFrame:
        d = db.aggregate(table, b.build(), *functions)
        return d.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else d

    _add(name, run, sql)


# flagship, scans and projections
_select("q_flagship", "orders", builder().fields("o_orderkey", "o_custkey", "o_totalprice").filter(q.gt("o_totalprice", 100000) & q.in_("o_orderstatus", ["F", "O"])).order_by_desc("o_totalprice").order_by_asc("o_orderkey").limit(100),
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_select("q_scan_all", "nation", builder().all(), "SELECT * FROM nation")
_select("q_project", "nation", builder().fields("n_name", "n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")

# filters
for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _select(f"q_filter_{_op}", "part", builder().fields("p_partkey", "p_size").filter(getattr(q, _op)("p_size", 25)), f"SELECT p_partkey, p_size FROM part WHERE p_size {_sign} 25")
_select("q_filter_date", "orders", builder().fields("o_orderkey").filter(q.ge("o_orderdate", dt.datetime(1995, 1, 1)) & q.lt("o_orderdate", dt.datetime(1996, 1, 1))),
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_select("q_filter_in", "part", builder().fields("p_partkey").filter(q.in_("p_size", [1, 7, 49])), "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)")
_select("q_filter_in_empty", "part", builder().fields("p_partkey").filter(q.in_("p_size", [])), "SELECT p_partkey FROM part WHERE false")
_select("q_filter_between", "lineitem", builder().filter(q.ge("l_quantity", 5) & q.ge("l_quantity", 10) & q.le("l_quantity", 12)), "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_select("q_filter_contradiction", "lineitem", builder().filter(q.ge("l_quantity", 10) & q.le("l_quantity", 5)), "SELECT * FROM lineitem WHERE false")
_select("q_filter_and_or_not", "lineitem", builder().filter((q.eq("l_returnflag", "R") | ~q.lt("l_quantity", 45)) & ~(q.eq("l_linestatus", "O") & q.gt("l_tax", 0.03))),
        "SELECT * FROM lineitem WHERE (l_returnflag = 'R' OR NOT l_quantity < 45) AND NOT (l_linestatus = 'O' AND l_tax > 0.03)")
for _n, _f, _w in (("is_null", q.is_null, "IS NULL"), ("not_null", q.not_null, "IS NOT NULL")):
    _join(f"q_filter_{_n}", "documents", builder().left_join("labels", "doc_id", "doc_id").fields("documents.doc_id", "labels.quality").filter(_f("labels.quality")),
          f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality {_w}")
# NULL is above the values of a signed type: it passes > and >=, and fails < and <=
_join("q_filter_null_order", "documents", builder().left_join("labels", "doc_id", "doc_id").fields("documents.doc_id", "labels.quality").filter(q.gt("quality", 0)),
      "SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality > 0 OR l.quality IS NULL")
for _n, _p, _c, _t, _k in (
    ("prefix", "small%", "p_name", "part", "p_partkey"), ("infix", "%ring%", "p_name", "part", "p_partkey"), ("single", "Brand#_2", "p_brand", "part", "p_partkey"),
    ("escape", "%\\%%", "text", "documents", "doc_id"),
):
    _select(f"q_like_{_n}", _t, builder().fields(_k).filter(q.like(_c, _p)), f"SELECT {_k} FROM {_t} WHERE {_c} LIKE '{_p}' ESCAPE '\\'")

# JSON
_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
for _n, _f, _w in (
    ("extract_gt", Json.extract("k", "gt", 50), f"{_K} > 50"), ("extract_eq", Json.extract("k", "eq", 7), f"{_K} = 7"), ("in", Json.extract("k", "in", [1, 2, 3]), f"{_K} IN (1, 2, 3)"),
    ("has_key", Json.has_key("k"), "json_exists(props, '$.k')"), ("no_key", Json.has_key("k.z"), "json_exists(props, '$.k.z')"),
    ("contains", Json.contains({"k": 5}), "json_contains(props, '{\"k\": 5}')"), ("is_null", Json.extract("z", "is_null"), "json_extract(props, '$.z') IS NULL"),
    ("not_null", Json.extract("k", "not_null"), "json_extract(props, '$.k') IS NOT NULL"),
):
    _select(f"q_json_{_n}", "events", builder().fields("event_id").filter(q.json_filter("props", _f)), f"SELECT event_id FROM events WHERE {_w}")

# objects of one key are ordered by its value
_select("q_json_compare", "events", builder().fields("event_id").filter(q.gt("props", {"k": 50})), f"SELECT event_id FROM events WHERE {_K} > 50")
_select("q_json_order", "events", builder().fields("event_id", "props").order_by_desc("props").limit(50), f"SELECT event_id, props FROM events ORDER BY {_K} DESC, event_id LIMIT 50")
_aggregate("q_json_minmax", "events", builder().group_by("event_type"), [q.min_("props"), q.max_("props")], f"SELECT event_type, arg_min(props, {_K}) AS agg0, arg_max(props, {_K}) AS agg1 FROM events GROUP BY 1")

# joins
_join("q_join_inner", "orders", builder().inner_join("customer", "o_custkey", "c_custkey").fields("o_orderkey", "c_name"), "SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
for _h in ("left", "right", "full"):
    _join(f"q_join_{_h}", "labels", getattr(builder(), f"{_h}_join")("pages", "doc_id", "page_id").fields("labels.doc_id", "labels.quality", "pages.page_id"),
          f"SELECT l.doc_id AS labels_doc_id, l.quality AS labels_quality, p.page_id AS pages_page_id FROM labels l {_h.upper()} JOIN pages p ON l.doc_id = p.page_id")
_join("q_join_chain3", "lineitem", builder().inner_join("orders", "l_orderkey", "o_orderkey").inner_join("customer", "orders.o_custkey", "c_custkey").fields("l_orderkey", "l_quantity", "c_name"),
      "SELECT l_orderkey AS lineitem_l_orderkey, l_quantity AS lineitem_l_quantity, c_name AS customer_c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
_join("q_join_chain4", "lineitem", builder().inner_join("orders", "l_orderkey", "o_orderkey").inner_join("customer", "o_custkey", "c_custkey").inner_join("nation", "c_nationkey", "n_nationkey").fields("l_orderkey", "l_extendedprice", "n_name").filter(q.gt("l_quantity", 30)),
      "SELECT l_orderkey AS lineitem_l_orderkey, l_extendedprice AS lineitem_l_extendedprice, n_name AS nation_n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 30")
_join("q_join_filter_order_page", "orders", builder().inner_join("customer", "o_custkey", "c_custkey").fields("o_orderkey", "customer.c_name").filter(q.eq("customer.c_mktsegment", "BUILDING")).order_by_desc("orders.o_totalprice").order_by_asc("o_orderkey").limit(20).offset(5),
      "SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_join("q_join_self", "nation", builder().inner_join("nation", "n_regionkey", "n_regionkey"),
      "SELECT a.n_nationkey AS nation_n_nationkey, a.n_name AS nation_n_name, a.n_regionkey AS nation_n_regionkey, b.n_nationkey AS nation_2_n_nationkey, b.n_name AS nation_2_n_name, b.n_regionkey AS nation_2_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")

# eager relations, flattened for comparison
_add("q_eager_one", lambda db: db.select("customer", builder().fields("c_custkey", "c_name").with_("nation").build()).select("c_custkey", "c_name", "nation.n_name"), "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
_add("q_eager_two", lambda db: db.select("lineitem", builder().fields("l_orderkey", "l_linenumber").with_("part").with_("supplier").build()).select("l_orderkey", "l_linenumber", "part.p_name", "supplier.s_name"),
     "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
_add("q_fk_orphans", lambda db: db.orphans("orders", "o_custkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey")
_add("q_fk_referenced", lambda db: db.referenced("customer", "orders", "o_custkey").select("c_custkey"), "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")

# order, paging, distinct
_select("q_order_multi", "customer", builder().fields("c_custkey", "c_mktsegment").order_by_asc("c_mktsegment").order_by_desc("c_custkey"), "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey DESC")
_select("q_topk", "orders", builder().fields("o_orderkey", "o_totalprice").order_by_desc("o_totalprice").limit(10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_select("q_offset", "part", builder().fields("p_partkey").order_by_asc("p_partkey").offset(100).limit(7), "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 100")
_select("q_offset_past_end", "region", builder().offset(99), "SELECT * FROM region WHERE false")
_select("q_distinct_one", "events", builder().fields("event_id", "event_type").distinct("event_type"), "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1")
_select("q_distinct_multi", "events", builder().fields("event_id", "event_type", "user_id").distinct("event_type", "user_id"), "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1")
_select("q_distinct_unknown", "events", builder().fields("event_id").distinct("nothing"), "SELECT min(event_id) AS event_id FROM events")
_select("q_distinct_paged", "events", builder().fields("event_id", "user_id").distinct("user_id").order_by_desc("event_id").limit(5).offset(3),
        "SELECT event_id, user_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) ORDER BY event_id DESC LIMIT 5 OFFSET 3")

# aggregates
_aggregate("q_agg_global", "lineitem", builder(), [q.count(), q.min_("l_quantity"), q.max_("l_shipdate")], "SELECT count(*) AS agg0, min(l_quantity) AS agg1, max(l_shipdate) AS agg2 FROM lineitem")
_aggregate("q_agg_count_col", "lineitem", builder().filter(q.gt("l_quantity", 10)), [q.count("l_tax")], "SELECT count(l_tax) AS agg0 FROM lineitem WHERE l_quantity > 10")
_aggregate("q_agg_sum", "part", builder(), [q.sum_("p_size")], "SELECT CAST(sum(p_size) AS DOUBLE) AS agg0 FROM part", ("agg0",))
_aggregate("q_agg_avg", "part", builder().group_by("p_brand"), [q.avg("p_size")], "SELECT p_brand, CAST(CAST(CAST(sum(p_size) AS DECIMAL(28, 10)) / count(p_size) AS DECIMAL(20, 8)) AS DOUBLE) AS agg0 FROM part GROUP BY p_brand", ())
_aggregate("q_agg_minmax", "customer", builder().group_by("c_mktsegment"), [q.min_("c_name"), q.max_("c_acctbal")], "SELECT c_mktsegment, min(c_name) AS agg0, max(c_acctbal) AS agg1 FROM customer GROUP BY c_mktsegment")
_aggregate("q_agg_group1", "lineitem", builder().group_by("l_returnflag"), [q.count()], "SELECT l_returnflag, count(*) AS agg0 FROM lineitem GROUP BY 1")
_aggregate("q_agg_group2", "lineitem", builder().group_by("l_returnflag", "l_linestatus"), [q.count(), q.sum_("l_linenumber"), q.count()], "SELECT l_returnflag, l_linestatus, count(*) AS agg0, CAST(sum(l_linenumber) AS DOUBLE) AS agg1, count(*) AS agg2 FROM lineitem GROUP BY 1, 2", ("agg1",))
_aggregate("q_agg_having", "orders", builder().group_by("o_custkey").having(q.gt("agg0", 12) & q.lt("agg1", 400000)), [q.count(), q.max_("o_totalprice")], "SELECT o_custkey, count(*) AS agg0, max(o_totalprice) AS agg1 FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) < 400000")
_aggregate("q_agg_order", "orders", builder().group_by("o_orderpriority").order_by_desc("agg0").order_by_asc("o_orderpriority").limit(3), [q.count()], "SELECT o_orderpriority, count(*) AS agg0 FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_aggregate("q_agg_page", "orders", builder().group_by("o_custkey").order_by_asc("o_custkey").offset(10).limit(10), [q.max_("o_totalprice")], "SELECT o_custkey, max(o_totalprice) AS agg0 FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10")
_aggregate("q_agg_distinct_then_count", "events", builder().distinct("user_id").group_by("event_type"), [q.count()],
           "SELECT event_type, count(*) AS agg0 FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) GROUP BY 1")
_aggregate("q_agg_empty_global", "part", builder().filter(q.gt("p_size", 1000)), [q.count(), q.max_("p_size")], "SELECT count(*) AS agg0, max(p_size) AS agg1 FROM part WHERE p_size > 1000")
_aggregate("q_agg_empty_grouped", "part", builder().filter(q.gt("p_size", 1000)).group_by("p_brand"), [q.count()], "SELECT p_brand, count(*) AS agg0 FROM part WHERE p_size > 1000 GROUP BY 1")
_avg = QUERIES["q_agg_avg"]
QUERIES["q_agg_avg"] = lambda spark, path: _avg(spark, path).withColumn("agg0", F.col("agg0").cast("decimal(20,8)").cast("double"))

# sanitizers
_T, _PADDED = "customer", "concat('  ', c_name, chr(9), ' x  ')"


def _text(name: str, f: Callable[[Column], Column], source: str, sql: str) -> None:
    _add(f"q_{name}", lambda db: db.frames[_T].select("c_custkey", f(F.expr(source)).alias("out")), f"SELECT c_custkey, {sql.replace("{}", source, 1)} AS out FROM {_T}")


_text("san_trim", S.trim, _PADDED, "regexp_replace({}, '^\\s+|\\s+$', '', 'g')")
_text("san_collapse", S.collapse_whitespace, _PADDED, "trim(regexp_replace({}, '\\s+', ' ', 'g'))")
_text("san_lower", S.lowercase, "c_name", "lower({})")
_text("san_upper", S.uppercase, "c_name", "upper({})")
_text("san_slug", S.slug, "concat(c_name, ' & Co. ', c_mktsegment)", "regexp_replace(regexp_replace(lower({}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')")
_text("san_url", S.url_encode, "concat(c_name, ' a+b*c_d.e-f')", "replace(replace(replace(replace(url_encode({}), '-', '%2D'), '_', '%5F'), '.', '%2E'), '~', '%7E')")
_text("san_null_if_empty", S.null_if_empty, "left(c_name, c_custkey % 2)", "nullif({}, '')")
_text("san_clamp", S.clamp(3, 15), "c_nationkey", "greatest(least({}, 15), 3)")
_text("san_clamp_unsigned", S.clamp_unsigned(100, 900), "c_custkey", "greatest(least({}, 900), 100)")
_text("san_round", lambda c: S.round_to_scale(0)(c).cast("double"), "CAST(c_custkey * 0.5 AS DECIMAL(18,1))", "round_even(CAST({} AS DOUBLE), 0)")
for _n, _f, _m in (("timezone", S.timezone(120, 60), 60), ("utc", S.utc(90), -90)):
    _add(f"q_san_{_n}", lambda db, f=_f: db.frames["orders"].select("o_orderkey", f(F.col("o_orderdate")).alias("out")), f"SELECT o_orderkey, o_orderdate + INTERVAL ({_m}) MINUTE AS out FROM orders")

# validators
for _n, _v, _src, _sql in (
    ("max_strlen", V.max_strlen(17), "concat(c_name, 'é')", "strlen({}) <= 17"), ("min_strlen", V.min_strlen(3), "left(c_name, c_custkey % 5)", "strlen({}) >= 3"),
    ("range_strlen", V.range_strlen(2, 3), "left(c_name, c_custkey % 5)", "strlen({}) BETWEEN 2 AND 3"),
    ("email", V.email, "concat(c_mktsegment, if(c_custkey % 2 = 0, '@', ' '), 'example.com')", "regexp_matches({}, '" + V.EMAIL + "')"),
    ("phone", V.phone, "concat('+', c_custkey * 1000, if(c_custkey % 3 = 0, 'x', '-1'))", "regexp_matches({}, '" + V.PHONE + "')"),
    ("mime", V.mime_type, "concat('text', if(c_custkey % 2 = 0, '/', ''), 'html')", "regexp_matches({}, '" + V.MIME + "')"),
    ("rgb", V.rgb_color, "concat('#', lpad(CAST(c_custkey AS STRING), CAST(5 + c_custkey % 3 AS INT), '0'))", "regexp_matches({}, '" + V.RGB + "')"),
    ("camel", V.camel_case, "if(c_custkey % 2 = 0, c_mktsegment, lower(c_mktsegment))", "regexp_matches({}, '^[A-Z][A-Za-z0-9]*$')"),
    ("snake", V.snake_case, "if(c_custkey % 2 = 0, 'a_b1', c_name)", "regexp_matches({}, '^[a-z_][a-z0-9_]*$')"),
    ("kebab", V.kebab_case, "if(c_custkey % 2 = 0, 'a-b1', c_name)", "regexp_matches({}, '^[a-z][a-z0-9-]*$')"),
    ("country", V.country_iso3166, "if(c_custkey % 2 = 0, 'IT', 'it')", "{} = 'IT'"), ("language", V.country_iso639, "if(c_custkey % 2 = 0, 'it', 'IT')", "{} = 'it'"),
):
    _text(f"val_{_n}", _v, _src, _sql)
_add("q_val_url", lambda db: db.frames["pages"].select("page_id", V.url(F.col("url")).alias("out")), "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS out FROM pages")

# writes, transactions and migrations, on managed copies of the small tables
_NATIONS = TableDef("nations", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("name", K.TEXT, unique=True, sanitizers=(S.trim,)), ColumnDef("region", K.INT32, foreign_key=ForeignKey("regions", "id"))))
_REGIONS = TableDef("regions", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("name", K.TEXT, validators=(V.max_strlen(40),))))


def _managed(db: Database) -> Database:
    """A warehouse of its own below the shared folder, or where none is set, Spark's warehouse."""
    root = db.spark.conf.get("spark.checkpoint.dir", None) or db.spark.conf.get("spark.sql.warehouse.dir")
    out = Database(db.spark, Catalog(_REGIONS, _NATIONS), f"{root}/quern-managed-{dt.datetime.now().timestamp()}")
    out.insert("regions", db.frames["region"].select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    out.insert("nations", db.frames["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return out


def _dml(name: str, change: Callable[[Database], object], table: str, sql: str) -> None:
    def run(db: Database) -> DataFrame:
        managed = _managed(db)
        changed = change(managed)
        return (changed if isinstance(changed, Database) else managed).select(table)

    _add(name, run, sql)


_N = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"
_dml("q_dml_insert", lambda m: m.insert("nations", {"id": 100, "name": "  Atlantis ", "region": 1}), "nations", f"{_N} UNION ALL SELECT 100, 'Atlantis', 1")
_dml("q_dml_update", lambda m: m.update("nations", {"region": 0}, q.gt("id", 20)), "nations", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey > 20 THEN 0 ELSE n_regionkey END AS region FROM nation")
_dml("q_dml_update_pk_cascade", lambda m: m.update("regions", {"id": 50}, q.eq("id", 2)), "nations", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 50 ELSE n_regionkey END AS region FROM nation")
_dml("q_dml_delete_restrict", lambda m: m.delete("nations", "restrict", q.lt("id", 5)), "nations", f"{_N} WHERE n_nationkey >= 5")
_dml("q_dml_delete_cascade", lambda m: m.delete("regions", CASCADE, q.eq("id", 3)), "nations", f"{_N} WHERE n_regionkey <> 3")


def _overlay(m: Database, end: str | None) -> None:
    m.begin()
    m.insert("nations", {"id": 100, "name": "Atlantis", "region": 1})
    m.update("nations", {"region": 4}, q.eq("region", 1))
    m.delete("nations", "restrict", q.lt("id", 3))
    if end:
        getattr(m, end)()


_AFTER = "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS region FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT 100, 'Atlantis', 4"
_dml("q_tx_overlay", lambda m: _overlay(m, None), "nations", _AFTER)
_dml("q_tx_commit", lambda m: _overlay(m, "commit"), "nations", _AFTER)
_dml("q_tx_rollback", lambda m: _overlay(m, "rollback"), "nations", _N)


def _migrated(m: Database, *columns: ColumnDef, **hooks) -> Database:
    out = Database(m.spark, Catalog(_REGIONS, TableDef("nations", columns, **hooks)), m.warehouse.root)
    out.migrate(allow_destructive=True)
    return out


_ID, _NAME, _REGION = _NATIONS.columns
_dml("q_mig_add", lambda m: _migrated(m, _ID, _NAME, _REGION, ColumnDef("note", K.TEXT, default="none")), "nations", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, 'none' AS note FROM nation")
_dml("q_mig_drop", lambda m: _migrated(m, _ID, _NAME), "nations", "SELECT n_nationkey AS id, n_name AS name FROM nation")
_dml("q_mig_rename", lambda m: _migrated(m, _ID, ColumnDef("title", K.TEXT, renamed_from=("name",)), _REGION), "nations", "SELECT n_nationkey AS id, n_name AS title, n_regionkey AS region FROM nation")
_dml("q_mig_widen", lambda m: _migrated(m, ColumnDef("id", K.INT64, primary_key=True), _NAME, _REGION), "nations", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM nation")
_dml("q_mig_transform", lambda m: _migrated(m, _ID, ColumnDef("name", K.INT32), _REGION, transforms={"name": F.length}), "nations", "SELECT n_nationkey AS id, CAST(length(n_name) AS INTEGER) AS name, n_regionkey AS region FROM nation")
_dml("q_mig_alter", lambda m: _migrated(m, _ID, ColumnDef("name", K.TEXT, nullable=True), _REGION), "nations", _N)
