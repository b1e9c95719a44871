"""Small fixtures: quirks, writes, transactions, migrations, permissions."""

import pytest

from quern import acl as A
from quern import errors as E
from quern import query as q
from quern import types as K
from quern.database import CASCADE, Database
from quern.functions import sanitize as S
from quern.functions import validate as V
from quern.functions.patterns import like_regex, parse_path
from quern.query import Json, Query, builder
from quern.schema import Catalog, ColumnDef, ForeignKey, TableDef

USERS = TableDef("users", (ColumnDef("id", K.UINT32, primary_key=True), ColumnDef("name", K.TEXT, sanitizers=(S.trim,), validators=(V.max_strlen(20),))))
POSTS = TableDef("posts", (ColumnDef("id", K.UINT32, primary_key=True, auto_increment=True), ColumnDef("title", K.TEXT, unique=True), ColumnDef("user_id", K.UINT32, nullable=True, foreign_key=ForeignKey("users", "id"))))
SALES = TableDef("sales", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("bonus", K.INT32, nullable=True), ColumnDef("rank", K.UINT32, nullable=True), ColumnDef("doc", K.JSON, nullable=True)))


@pytest.fixture
def db(spark, tmp_path):
    out = Database(spark, Catalog(USERS, POSTS, SALES), str(tmp_path / "w"))
    out.insert("users", [{"id": 1, "name": " alice "}, {"id": 2, "name": "bob"}, {"id": 3, "name": "carol"}])
    out.insert("posts", [{"title": t, "user_id": u} for t, u in (("a", 1), ("b", 1), ("c", 1), ("d", 2))])
    return out


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_nulls_are_values(db):
    db.insert("sales", [{"id": 1, "bonus": 10, "rank": 10}, {"id": 2, "bonus": None, "rank": None}, {"id": 3, "bonus": 3, "rank": 3, "doc": '{"a": [1, {"b": null}], "s": "x"}'}])
    find = lambda f, **k: ids(db.select("sales", builder().filter(f).build()))
    assert find(q.gt("bonus", 5)) == [1, 2] and find(q.lt("bonus", 5)) == [3]
    assert find(q.lt("rank", 5)) == [2, 3] and find(q.gt("rank", 5)) == [1]
    assert find(q.ne("bonus", 10)) == [2, 3] and find(q.eq("bonus", None)) == [2] and find(q.in_("bonus", [None, 3])) == [2, 3]
    assert find(~q.gt("bonus", 5)) == [3] and find(~q.eq("rank", 3)) == [1, 2]
    up = [r[0] for r in db.select("sales", builder().order_by_asc("bonus").build()).collect()]
    assert up == [3, 1, 2] and [r[0] for r in db.select("sales", builder().order_by_asc("rank").build()).collect()] == [2, 3, 1]
    assert find(q.json_filter("doc", Json.contains({"a": [{"b": None}]}))) == [3] and find(q.json_filter("doc", Json.has_key("a[1].b"))) == [3]
    assert find(q.json_filter("doc", Json.extract("a[1].b", "is_null"))) == [3] and find(q.json_filter("doc", Json.extract("s", "gt", 1))) == []
    assert find(q.json_filter("doc", Json.contains({"a": 1.0}))) == [] and find(q.json_filter("doc", Json.contains({"a": 1}))) == [3]
    got = db.aggregate("sales", Query(), q.sum_("bonus"), q.avg("bonus"), q.count("bonus"), q.count()).first()
    assert [float(x) for x in got] == [13, 6.5, 2, 3]
    ansi = Database(db.spark, db.catalog, db.warehouse.root, ansi=True)
    assert ids(ansi.select("sales", builder().filter(q.gt("bonus", 5)).build())) == [1]


def test_errors_of_queries(db):
    for e, f in (
        (E.UnknownColumn, lambda: db.select("users", builder().filter(q.eq("x", 1)).build())), (E.TableNotFound, lambda: db.select("x")),
        (E.InvalidQuery, lambda: db.select("users", builder().filter(q.like("id", "a")).build())), (E.InvalidQuery, lambda: db.select("users", builder().filter(q.eq("id", "a")).build())),
        (E.JoinInsideTypedSelect, lambda: db.select("users", builder().inner_join("posts", "id", "user_id").build())), (E.AggregateClauseInSelect, lambda: db.select("users", builder().group_by("id").build())),
        (E.InvalidQuery, lambda: db.select_join("users", builder().inner_join("posts", "users.id", "user_id").filter(q.eq("id", 1)).build())),
        (E.InvalidQuery, lambda: db.aggregate("users", Query(), q.sum_("name"))), (E.InvalidQuery, lambda: db.select("users", builder().with_("posts").build())),
        (E.UnknownColumn, lambda: db.aggregate("users", builder().having(q.gt("agg01", 1)).build(), q.count())),
    ):
        with pytest.raises(e):
            f()


def test_joins_and_eager(db):
    got = db.select_join("users", builder().left_join("posts", "users.id", "user_id").fields("name", "title").order_by_asc("users.id").order_by_asc("title").build())
    assert [tuple(r) for r in got.collect()] == [("alice", "a"), ("alice", "b"), ("alice", "c"), ("bob", "d"), ("carol", None)]
    eager = db.select("posts", builder().with_("users").order_by_asc("title").build()).collect()
    assert [r["users"]["name"] for r in eager] == ["alice", "alice", "alice", "bob"] and [r["id"] for r in eager] == [1, 2, 3, 4]


def test_integrity(db):
    for e, table, row in (
        (E.PrimaryKeyConflict, "users", {"id": 1, "name": "x"}), (E.UniqueViolation, "posts", {"title": "a", "user_id": 1}), (E.BrokenForeignKeyReference, "posts", {"title": "z", "user_id": 9}),
        (E.MissingNonNullableField, "users", {"id": 9}), (E.ValidationError, "users", {"id": 9, "name": "x" * 21}), (E.PrimaryKeyConflict, "users", [{"id": 8, "name": "x"}, {"id": 8, "name": "y"}]),
    ):
        with pytest.raises(e):
            db.insert(table, row)
    assert db.insert("posts", {"title": "free", "user_id": None}) == 1
    with pytest.raises(E.PrimaryKeyConflict):
        db.update("users", {"id": 7})
    assert db.update("users", {"id": 7}, q.eq("id", 1)) == 4
    assert {r[0] for r in db.select("posts", builder().fields("user_id").build()).collect()} == {7, 2, None}
    with pytest.raises(E.ForeignKeyConstraintViolation):
        db.delete("users", where=q.eq("id", 2))
    assert db.delete("users", CASCADE, q.eq("id", 7)) == 4 and db.select("posts").count() == 2
    assert db.warehouse.vacuum() == 0 and db.warehouse.vacuum(older_than=0) > 0 and db.select("users").count() == 2


def test_self_reference_cascade(spark, tmp_path):
    t = TableDef("e", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("boss", K.INT32, nullable=True, foreign_key=ForeignKey("e", "id"))))
    db = Database(spark, Catalog(t), str(tmp_path / "w"))
    db.insert("e", [{"id": 1, "boss": None}, {"id": 2, "boss": 1}, {"id": 3, "boss": 2}, {"id": 4, "boss": None}])
    assert db.delete("e", CASCADE, q.eq("id", 1)) == 3 and ids(db.select("e")) == [4]


def test_transactions(db):
    other = Database(db.spark, db.catalog, db.warehouse.root)
    db.begin()
    db.insert("users", {"id": 4, "name": "dan"})
    db.delete("posts", where=q.eq("title", "d"))
    assert ids(db.select("users")) == [1, 2, 3, 4] and ids(other.select("users")) == [1, 2, 3]
    db.commit()
    assert ids(other.select("users")) == [1, 2, 3, 4] and other.select("posts").count() == 3
    db.begin()
    db.insert("users", {"id": 5, "name": "eve"})
    db.update("posts", {"user_id": 99}, q.eq("title", "a"))
    with pytest.raises(E.BrokenForeignKeyReference):
        db.commit()
    assert ids(db.select("users")) == [1, 2, 3, 4]
    with pytest.raises(E.TransactionError):
        db.rollback()


def test_migrations(db):
    wide = TableDef("users", (ColumnDef("id", K.UINT64, primary_key=True), ColumnDef("title", K.TEXT, renamed_from=("name",)), ColumnDef("age", K.INT32, nullable=True)))
    new = Database(db.spark, Catalog(wide, POSTS), db.warehouse.root)
    assert new.has_drift() and [o.kind for o in new.pending_migrations()] == ["rename_column", "widen_column", "add_column", "drop_table"]
    with pytest.raises(E.SchemaDrift):
        new.select("users")
    with pytest.raises(E.DestructiveOperation):
        new.migrate()
    new.migrate(allow_destructive=True)
    assert not new.has_drift() and sorted(tuple(r) for r in new.select("users").collect())[0] == (1, "alice", None)
    tight = TableDef("users", (*wide.columns[:2], ColumnDef("age", K.INT32)))
    with pytest.raises(E.ConstraintViolation):
        Database(db.spark, Catalog(tight, POSTS), db.warehouse.root).migrate()
    bad = TableDef("users", (ColumnDef("id", K.UINT64, primary_key=True), ColumnDef("title", K.INT32), wide.columns[2]))
    with pytest.raises(E.IncompatibleType):
        Database(db.spark, Catalog(bad, POSTS), db.warehouse.root).migrate()


def test_permissions(db):
    db.change_acl(lambda a: a.grant("root", "admin", "manage_acl"))
    with pytest.raises(E.AccessDenied):
        db.select("users")
    root = Database(db.spark, db.catalog, db.warehouse.root, identity="root")
    root.change_acl(lambda a: a.grant("reader", table="users", bits=A.READ))
    reader = Database(db.spark, db.catalog, db.warehouse.root, identity="reader")
    assert reader.select("users").count() == 3
    for f in (lambda: reader.select_join("users", builder().inner_join("posts", "users.id", "user_id").build()), lambda: reader.delete("users"), lambda: root.change_acl(lambda a: a.remove("root"))):
        with pytest.raises(E.AccessDenied):
            f()


def test_patterns_and_json(spark):
    import re

    to_py = lambda p: like_regex(p).replace("\\z", "\\Z")
    quote = lambda r: re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), r, flags=re.S)
    for pattern, text, hit in (("a%", "abc", True), ("a_c", "a\nc", True), ("a\\%", "a%", True), ("a\\", "a", True), ("_", "é", True), ("", "", True), ("%b", "abc", False)):
        assert bool(re.search(quote(to_py(pattern)), text)) == hit
    assert parse_path("a.b[0].c") == ["a", "b", 0, "c"] and parse_path("[0].a") == [0, "a"]
    for bad in ("", ".a", "a.", "a..b", "a[", "a[]", "a[-1]", "a[x]", "a]"):
        with pytest.raises(E.InvalidQuery):
            parse_path(bad)
    x = builder().fields("a").left_join("t", "a", "b").filter(q.eq("a", 1) & ~q.in_("b", [1, None]) | q.json_filter("c", Json.has_key("k"))).order_by_desc("a").limit(3).build()
    assert Query.from_json(x.to_json()) == x
    import datetime as dt
    import uuid
    from decimal import Decimal

    values = (dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 6), Decimal("1.10"), b"\x00\xff", uuid.UUID(int=7), "x", 1, 1.5, True, None)
    for v in values:
        x = builder().filter(q.eq("a", v) | q.in_("b", values)).build()
        assert Query.from_json(x.to_json()) == x


def test_pages_without_order(db):
    page = builder().limit(2).build()
    early = db.select("posts", page, early=True)
    assert early.count() == 2 and "Sort" not in early._jdf.queryExecution().executedPlan().toString()
    assert ids(db.select("posts", page)) == [1, 2] and db.select("posts", builder().distinct("user_id").limit(9).build(), early=True).count() == 2
    assert db.select("posts", builder().distinct("nothing").build()).count() == 1


def test_sums_keep_their_scale(spark, tmp_path):
    t = TableDef("m", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("x", K.decimal(14, 30))))
    db = Database(spark, Catalog(t), str(tmp_path / "w"))
    db.insert("m", [{"id": 1, "x": "1234567890123456.00000000000001"}, {"id": 2, "x": "0.00000000000002"}])
    assert str(db.aggregate("m", Query(), q.sum_("x")).first()[0]) == "1234567890123456.00000000000003"


def test_parts_and_sessions(db):
    """Parts without a touched row stay; another session's rows stay; a session that lost its parts is told."""
    for i, title in enumerate("efg"):
        db.insert("posts", {"title": title, "user_id": 1 + i % 2})
    before = set(db.warehouse.manifest()["tables"]["posts"]["parts"])
    assert db.update("posts", {"user_id": 3}, q.eq("title", "f")) == 1
    after = set(db.warehouse.manifest()["tables"]["posts"]["parts"])
    assert len(before & after) == len(before) - 1 and sorted((r["title"], r["user_id"]) for r in db.select("posts").collect())[5] == ("f", 3)
    assert db.delete("posts", where=q.eq("title", "g")) == 1 and db.select("posts").count() == 6
    db.begin()
    db.update("posts", {"user_id": 1}, q.eq("title", "f"))
    db.update("posts", {"user_id": 2}, q.eq("title", "f"))
    db.delete("posts", where=q.eq("title", "b"))
    db.insert("posts", {"title": "b", "user_id": 3})
    db.commit()
    assert sorted((r["title"], r["user_id"]) for r in db.select("posts").collect()) == [("a", 1), ("b", 3), ("c", 1), ("d", 2), ("e", 1), ("f", 2)]
    other = Database(db.spark, db.catalog, db.warehouse.root)
    read = db.warehouse.manifest
    stale = read()
    other.insert("posts", {"title": "late", "user_id": 1})
    calls = iter([stale])
    db.warehouse.manifest = lambda: next(calls, None) or read()
    db._replay([lambda images, check: db._update(images, db.catalog["posts"], {"user_id": 2}, q.eq("title", "a"), check)])
    db.warehouse.manifest = read
    assert sorted(r["title"] for r in db.select("posts").collect()) == ["a", "b", "c", "d", "e", "f", "late"]
    stale = read()
    other.update("posts", {"user_id": 1})
    calls = iter([stale])
    db.warehouse.manifest = lambda: next(calls, None) or read()
    with pytest.raises(E.TransactionError):
        db._replay([lambda images, check: db._update(images, db.catalog["posts"], {"user_id": 2}, q.eq("title", "a"), check)])
    db.warehouse.manifest = read
    assert {r["user_id"] for r in db.select("posts").collect()} == {1}


def test_foreign_key_probes(db):
    assert db.orphans("posts", "user_id").count() == 0 and ids(db.referenced("users", "posts", "user_id")) == [1, 2]


DOCS = ["null", "false", "true", "-1e300", "-3", "-0.5", "0", "1", "1.5", "2", "10", "9007199254740992", "9007199254740993", "18446744073709551615", "1e300", '""', '"\\u0000"', '"A"', '"a"', '"a\\u0000"', '"aa"', '"b"',
        "[]", "[null]", "[1]", "[1,0]", "[1,[]]", "[2]", '["a"]', '["aa"]', "{}", '{"a":1}', '{"a":1,"b":null}', '{"a":2}', '{"aa":0}', '{"b":0}']


def test_json_values_are_ordered(db):
    """Keys follow the order of a plain comparison; ORDER BY, MIN, MAX and comparisons use them."""
    import functools
    import itertools
    import json

    from quern.functions.json_order import literal_key

    def plain(a, b):
        rank = lambda x: next(i for i, t in enumerate((type(None), bool, (int, float), str, list, dict)) if isinstance(x, t))
        if rank(a) != rank(b):
            return rank(a) - rank(b)
        if isinstance(a, list):
            found = (plain(x, y) for x, y in zip(a, b, strict=False))
        elif isinstance(a, dict):
            found = (f for x, y in zip(sorted(a), sorted(b), strict=False) for f in (plain(x, y), plain(a[x], b[y]) if x == y else 0))
        else:
            return 0 if a is None else (a > b) - (a < b)
        return next((f for f in found if f), len(a) - len(b))

    for x, y in itertools.product(DOCS, repeat=2):
        kx, ky = literal_key(x), literal_key(y)
        assert ((kx > ky) - (kx < ky)) == ((c := plain(json.loads(x), json.loads(y))) > 0) - (c < 0), (x, y)
    assert literal_key("1") == literal_key("1.0") and literal_key("{") is None and literal_key("NaN") is None
    want = sorted(range(len(DOCS)), key=functools.cmp_to_key(lambda i, j: plain(json.loads(DOCS[i]), json.loads(DOCS[j]))))
    db.insert("sales", [{"id": i, "doc": d} for i, d in reversed(list(enumerate(DOCS)))] + [{"id": 99, "doc": None}])
    order = lambda b: [r["id"] for r in db.select("sales", b.build()).collect()]
    assert order(builder().order_by_asc("doc")) == [*want, 99] and order(builder().order_by_desc("doc").limit(4)) == [99, *want[:-4:-1]]
    got = db.aggregate("sales", builder().filter(q.ne("doc", None) & q.gt("doc", 1)).build(), q.min_("doc"), q.max_("doc"), q.count()).first()
    assert list(got) == ["1.5", '{"b":0}', len(DOCS) - 8]
    assert ids(db.select("sales", builder().filter(q.lt("doc", "false")).build())) == [0]
    assert ids(db.select("sales", builder().filter(~q.le("doc", '{"aa":0}')).build())) == [len(DOCS) - 1, 99]
    assert db.aggregate("sales", builder().having(q.gt("agg0", '"z"')).build(), q.max_("doc")).count() == 1


def test_offsets_of_date_times(spark, tmp_path):
    """A sanitizer moves the local fields and sets the offset column; equal fields are ordered by their offset."""
    import datetime as dt

    def open_(name, *sanitizers):
        t = TableDef("visits", (ColumnDef("id", K.INT32, primary_key=True), ColumnDef("at", K.DATETIME, nullable=True, offset="zone", sanitizers=sanitizers), ColumnDef("zone", K.INT16, nullable=True)))
        return Database(spark, Catalog(t), str(tmp_path / name))

    noon = dt.datetime(2024, 5, 1, 12)
    rows = [{"id": 1, "at": noon, "zone": 120}, {"id": 2, "at": noon, "zone": -60}, {"id": 3, "at": None, "zone": 30}, {"id": 4, "at": noon, "zone": None}]
    kept = open_("kept")
    kept.insert("visits", rows[:3])
    up = [r["id"] for r in kept.select("visits", builder().order_by_asc("at").build()).collect()]
    assert up == [2, 1, 3] and [r["id"] for r in kept.select("visits", builder().order_by_desc("at").build()).collect()] == [3, 1, 2]
    moved = open_("moved", S.timezone(60), S.utc())
    moved.insert("visits", rows)
    hour = dt.timedelta(hours=1)
    want = [(1, noon - 2 * hour, 0), (2, noon + hour, 0), (3, None, 30), (4, noon, 0)]
    read = lambda: sorted(map(tuple, moved.select("visits").collect()))
    assert read() == want
    moved.update("visits", {"at": noon, "zone": 60}, q.eq("id", 1))
    moved.update("visits", {"id": 5}, q.eq("id", 2))
    assert read() == [(1, noon - hour, 0), want[2], want[3], (5, noon + hour, 0)]
    with pytest.raises(E.TableError):
        TableDef("x", (ColumnDef("at", K.DATETIME, offset="zone"),))


def test_urls(spark):
    good = ["http://example.com", " https://example.com:443/a?b#c\n", "http:example.com", "http:\\\\example.com\\a", "ftp://u:p@h.org:021/", "http://a@b@c.d/", "http://%41.com", "http://1.2.3.4", "http://0x7f.1", "http://127.1.", "http://[::1]:80/",
            "http://[1:2:3:4:5:6:7:8]", "http://[::ffff:1.2.3.4]", "http://é.com", "file:///a/b", "file:a", "file://host/a", "file:///C:/a", "mailto:a@b.c", "data:,x y", "urn:x", "a+b-c.1:", "git://h:9418/x", "git:///x", "http://h:65535", "http://h:", "x://a%b"]
    bad = ["", "example.com", "/a/b", "//example.com", "1http://a", "http://", "https:///", "http://a b", "http://u@/", "http://h:65536", "http://h:8a", "http://:80", "http://a<b", "http://a%20b", "http://%zz", "http://256.1.1.1", "http://1.2.3.4.5", "http://1.2.3.08",
           "http://4294967296", "http://[::1", "http://[1:2]", "http://[::1::]", "http://[1:2:3:4:5:6:7:8:9]", "http://[::g]", "git://h:x/", "git://u@/", "git://a b/", "file://a:80/", "http://[::1]x"]
    df = spark.createDataFrame([(u,) for u in good + bad] + [(None,)], "u string")
    got = {r[0]: r[1] for r in df.select("u", V.url(df["u"])).collect()}
    assert [u for u in good if got[u] is not True] == [] and [u for u in bad if got[u] is not False] == [] and got[None] is None


def test_codes_of_countries_and_languages(spark):
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = spark.createDataFrame([(x + y,) for x in a for y in a], "c string")
    found = df.select("c", V.country_iso3166(df["c"]).alias("land")).where("land")
    assert found.count() == 249 and {"AX", "BQ", "SS", "UM", "ZW"} <= {r[0] for r in found.collect()}
    low = df.selectExpr("lower(c) AS c")
    assert low.where(V.country_iso3166(low["c"])).isEmpty() and df.where(V.country_iso639(df["c"])).isEmpty()
    tongues = {r[0] for r in low.where(V.country_iso639(low["c"])).collect()}
    assert len(tongues) == 184 and {"aa", "he", "id", "yi", "zu"} <= tongues and not tongues & {"in", "iw", "ji", "mo"}
