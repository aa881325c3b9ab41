"""Worked examples of range, composite, view and aggregate queries."""

import datetime as dt

import pytest

from lodestone.catalog import Index, Leaf, Node, OrderPath, Registry, Table, View, Window
from lodestone.errors import Refused
from lodestone.functions import coerce
from lodestone.operators import audits, groups, paths, views
from lodestone.operators.paths import Filter

V = Table("v", "v:", "id", (("id", "i64"), ("age", "i64"), ("city", "str"), ("price", "i64")), (Index("age", ("age",), values=(("city", "str"), ("price", "i64"))),))
U = Table(
    "u", "u:", "id", (("id", "str"), ("name", "str"), ("age", "i64"), ("dept", "str"), ("email", "str"), ("deleted", "i64")),
    (Index("age", ("age",), values=(("dept", "str"), ("name", "str"), ("deleted", "i64"))), Index("dept", ("dept",)), Index("email", ("email",), "unique")), (OrderPath("by_dept_age", ("dept", "age"), (False, True)),),
)


@pytest.fixture(scope="module")
def v(spark):
    rows = [(1, "10", "tokyo", "5"), (2, "20", "osaka", "3"), (3, "30", None, "8"), (4, "40", "tokyo", None), (5, "50", "kyoto", "3"), (6, "60", "osaka", "x")]
    return spark.createDataFrame(rows, "id long, age string, city string, price string")


@pytest.fixture(scope="module")
def u(spark):
    rows = [("1", "alice", 30, "eng", "a@x", 0), ("2", "bob", 45, "eng", "b@x", 0), ("3", "carol", 25, "ops", "c@x", 0), ("4", "dave", 38, "eng", "d@x", 0), ("5", "erin", 52, "ops", "e@x", 0), ("6", "frank", 61, None, "f@x", 0)]
    return spark.createDataFrame(rows, "id string, name string, age long, dept string, email string, deleted long")


def keys(df):
    return [r.key for r in df.collect()]


def numbers(df):
    return [int(k.split(":")[1]) for k in keys(df)]


def all_(v, *filters):
    return paths.scalar(v, V, "age", 0, 100, filters)


def test_filters(v):
    assert numbers(paths.page(all_(v, Filter("city", "tokyo")), V, "age")) == [1, 4]
    assert paths.count(all_(v, Filter("city", "tokyo"))).first().n == 2
    assert numbers(paths.page(all_(v, Filter("price", 0, 6)), V, "age")) == [1, 2, 5]  # missing and x fail
    first = paths.page(all_(v, Filter("city", "tokyo")), V, "age", 1)
    assert numbers(first) == [1]
    assert numbers(paths.page(all_(v, Filter("city", "tokyo")), V, "age", cursor=(10, "v:1"))) == [4]


def test_sort_distinct_facet_offset(v):
    assert numbers(paths.page(all_(v), V, "age", sort=("city", False))) == [5, 2, 6, 1, 4, 3]
    assert numbers(paths.page(all_(v), V, "age", sort=("city", True))) == [1, 4, 2, 6, 5, 3]
    assert numbers(paths.page(all_(v), V, "age", sort=("price", False))) == [2, 5, 1, 3, 4, 6]
    assert numbers(paths.page(all_(v), V, "age", distinct="city")) == [1, 2, 3, 5]
    assert [(r.value, r.n) for r in paths.facets(all_(v), V, ("city",)).collect()] == [("osaka", 2), ("tokyo", 2), ("kyoto", 1)]
    assert [(r.value, r.n) for r in paths.facets(all_(v, Filter("price", 0, 6)), V, ("city",)).collect()] == [("kyoto", 1), ("osaka", 1), ("tokyo", 1)]
    assert [numbers(paths.page(all_(v), V, "age", 2, o)) for o in (2, 4, 100)] == [[3, 4], [5, 6], []]


def test_refusals(v):
    for call in (
        lambda: paths.page(all_(v), V, "age", cursor=(1, "v:1"), sort=("city", False)),
        lambda: all_(v, Filter("color", 1)),
        lambda: all_(v, Filter("price", "abc")),
        lambda: paths.page(all_(v), V, "age", offset=10_001),
        lambda: paths.composite(v, V, "age", (("age", 1),)),
        lambda: paths.scalar(v, V, "nothing", 1, 2),
    ):
        with pytest.raises(Refused):
            call()


def test_user_table(u):
    page = lambda rows, index="age", **k: keys(paths.page(rows, U, index, **k))
    assert page(paths.scalar(u, U, "age", 25, 45)) == ["u:3", "u:1", "u:4", "u:2"]
    assert page(paths.scalar(u, U, "dept", "ops"), "dept") == ["u:3", "u:5"]
    assert page(paths.scalar(u, U, "email", "d@x"), "email") == ["u:4"]
    assert keys(paths.compose(u, U, "AND", ("age", 30, 50), ("dept", "eng", None))) == ["u:1", "u:2", "u:4"]
    assert keys(paths.compose(u, U, "OR", ("age", 60, 100), ("dept", "ops", None))) == ["u:3", "u:5", "u:6"]
    assert page(paths.scalar(u, U, "age", 0, 100, (Filter("dept", "eng"),))) == ["u:1", "u:4", "u:2"]
    assert page(paths.composite(u, U, "by_dept_age", (("dept", "eng"),)), "by_dept_age") == ["u:2", "u:4", "u:1"]
    assert page(paths.composite(u, U, "by_dept_age", (("dept", "eng"),), ("age", 31, 46)), "by_dept_age") == ["u:2", "u:4"]
    assert paths.count(paths.composite(u, U, "by_dept_age", ())).first().n == 5  # frank has no dept


def test_views(spark):
    jobs = spark.range(30).selectExpr("id", "id as pri", "if(id % 3 = 0, 'ready', 'done') as state")
    t = Table("job", "job:", "id", (("id", "i64"), ("pri", "i64"), ("state", "str")), (Index("pri", ("pri",)), Index("state", ("state",))))
    both = View("a", "job", Node("AND", Leaf("pri", 0, 20), Leaf("state", "ready")), "pri")
    assert numbers(views.query(jobs, t, both)) == [0, 3, 6, 9, 12, 15, 18]
    e = views.explain(jobs, t, both).first()
    assert (e.leaf_0, e.leaf_1, e.members) == (21, 10, 7)
    top = View("b", "job", Node("AND", Leaf("pri", 0, 100), Leaf("state", "ready")), "pri", desc=True, materialized=True, topk=5)
    assert numbers(views.query(jobs, t, top)) == [27, 24, 21, 18, 15]
    diff = View("c", "job", Node("DIFF", Leaf("pri", 0, 9), Leaf("state", "ready")), "pri")
    assert numbers(views.query(jobs, t, diff)) == [1, 2, 4, 5, 7, 8]
    with pytest.raises(Refused):
        View("d", "job", Node("AND", Node("OR", Node("OR", Leaf("pri", 1), Leaf("pri", 1)), Leaf("pri", 1)), Leaf("pri", 1)), "pri").check()


def test_aggregates(spark):
    rows = [(0, "paid", "100"), (1, "paid", "250"), (2, "open", "40"), (3, "paid", "100"), (4, "open", "999"), (5, "void", "7"), (6, None, "5"), (7, "paid", "x")]
    df = spark.createDataFrame(rows, "id long, status string, amount string")
    t = Table("ord", "ord:", "id", (("id", "i64"), ("status", "str"), ("amount", "i64")), (Index("a", ("amount",), kind="agg", group="status"),))
    g = groups.group(df, t, "a", "paid").first()
    assert (g.n, g.total, g.low, g.high, g["mean"]) == (3, 450, 100, 250, 150)
    assert tuple(groups.group(df, t, "a", "nope").first()) == (0, None, None, None, None)
    assert [(r.grp, r.total) for r in groups.groups(df, t, "a", "sum").collect()] == [("open", 1039), ("paid", 450), ("void", 7)]
    assert [r.grp for r in groups.groups(df, t, "a", "min").collect()] == ["void", "open", "paid"]
    assert groups.excluded(df, t, "a").first().excluded == 2


def test_coercion(spark):
    from pyspark.sql import functions as F

    texts = ["12", " 7 ", "+3", "1e3", "1.5", "x", "", None, "9223372036854775807", "9223372036854775808", "1d", "NaN", "inf", "-Infinity", ".5"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = df.select(coerce.coerced(F.col("s"), "i64").alias("i"), coerce.coerced(F.col("s"), "f64").alias("f")).collect()
    assert [r.i for r in got] == [12, 7, 3, None, None, None, None, None, 2**63 - 1, None, None, None, None, None, None]
    assert [r.f for r in got] == [12, 7, 3, 1000, 1.5, None, None, None, float(2**63), float(2**63), None, None, float("inf"), float("-inf"), 0.5]


def test_time_bounds():
    now = dt.datetime(2024, 3, 31, 12)
    at = lambda t: dt.datetime.fromtimestamp(coerce.time_bound(t, now), dt.UTC).replace(tzinfo=None)
    assert at("@now") == now
    assert at("@now-1mo") == dt.datetime(2024, 2, 29, 12)
    assert at("@now+2d") == dt.datetime(2024, 4, 2, 12)
    assert at("@2024-01-02T03:04:05") == dt.datetime(2024, 1, 2, 3, 4, 5)
    with pytest.raises(Refused):
        coerce.time_bound("@soon", now)


def test_registry(spark):
    r = Registry()
    r.declare(V)
    with pytest.raises(Refused):
        r.declare(V)
    with pytest.raises(Refused):
        r.declare(Table("w", "v:x", "id", (("id", "i64"),)))  # prefixes overlap
    more = Table("v", "v:", "id", (*V.columns, ("note", "str")), (*V.indexes, Index("city", ("city",))), window=Window("age", 10, 5))
    assert r.ensure(more) == ["column note", "index city"]
    assert r.ensure(more) == []
    with pytest.raises(Refused):
        r.ensure(Table("v", "v:", "id", (("id", "str"),)))
    r.create_view(View("w", "v", Leaf("age", 1, 2), "age"))
    with pytest.raises(Refused):
        r.drop("v")
    r.drop_view("w")
    r.replace(V)
    assert [i.name for i in r.table("v").indexes] == ["age"]
    assert r.list_indexes(spark).count() == 1
    assert [r.advise("v", "price") for _ in range(16)][-1] == "INDEX price range"
    r.drop("v")
    for bad in (Table("t", "t:", "id", (("id", "money"),)), Table("t", "t:", "no", (("id", "i64"),)), Table("t", "t:", "id", (("id", "i64"),), (Index("x", ("y",)),)), Table("t", "t:", "id", (("id", "i64"),), (Index("x", ("id",), "hash"),))):
        with pytest.raises(Refused):
            bad.check()


def test_audits(spark, v):
    row = audits.verify_table(v, Table("v", "v:", "id", V.columns, (Index("price", ("price",)),))).first()
    assert (row.rows, row.entries, row.absent, row.coerce_failures) == (6, 4, 1, 1)
    assert audits.doctor(audits.verify_table(v, Table("v", "v:", "id", V.columns, (Index("price", ("price",)),)))) == 1
    assert [(r.value, r.n) for r in audits.duplicates(v, Table("v", "v:", "id", V.columns, (Index("price", ("price",)),)), "price").collect()] == [(3, 2)]


def test_double_bounds_reach_the_scan(spark, sf):
    from lodestone.plans import suite

    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    for name, wanted in (("range_scan", "o_totalprice"), ("orderpath_where", "o_totalprice"), ("filter_multi", "o_totalprice")):
        plan = suite.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        line = next(x for x in plan.splitlines() if "PushedFilters" in x)
        assert f"GreaterThanOrEqual({wanted}" in line and f"LessThanOrEqual({wanted}" in line, line
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_nan_is_in_no_range(spark):
    t = Table("n", "n:", "id", (("id", "i64"), ("x", "f64")), (Index("x", ("x",)),)).check()
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0), (4, None)], "id long, x double")
    assert sorted(r.id for r in paths.scalar(df, t, "x", float("-inf"), float("inf")).collect()) == [2, 3]


def test_materialised_view(spark, sf, tmp_path):
    from lodestone.operators import views
    from lodestone.plans import suite

    df = suite.orders(spark, sf)
    view = View("top", "orders", Leaf("o_orderstatus", "F", None), "o_totalprice", desc=True, materialized=True, topk=50)
    views.materialise(df, suite.ORDERS, view, str(tmp_path / "v"))
    for cursor in (None, (300000.0, "orders:5")):
        want = [r.key for r in views.query(df, suite.ORDERS, view, 20, cursor).collect()]
        assert [r.key for r in views.query(df, suite.ORDERS, view, 20, cursor, stored=str(tmp_path / "v")).collect()] == want
    with pytest.raises(Refused):
        views.materialise(df, suite.ORDERS, View("v", "orders", view.tree, "o_totalprice"), str(tmp_path / "w"))
