"""Registered queries over the fixture tables and, for each that SQL can express, the same query as plain SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import Index, Leaf, Node, OrderPath, Registry, Table, View, Window
from lodestone.functions import scalar as S
from lodestone.operators import audits, bitmaps, geo, groups, hashes, keys, lists, paths, sets, text, text_index, vector_index, vectors, views, zsets
from lodestone.plans import ddl, fold
from lodestone.sources import tables as sources
from lodestone.streaming import entries, feed, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS = Table(
    "orders",
    "orders:",
    "o_orderkey",
    (("o_orderkey", "i64"), ("o_custkey", "i64"), ("o_orderstatus", "str"), ("o_totalprice", "f64"), ("o_orderpriority", "str"), ("o_ts", "i64")),
    (
        Index("o_totalprice", ("o_totalprice",), values=(("o_orderstatus", "str"), ("o_orderpriority", "str"), ("o_custkey", "i64"))),
        Index("o_orderstatus", ("o_orderstatus",)),
        Index("o_custkey", ("o_custkey",)),
        Index("o_ts", ("o_ts",)),
        Index("by_priority", ("o_totalprice",), kind="agg", group="o_orderpriority"),
    ),
    (OrderPath("by_status_price", ("o_orderstatus", "o_totalprice"), (False, True)), OrderPath("by_priority_cust", ("o_orderpriority", "o_custkey"))),
    Window("o_ts", 365 * 86400, 30 * 86400),
).check()

#: Customers with a segment that is missing for some and a text price that does not coerce for some.
CUSTOMERS = Table(
    "customer",
    "customer:",
    "c_custkey",
    (("c_custkey", "i64"), ("c_nationkey", "i64"), ("city", "str"), ("price", "i64"), ("c_acctbal", "f64")),
    (Index("c_nationkey", ("c_nationkey",), values=(("city", "str"), ("price", "i64"))), Index("price", ("price",)), Index("c_acctbal", ("c_acctbal",), "unique")),
).check()

NOW = dt.datetime(1998, 1, 1)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").withColumn("o_ts", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    price = F.when(F.col("c_custkey") % 7 != 0, F.when(F.col("c_custkey") % 11 == 0, "x").otherwise((F.col("c_custkey") % 23).cast("string")))
    return load(spark, sf_dir, "customer").withColumns({"city": city, "price": price})


_ORDERS = "orders_ AS (SELECT *, 'orders:' || o_orderkey AS key, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS o_ts FROM orders)"
_CUSTOMERS = """customers_ AS (SELECT c_custkey, c_nationkey, c_acctbal, 'customer:' || c_custkey AS key,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS city,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN CAST(c_custkey % 23 AS BIGINT) END AS price FROM customer)"""

# ---- ranges, filters, pages ----


@query(f"WITH {_ORDERS} SELECT key, o_orderkey, o_totalprice FROM orders_ WHERE o_totalprice BETWEEN 100000 AND 200000 ORDER BY o_totalprice, key LIMIT 100")
def range_scan(spark, d):
    o = orders(spark, d)
    return paths.page(paths.scalar(o, ORDERS, "o_totalprice", 100000, 200000), ORDERS, "o_totalprice", fields=("o_orderkey", "o_totalprice"))


@query(f"WITH {_ORDERS} SELECT key, o_orderkey, o_custkey FROM orders_ WHERE o_custkey = 42 ORDER BY o_custkey, key LIMIT 100")
def eq_lookup(spark, d):
    return paths.page(paths.scalar(orders(spark, d), ORDERS, "o_custkey", 42), ORDERS, "o_custkey", fields=("o_orderkey", "o_custkey"))


@query(f"WITH {_ORDERS} SELECT key, o_orderkey, o_orderstatus, o_totalprice FROM orders_ WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 300000 ORDER BY o_totalprice DESC, key LIMIT 20")
def orderpath_where(spark, d):
    rows = paths.composite(orders(spark, d), ORDERS, "by_status_price", (("o_orderstatus", "F"),), ("o_totalprice", 50000, 300000))
    return paths.page(rows, ORDERS, "by_status_price", 20, fields=("o_orderkey", "o_orderstatus", "o_totalprice"))


@query(f"WITH {_ORDERS} SELECT key, o_totalprice FROM orders_ WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, key LIMIT 25 OFFSET 50")
def orderpath_desc_page(spark, d):
    return paths.page(paths.composite(orders(spark, d), ORDERS, "by_status_price", (("o_orderstatus", "O"),)), ORDERS, "by_status_price", 25, 50, fields=("o_totalprice",))


@query(f"WITH {_ORDERS} SELECT key, o_orderpriority, o_custkey FROM orders_ WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_custkey BETWEEN 10 AND 60 ORDER BY o_custkey, key LIMIT 10000")
def orderpath_swapped_range(spark, d):
    o = orders(spark, d)
    first = o.agg(F.min("o_orderpriority")).first()[0]
    rows = paths.composite(o, ORDERS, "by_priority_cust", (("o_orderpriority", first),), ("o_custkey", 60, 10))  # ends in either order
    return paths.page(rows, ORDERS, "by_priority_cust", 10000, fields=("o_orderpriority", "o_custkey"))


@query(f"WITH {_ORDERS} SELECT key, o_totalprice, o_orderstatus, o_custkey FROM orders_ WHERE o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus = 'F' AND o_custkey BETWEEN 1 AND 500 ORDER BY o_totalprice, key LIMIT 100")
def filter_multi(spark, d):
    rows = paths.scalar(orders(spark, d), ORDERS, "o_totalprice", 50000, 250000, (paths.Filter("o_orderstatus", "F"), paths.Filter("o_custkey", 1, 500)))
    return paths.page(rows, ORDERS, "o_totalprice", fields=("o_totalprice", "o_orderstatus", "o_custkey"))


@query(f"WITH {_CUSTOMERS} SELECT key, city, price FROM customers_ WHERE c_nationkey BETWEEN 0 AND 10 AND price BETWEEN 3 AND 9 ORDER BY c_nationkey, key LIMIT 200")
def filter_uncoercible(spark, d):
    rows = paths.scalar(customers(spark, d), CUSTOMERS, "c_nationkey", 0, 10, (paths.Filter("price", 3, 9),))
    return paths.page(rows.withColumn("price", paths.value(rows, CUSTOMERS, "price")), CUSTOMERS, "c_nationkey", 200, fields=("city", "price"))


for _desc in (False, True):

    def _sorted(spark, d, desc=_desc):
        rows = paths.scalar(customers(spark, d), CUSTOMERS, "c_nationkey", 0, 24)
        return paths.page(rows, CUSTOMERS, "c_nationkey", 1000, 100, sort=("city", desc), fields=("city",))

    _name = f"sort_nulls_last_{'desc' if _desc else 'asc'}"
    QUERIES[_name], ORACLES[_name] = _sorted, f"WITH {_CUSTOMERS} SELECT key, city FROM customers_ WHERE c_nationkey BETWEEN 0 AND 24 ORDER BY city {'DESC' if _desc else 'ASC'} NULLS LAST, key LIMIT 1000 OFFSET 100"


@query(f"WITH {_CUSTOMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY city, CASE WHEN city IS NULL THEN key END ORDER BY c_nationkey, key) AS seat FROM customers_ WHERE c_nationkey BETWEEN 5 AND 20) SELECT key, city FROM r WHERE seat = 1 ORDER BY c_nationkey, key LIMIT 50")
def distinct_best(spark, d):
    return paths.page(paths.scalar(customers(spark, d), CUSTOMERS, "c_nationkey", 5, 20), CUSTOMERS, "c_nationkey", 50, distinct="city", fields=("city",))


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT * FROM customers_ WHERE c_nationkey BETWEEN 0 AND 12)
SELECT 'city' AS field, city AS value, count(*) AS n FROM m WHERE city IS NOT NULL GROUP BY city
UNION ALL SELECT 'price', CAST(price AS VARCHAR), count(*) FROM m WHERE price IS NOT NULL GROUP BY price""")
def facet_counts(spark, d):
    return paths.facets(paths.scalar(customers(spark, d), CUSTOMERS, "c_nationkey", 0, 12), CUSTOMERS, ("city", "price"))


@query(f"WITH {_ORDERS} SELECT key, o_totalprice FROM orders_ WHERE o_totalprice BETWEEN 1000 AND 500000 ORDER BY o_totalprice, key LIMIT 20 OFFSET 1000")
def offset_page(spark, d):
    return paths.page(paths.scalar(orders(spark, d), ORDERS, "o_totalprice", 1000, 500000), ORDERS, "o_totalprice", 20, 1000, fields=("o_totalprice",))


@query(f"WITH {_ORDERS} SELECT key, o_custkey FROM orders_ WHERE o_custkey BETWEEN 10 AND 100 AND (o_custkey > 20 OR (o_custkey = 20 AND key > 'orders:5')) ORDER BY o_custkey, key LIMIT 50")
def keyset_page(spark, d):
    return paths.page(paths.scalar(orders(spark, d), ORDERS, "o_custkey", 10, 100), ORDERS, "o_custkey", 50, cursor=(20, "orders:5"), fields=("o_custkey",))


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus = 'F'")
def count_claused(spark, d):
    return paths.count(paths.scalar(orders(spark, d), ORDERS, "o_totalprice", 50000, 250000, (paths.Filter("o_orderstatus", "F"),)))


@query(f"WITH {_ORDERS} SELECT key, o_ts FROM orders_ WHERE o_ts BETWEEN CAST(epoch(TIMESTAMP '1997-10-01') AS BIGINT) AND CAST(epoch(TIMESTAMP '1998-01-01') AS BIGINT) ORDER BY o_ts, key LIMIT 500")
def time_bound(spark, d):
    return paths.page(paths.scalar(orders(spark, d), ORDERS, "o_ts", "@now-3mo", "@now", now=NOW), ORDERS, "o_ts", 500, fields=("o_ts",))


@query(f"WITH {_ORDERS} SELECT key, o_custkey, o_orderstatus FROM orders_ WHERE o_custkey BETWEEN 1 AND 80 AND o_orderstatus = 'F' ORDER BY key LIMIT 10000")
def compose_and(spark, d):
    return paths.compose(orders(spark, d), ORDERS, "AND", ("o_custkey", 1, 80), ("o_orderstatus", "F", None), 10000).select("key", "o_custkey", "o_orderstatus")


@query(f"WITH {_ORDERS} SELECT key, o_custkey, o_orderstatus FROM orders_ WHERE (o_custkey BETWEEN 1 AND 10 OR o_orderstatus = 'P') AND key > 'orders:3' ORDER BY key LIMIT 200")
def compose_or(spark, d):
    return paths.compose(orders(spark, d), ORDERS, "OR", ("o_custkey", 1, 10), ("o_orderstatus", "P", None), 200, cursor="orders:3").select("key", "o_custkey", "o_orderstatus")


# ---- views ----

_LEAVES = (Leaf("o_custkey", 1, 400), Leaf("o_orderstatus", "F"), Leaf("o_totalprice", 20000, 150000))
AND_VIEW = View("v_and", "orders", Node("AND", _LEAVES[0], _LEAVES[1]), "o_totalprice").check()
OR_VIEW = View("v_or", "orders", Node("OR", Leaf("o_custkey", 1, 5), Leaf("o_custkey", 90, 95)), "o_totalprice", desc=True).check()
DIFF_VIEW = View("v_diff", "orders", Node("DIFF", Node("AND", _LEAVES[0], _LEAVES[2]), _LEAVES[1]), "o_totalprice").check()
TOP_VIEW = View("v_top", "orders", _LEAVES[1], "o_totalprice", desc=True, materialized=True, topk=50).check()


@query(f"WITH {_ORDERS} SELECT key, o_totalprice FROM orders_ WHERE o_custkey BETWEEN 1 AND 400 AND o_orderstatus = 'F' ORDER BY o_totalprice, key LIMIT 100")
def view_and(spark, d):
    return views.query(orders(spark, d), ORDERS, AND_VIEW, fields=("o_totalprice",))


@query(f"WITH {_ORDERS} SELECT key, o_custkey, o_totalprice FROM orders_ WHERE o_custkey BETWEEN 1 AND 5 OR o_custkey BETWEEN 90 AND 95 ORDER BY o_totalprice DESC, key DESC LIMIT 60")
def view_or(spark, d):
    return views.query(orders(spark, d), ORDERS, OR_VIEW, 60, fields=("o_custkey", "o_totalprice"))


@query(f"WITH {_ORDERS} SELECT key, o_orderstatus FROM orders_ WHERE o_custkey BETWEEN 1 AND 400 AND o_totalprice BETWEEN 20000 AND 150000 AND NOT o_orderstatus = 'F' ORDER BY o_totalprice, key LIMIT 300")
def view_diff(spark, d):
    return views.query(orders(spark, d), ORDERS, DIFF_VIEW, 300, fields=("o_orderstatus",))


@query(f"WITH {_ORDERS} SELECT key, o_totalprice FROM orders_ WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, key DESC LIMIT 50")
def view_topk(spark, d):
    return views.query(orders(spark, d), ORDERS, TOP_VIEW, 200, fields=("o_totalprice",))


@query(f"WITH {_ORDERS} SELECT key, o_custkey, c_name AS via_c_name, c_acctbal AS via_c_acctbal FROM (SELECT * FROM orders_ WHERE o_custkey BETWEEN 1 AND 400 AND o_orderstatus = 'F' ORDER BY o_totalprice, key LIMIT 100) LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def view_via(spark, d):
    rows = views.query(orders(spark, d), ORDERS, AND_VIEW).select("key", "o_custkey")
    target = load(spark, d, "customer").where("c_custkey % 3 <> 0").withColumn("key", F.concat(F.lit("customer:"), F.col("c_custkey")))
    member = F.concat(F.lit("order_of:"), F.col("o_custkey").cast("string"))
    return views.via(rows, target, views.template("customer:{key.1}", member), ("c_name", "c_acctbal"))


@query("SELECT count(*) FILTER (o_custkey BETWEEN 1 AND 400) AS leaf_0, count(*) FILTER (o_totalprice BETWEEN 20000 AND 150000) AS leaf_1, count(*) FILTER (o_orderstatus = 'F') AS leaf_2, count(*) FILTER (o_custkey BETWEEN 1 AND 400 AND o_totalprice BETWEEN 20000 AND 150000 AND o_orderstatus <> 'F') AS members FROM orders")
def view_explain(spark, d):
    return views.explain(orders(spark, d), ORDERS, DIFF_VIEW)


@query(f"WITH {_CUSTOMERS} SELECT count(*) FILTER (c_nationkey BETWEEN 0 AND 12 AND price IS NOT NULL) AS members, count(*) FILTER (c_nationkey BETWEEN 0 AND 12 AND price IS NULL) AS order_excluded FROM customers_")
def view_verify(spark, d):
    return views.verify(customers(spark, d), CUSTOMERS, View("v", "customer", Leaf("c_nationkey", 0, 12), "price"))


# ---- aggregates ----

_GROUPS = "SELECT o_orderpriority AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query(f"{_GROUPS} WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderpriority".replace("o_orderpriority AS grp, ", ""))
def agg_group(spark, d):
    return _rounded(groups.group(orders(spark, d), ORDERS, "by_priority", "1-URGENT"))


@query("SELECT 0::BIGINT AS n, NULL::DOUBLE AS total, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean")
def agg_group_unknown(spark, d):
    return groups.group(orders(spark, d), ORDERS, "by_priority", "none")


for _by, _order in (("count", "n DESC"), ("sum", "total DESC"), ("min", "low"), ("max", "high DESC")):
    _name = f"agg_groups_{_by}"
    QUERIES[_name] = lambda spark, d, by=_by: _rounded(groups.groups(orders(spark, d), ORDERS, "by_priority", by, 3))
    ORACLES[_name] = f"{_GROUPS} GROUP BY o_orderpriority ORDER BY {_order}, grp LIMIT 3"


@query("SELECT CAST(l_suppkey AS VARCHAR) AS grp, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, grp LIMIT 100")
def agg_groups_lineitem(spark, d):
    t = Table("lineitem", "lineitem:", "l_orderkey", (("l_orderkey", "i64"), ("l_suppkey", "str"), ("l_quantity", "f64")), (Index("q", ("l_quantity",), kind="agg", group="l_suppkey"),))
    return _rounded(groups.groups(load(spark, d, "lineitem"), t, "q", "sum", 100))


@query(f"WITH {_CUSTOMERS} SELECT count(*) FILTER (city IS NULL OR price IS NULL) AS excluded, count(*) AS rows FROM customers_")
def agg_excluded(spark, d):
    t = Table("customer", "customer:", "c_custkey", CUSTOMERS.columns, (Index("a", ("price",), kind="agg", group="city"),))
    return groups.excluded(customers(spark, d), t, "a")


# ---- audits ----


@query(f"WITH {_CUSTOMERS} SELECT price AS value, count(*) AS n FROM customers_ WHERE price IS NOT NULL GROUP BY price HAVING count(*) > 1")
def unique_duplicates(spark, d):
    return audits.duplicates(customers(spark, d), CUSTOMERS, "price")


@query(f"""WITH {_CUSTOMERS} SELECT 'c_nationkey' AS path, count(*) AS rows, count(c_nationkey) AS entries, count(*) - count(c_nationkey) AS absent, 0::BIGINT AS coerce_failures FROM customers_
UNION ALL SELECT 'price', count(*), count(price), count(*) FILTER (c_custkey % 7 = 0), count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 11 = 0) FROM customers_
UNION ALL SELECT 'c_acctbal', count(*), count(c_acctbal), count(*) - count(c_acctbal), 0 FROM customers_""")
def table_verify(spark, d):
    return audits.verify_table(customers(spark, d), CUSTOMERS)


@query("SELECT count(*) AS checked, count(*) FILTER (o_orderkey % 10 = 0) AS missing, 0::BIGINT AS stale, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderkey % 13 = 0) AS drift FROM orders")
def index_verify(spark, d):
    o = orders(spark, d)
    stored = paths.keyed(o, ORDERS).where("o_orderkey % 10 <> 0").select("key", F.when(F.col("o_orderkey") % 13 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("value"))
    return audits.verify_stored(o, stored, ORDERS, "o_totalprice")


@query("SELECT 64::BIGINT AS n, 0::BIGINT AS wrong FROM (SELECT count(*) AS n FROM orders) WHERE n >= 64")
def index_spot_check(spark, d):
    o = orders(spark, d)
    checked = audits.spot_check(o, paths.keyed(o, ORDERS).select("key", F.col("o_totalprice").alias("value")), ORDERS, "o_totalprice")
    return checked.agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("wrong"))


@query(f"WITH {_ORDERS}, b AS (SELECT CAST(floor(o_ts / 2592000) AS BIGINT) AS bucket, count(*) AS rows FROM orders_ GROUP BY 1) SELECT bucket, rows, bucket > (SELECT max(bucket) FROM b) - 13 AS hot FROM b")
def window_parts(spark, d):
    return audits.window_parts(orders(spark, d), ORDERS)


@query("SELECT count(*) FILTER (o_orderkey % 9 = 0) AS missing, 0::BIGINT AS extra, count(*) FILTER (o_orderkey % 9 <> 0 AND o_orderkey % 5 = 0) AS changed, 0::BIGINT AS moved FROM orders")
def shadow_compare(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 9 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return audits.shadow(o, new, "o_orderkey")


@query("SELECT 'l_orderkey' AS \"left\", 'l_orderkey_copy' AS \"right\", 1.0::DOUBLE AS share")
def lint_columns(spark, d):
    df = load(spark, d, "lineitem").withColumn("l_orderkey_copy", F.col("l_orderkey"))
    return audits.equal_columns(df, ["l_orderkey", "l_orderkey_copy", "l_quantity"], 0.9)


@query("SELECT n_name AS name, 2::BIGINT AS n, 'customers,suppliers' AS owners FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def lint_overlap(spark, d):
    n = load(spark, d, "nation")
    c = load(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customers").alias("owner"), F.col("n_name").alias("name"))
    s = load(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("suppliers").alias("owner"), F.col("n_name").alias("name"))
    return audits.overlap(c.union(s))


@query("SELECT 'customer:' || k AS key, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT o_custkey AS k, 'orders' AS source FROM orders UNION SELECT c_custkey, 'customer' FROM customer) GROUP BY k")
def key_sources(spark, d):
    k = lambda c: F.concat(F.lit("customer:"), F.col(c).cast("string")).alias("key")
    return audits.sources_of({"orders": load(spark, d, "orders").select(k("o_custkey")), "customer": load(spark, d, "customer").select(k("c_custkey"))})


def _keyspace(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers as one keyspace; every fourth order expires at its date plus a day."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    at = F.when(F.col("o_orderkey") % 4 == 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 86_400_000)
    o = o.select(F.concat(F.lit("orders:"), F.col("o_orderkey")).alias("key"), F.lit("hash").alias("type"), F.col("o_orderstatus").alias("value"), at.alias("expire_at"))
    c = c.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.lit("string").alias("type"), F.col("c_name").alias("value"), F.lit(None).cast("long").alias("expire_at"))
    return o.unionByName(c)


_KEYSPACE = """ks AS (SELECT 'orders:' || o_orderkey AS key, 'hash' AS type, o_orderstatus AS value, CASE WHEN o_orderkey % 4 = 0 THEN CAST(epoch_ms(o_orderdate) + 86400000 AS BIGINT) END AS expire_at FROM orders
UNION ALL SELECT 'customer:' || c_custkey, 'string', c_name, NULL FROM customer)"""


@query(f"WITH {_KEYSPACE} SELECT count(*) AS n, count(expire_at) AS with_ttl FROM ks WHERE starts_with(key, 'orders:')")
def prefix_stats(spark, d):
    return keys.prefix_stats(_keyspace(spark, d), "orders:")


@query(f"WITH {_KEYSPACE}, r AS (SELECT octet_length(encode(key)) || ':' || key || octet_length(encode(type)) || ':' || type || coalesce(octet_length(encode(value)) || ':' || value, '-1:') AS t FROM ks WHERE starts_with(key, 'orders:')) SELECT count(*) AS n, coalesce(bit_xor(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT)), 0) AS digest FROM r")
def prefix_digest(spark, d):
    return keys.digest(_keyspace(spark, d), "orders:", "type", "value")


@query(f"WITH {_KEYSPACE} SELECT key, type FROM ks WHERE regexp_full_match(key, 'orders:[1-3].*5') AND type = 'hash'")
def keys_glob(spark, d):
    return keys.scan(_keyspace(spark, d), "orders:[1-3]*5", "hash").select("key", "type")


@query(f"WITH {_KEYSPACE} SELECT key, expire_at FROM ks WHERE expire_at IS NULL OR expire_at > CAST(epoch_ms(TIMESTAMP '1996-01-01') AS BIGINT)")
def keys_live(spark, d):
    return keys.live(_keyspace(spark, d), 820454400000).select("key", "expire_at")


@query(f"WITH {_KEYSPACE}, a AS (SELECT unnest(['orders:4', 'customer:7', 'nothing:1', 'orders:1']) AS key) SELECT a.key, CAST(CASE WHEN ks.key IS NULL OR expire_at <= 600000000000 THEN -2 WHEN expire_at IS NULL THEN -1 ELSE expire_at - 600000000000 END AS BIGINT) AS ttl FROM a LEFT JOIN ks ON a.key = ks.key")
def keys_ttl(spark, d):
    return keys.ttl(_keyspace(spark, d), 600000000000, ["orders:4", "customer:7", "nothing:1", "orders:1"])


@query(f"WITH {_KEYSPACE} SELECT p AS pos, a.key, value FROM (SELECT unnest([0, 1, 2])::BIGINT AS p, unnest(['customer:3', 'zip', 'orders:1']) AS key) a LEFT JOIN ks ON a.key = ks.key")
def strings_mget(spark, d):
    return keys.mget(_keyspace(spark, d), ["customer:3", "zip", "orders:1"])


@query("SELECT 'u:' || user_id AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY user_id")
def strings_incr(spark, d):
    deltas = load(spark, d, "events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.lit(1).cast("long").alias("delta"))
    return keys.incr(spark.createDataFrame([], "key string, value string"), deltas)


@query("SELECT 'c:' || c_custkey AS key, CAST(strlen(c_name) AS BIGINT) AS n FROM customer")
def strings_strlen(spark, d):
    return keys.strlen(load(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value")))


@query("SELECT key, arg_max(value, seq) AS value FROM (SELECT 'u:' || user_id AS key, event_type AS value, event_id AS seq FROM events) GROUP BY key")
def strings_set_last(spark, d):
    new = load(spark, d, "events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return keys.set_(spark.createDataFrame([], "key string, value string, expire_at long"), new).select("key", "value")


# ---- scalar functions over table columns ----


@query("SELECT p_partkey, lower(p_name) AS f_lower, upper(p_type) AS f_upper, CAST(length(p_name) AS BIGINT) AS f_length, reverse(p_brand) AS f_reverse, replace(p_type, 'A', 'aa') AS f_replace, translate(p_brand, 'Brand', 'bR') AS f_translate, repeat(p_brand, p_size % 3) AS f_repeat, md5(p_name) AS f_md5, p_brand || '/' || p_type AS f_concat, concat_ws('-', p_brand, CASE WHEN p_size > 25 THEN p_type END) AS f_ws, concat(p_brand, CASE WHEN p_size > 25 THEN p_type END) AS f_skip FROM part")
def scalar_string(spark, d):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    some = F.when(F.col("p_size") > 25, t)
    return load(spark, d, "part").select("p_partkey", S.lower(n).alias("f_lower"), S.upper(t).alias("f_upper"), S.length(n).cast("long").alias("f_length"), S.reverse(b).alias("f_reverse"), S.replace(t, "A", "aa").alias("f_replace"), S.translate(b, "Brand", "bR").alias("f_translate"), S.repeat(b, F.col("p_size") % 3).alias("f_repeat"), S.md5(n).alias("f_md5"), F.concat(b, F.lit("/"), t).alias("f_concat"), S.concat_ws("-", b, some).alias("f_ws"), S.concat(b, some).alias("f_skip"))


@query("SELECT p_partkey, left(p_name, 3) AS f_left, left(p_name, -3) AS f_left_neg, right(p_name, 4) AS f_right, right(p_name, -4) AS f_right_neg, substr(p_name, 2, 5) AS f_substr, substr(p_name, 1, greatest(p_size % 5 - 2, 0)) AS f_substr_low, split_part(p_name, ' ', 2) AS f_part, split_part(p_name, ' ', -1) AS f_part_last, CAST(strpos(p_name, 'a') AS BIGINT) AS f_pos FROM part")
def scalar_slice(spark, d):
    n = F.col("p_name")
    # from -1 on, p_size % 5 characters: those before the first one don't exist
    return load(spark, d, "part").select("p_partkey", S.left(n, 3).alias("f_left"), S.left(n, -3).alias("f_left_neg"), S.right(n, 4).alias("f_right"), S.right(n, -4).alias("f_right_neg"), S.substr(n, 2, 5).alias("f_substr"), S.substr(n, -1, F.col("p_size") % 5).alias("f_substr_low"), S.split_part(n, " ", 2).alias("f_part"), S.split_part(n, " ", -1).alias("f_part_last"), S.strpos(n, "a").cast("long").alias("f_pos"))


@query("SELECT p_partkey, trim('  ' || p_name || ' ', ' ') AS f_trim, ltrim(p_brand, 'Bra') AS f_ltrim, rtrim(p_type, 'DELRS') AS f_rtrim FROM part")
def scalar_trim(spark, d):
    return load(spark, d, "part").select("p_partkey", S.btrim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("f_trim"), S.ltrim(F.col("p_brand"), "Bra").alias("f_ltrim"), S.rtrim(F.col("p_type"), "DELRS").alias("f_rtrim"))


@query("SELECT p_partkey, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, 'xy') AS f_rpad, lpad(p_name, 4, ' ') AS f_cut, p_brand AS f_empty_fill FROM part")
def scalar_pad(spark, d):
    b = F.col("p_brand")
    return load(spark, d, "part").select("p_partkey", S.lpad(b, 12, "*").alias("f_lpad"), S.rpad(b, 12, "xy").alias("f_rpad"), S.lpad(F.col("p_name"), 4).alias("f_cut"), S.lpad(b, 99, "").alias("f_empty_fill"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_type || '_x9', '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS f_initcap FROM part")
def scalar_initcap(spark, d):
    return load(spark, d, "part").select("p_partkey", S.initcap(F.concat("p_name", F.lit("-"), "p_type", F.lit("_x9"))).alias("f_initcap"))


@query("SELECT p_partkey, 'part ' || p_name || ' is ''' || replace(p_type, '''', '''''') || ''' at 100%' AS f_format FROM part")
def scalar_format(spark, d):
    return load(spark, d, "part").select("p_partkey", S.format_("part %s is %L at 100%%", F.col("p_name"), F.col("p_type")).alias("f_format"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS f_first, regexp_replace(p_name, '[aeiou]', '#', 'g') AS f_all, regexp_replace(p_name, '(\w)(\w)', '\2\1') AS f_groups, regexp_replace(p_type, 'e', '.', 'gi') AS f_case, string_split_regex(p_name, '\s+')[1] AS f_split, regexp_extract(p_brand, '([A-Za-z]+)', 1) AS f_match FROM part")
def scalar_regexp(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", S.regexp_replace(n, "[aeiou]", "#").alias("f_first"), S.regexp_replace(n, "[aeiou]", "#", "g").alias("f_all"), S.regexp_replace(n, r"(\w)(\w)", r"\2\1").alias("f_groups"), S.regexp_replace(F.col("p_type"), "e", ".", "gi").alias("f_case"), F.get(S.regexp_split_to_array(n, r"\s+"), 0).alias("f_split"), F.get(S.regexp_matches(F.col("p_brand"), "([A-Za-z]+)"), 0).alias("f_match"))


@query("SELECT p_partkey, floor(p_retailprice) AS f_floor, ceil(p_retailprice) AS f_ceil, CASE WHEN p_retailprice >= 0 THEN floor(p_retailprice * 10 + 0.5::DOUBLE) ELSE ceil(p_retailprice * 10 - 0.5::DOUBLE) END / 10 AS f_round, CASE WHEN p_retailprice - 1200 >= 0 THEN floor(p_retailprice - 1200 + 0.5::DOUBLE) ELSE ceil(p_retailprice - 1200 - 0.5::DOUBLE) END AS f_round_neg, sign(p_retailprice - 1200) * floor(abs((p_retailprice - 1200) * 100)) / 100 AS f_trunc, abs(p_size - 25) AS f_abs, CAST(sign(p_size - 25) AS BIGINT) AS f_sign, sqrt(p_size) AS f_sqrt, CAST((p_size - 25) % 7 AS BIGINT) AS f_mod, CAST((p_size - 25) // 7 AS BIGINT) AS f_div, CAST(pow(p_size, 3) AS BIGINT) AS f_pow FROM part")
def scalar_math(spark, d):
    p, z = F.col("p_retailprice"), F.col("p_size")
    return load(spark, d, "part").select("p_partkey", S.floor(p).alias("f_floor"), S.ceil(p).alias("f_ceil"), S.round_(p, 1).alias("f_round"), S.round_(p - 1200).alias("f_round_neg"), S.trunc(p - 1200, 2).alias("f_trunc"), S.abs_(z - 25).alias("f_abs"), S.sign(z - 25).alias("f_sign"), S.sqrt(z).alias("f_sqrt"), S.mod(z - 25, 7).cast("long").alias("f_mod"), S.div(z - 25, 7).alias("f_div"), S.power(z, 3, whole=True).alias("f_pow"))


@query(f"WITH {_CUSTOMERS} SELECT c_custkey, coalesce(city, 'none') AS f_coalesce, nullif(city, 'BUILDING') AS f_nullif, greatest(price, CAST(c_nationkey AS BIGINT)) AS f_greatest, least(price, CAST(c_nationkey AS BIGINT)) AS f_least FROM customers_")
def scalar_nullfam(spark, d):
    c = customers(spark, d)
    p, n = paths.value(c, CUSTOMERS, "price"), F.col("c_nationkey").cast("long")
    return c.select("c_custkey", S.coalesce("city", F.lit("none")).alias("f_coalesce"), S.nullif(F.col("city"), "BUILDING").alias("f_nullif"), S.greatest(p, n).alias("f_greatest"), S.least(p, n).alias("f_least"))


@query(f"WITH {_CUSTOMERS} SELECT c_custkey, (price > 5 AND city = 'BUILDING') AS f_and, (price > 5 OR city = 'BUILDING') AS f_or, NOT (price > 5) AS f_not, price <> 3 AS f_ne, CASE WHEN price > 10 THEN 'high' WHEN price > 5 THEN 'mid' ELSE 'low' END AS f_case FROM customers_")
def scalar_logic(spark, d):
    c = customers(spark, d)
    p = paths.value(c, CUSTOMERS, "price")
    b = F.col("city") == "BUILDING"
    return c.select("c_custkey", ((p > 5) & b).alias("f_and"), ((p > 5) | b).alias("f_or"), (~(p > 5)).alias("f_not"), (p != 3).alias("f_ne"), F.when(p > 10, "high").when(p > 5, "mid").otherwise("low").alias("f_case"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal + 0.5::DOUBLE) ELSE ceil(c_acctbal - 0.5::DOUBLE) END::BIGINT AS f_int, CAST(c_custkey % 2 = 0 AS VARCHAR) AS f_bool_text, c_custkey % 2 = 0 AS f_bool FROM customer")
def scalar_casts(spark, d):
    even = F.col("c_custkey") % 2 == 0
    return load(spark, d, "customer").select("c_custkey", S.to_int(F.col("c_acctbal")).alias("f_int"), S.bool_text(even).alias("f_bool_text"), S.to_bool(F.when(even, " ON ").otherwise("off")).alias("f_bool"))


@query("SELECT o_orderkey, extract(year FROM o_orderdate)::DOUBLE AS f_year, extract(quarter FROM o_orderdate)::DOUBLE AS f_quarter, extract(dow FROM o_orderdate)::DOUBLE AS f_dow, extract(doy FROM o_orderdate)::DOUBLE AS f_doy, epoch(o_orderdate)::DOUBLE AS f_epoch, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS f_unix, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d %H:%M:%S') AS f_week, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS f_trunc_quarter FROM orders")
def scalar_datetime(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", S.extract("year", t).alias("f_year"), S.extract("quarter", t).alias("f_quarter"), S.date_part("dow", t).alias("f_dow"), S.date_part("doy", t).alias("f_doy"), S.date_part("epoch", t).alias("f_epoch"), S.unix_timestamp(t).alias("f_unix"), F.date_format(S.date_trunc("week", t), "yyyy-MM-dd HH:mm:ss").alias("f_week"), F.date_format(S.date_trunc("quarter", t), "yyyy-MM-dd").alias("f_trunc_quarter"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS f_plus, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS f_minus, CAST(date_diff('day', DATE '1995-03-17', CAST(o_orderdate AS DATE)) AS BIGINT) AS f_days FROM orders")
def scalar_interval(spark, d):
    t, form = F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss"
    return load(spark, d, "orders").select("o_orderkey", F.date_format(S.add_interval(t, S.interval(1, 3, 5_400_000_000)), form).alias("f_plus"), F.date_format(S.add_interval(t, S.interval(1), -1), form).alias("f_minus"), S.date_minus(t.cast("date"), F.lit("1995-03-17").cast("date")).alias("f_days"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS f_char, rpad(strftime(o_orderdate, '%B'), 9, ' ') || '|' || strftime(o_orderdate, '%b') AS f_month FROM orders")
def scalar_to_char(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", S.to_char(t, "YYYY/MM/DD HH24:MI:SS").alias("f_char"), S.to_char(t, "Month|Mon").alias("f_month"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S 100%%') AS f_format, strftime(o_orderdate, '%B %b') AS f_names, strftime(to_timestamp(o_orderkey * 86400), '%Y-%m-%d') AS f_from FROM orders")
def scalar_mysql_dates(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", S.date_format(t, "%Y-%m-%d %H:%i:%s 100%%").alias("f_format"), S.date_format(t, "%M %b").alias("f_names"), S.from_unixtime(F.col("o_orderkey") * 86400, "%Y-%m-%d").alias("f_from"))


@query()
def scalar_age(spark, d):
    return load(spark, d, "orders").select("o_orderkey", S.render_interval(S.age(F.lit("1998-12-31").cast("timestamp"), F.col("o_orderdate"))).alias("f_age"))


@query("SELECT 'Ab-Cd' AS c0, '-3' AS c1, '3' AS c2, 't' AS c3, '2024-02-29 00:00:00' AS c4, CAST(NULL AS VARCHAR) AS c5")
def sql_fold(spark, d):
    return fold.evaluate(spark, "SELECT initcap('AB-CD'), 7 / -2, round(2.5)::int, 'yes'::bool OR NULL, timestamp '2024-01-31 00:00:00' + interval '1 month', nullif('a', 'a')")


# ---- full text ----

_POSTINGS = """tokens_ AS (SELECT 'documents:' || doc_id AS key, doc_id, lang, source, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
  SELECT *, list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 2), lambda w: lower(w)) AS t FROM documents))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").withColumn("key", F.concat(F.lit("documents:"), F.col("doc_id")))


def _post(spark: SparkSession, d: str) -> DataFrame:
    return text.postings(_docs(spark, d), ("text",))


def _bm25(terms: str, extra: str = "", scope: str = "tokens_") -> str:
    return f"""lens AS (SELECT key, count(*) AS dl FROM {scope} GROUP BY key), st AS (SELECT avg(dl) AS avgdl FROM lens), nn AS (SELECT count(DISTINCT key) AS n FROM tokens_),
tf AS (SELECT key, term, count(*) AS tf FROM {scope} WHERE {terms} GROUP BY key, term), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT tf.key, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN dfr USING (term) JOIN lens ON lens.key = tf.key, st, nn {extra} GROUP BY tf.key)"""


@query(f"WITH {_POSTINGS} SELECT key, 'text' AS field, CAST(pos AS INTEGER) AS pos, term FROM tokens_")
def text_tokenize(spark, d):
    return _post(spark, d)


def _top(matched: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page by the score as it is shown."""
    return text.top(matched.withColumn("score", F.round("score", 6)), limit, offset)


@query(f"WITH {_POSTINGS}, {_bm25(chr(39).join(['term IN (', 'license', ', ', 'version', ', ', 'reserved', ')']))} SELECT key, score FROM sc ORDER BY score DESC, key LIMIT 20")
def bm25_or(spark, d):
    return _top(text.match_texts(_docs(spark, d), "License reserved VERSION license", ("text",)), 20)


@query(f"WITH {_POSTINGS}, {_bm25(chr(39).join(['starts_with(term, ', 'licen', ')']))} SELECT key, score FROM sc ORDER BY score DESC, key LIMIT 20")
def bm25_prefix(spark, d):
    return _top(text.match_texts(_docs(spark, d), "licen*", ("text",)), 20)


@query(f"WITH {_POSTINGS}, {_bm25(chr(39).join(['levenshtein(term, ', 'license', ') <= 1']))} SELECT key, score FROM sc ORDER BY score DESC, key LIMIT 50")
def bm25_typo(spark, d):
    return _top(text.match_texts(_docs(spark, d), "license", ("text",), typo=1), 50)


@query(f"""WITH {_POSTINGS}, {_bm25(chr(39).join(['term IN (', 'apache', ', ', 'license', ')']))}, ph AS (SELECT DISTINCT a.key FROM tokens_ a JOIN tokens_ b ON a.key = b.key AND b.pos = a.pos + 1 WHERE a.term = 'apache' AND b.term = 'license')
SELECT key, score FROM sc WHERE key IN (SELECT key FROM ph) ORDER BY score DESC, key LIMIT 30""")
def bm25_phrase(spark, d):
    return _top(text.match_texts(_docs(spark, d), '"apache license"', ("text",)), 30)


@query(f"""WITH {_POSTINGS}, two AS (SELECT key, term, 'text' AS field FROM tokens_ UNION ALL SELECT 'documents:' || doc_id, source, 'source' FROM documents WHERE length(source) >= 2),
lens AS (SELECT key, count(*) AS dl FROM two GROUP BY key), st AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM lens),
f AS (SELECT key, term, field, count(*) AS c FROM two WHERE term IN ('license', 'src3') GROUP BY ALL), tf AS (SELECT key, term, sum(greatest(ceil(c * CASE WHEN field = 'source' THEN 5.0 ELSE 1.5 END), 1)) AS tf FROM f GROUP BY ALL), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.key, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN dfr USING (term) JOIN lens ON lens.key = tf.key, st GROUP BY tf.key ORDER BY score DESC, tf.key LIMIT 40""")
def bm25_fields_weighted(spark, d):
    return _top(text.match_texts(_docs(spark, d), "license src3", ("text", "source"), weights={"source": 5.0, "text": 1.5}), 40)


@query("""WITH lens AS (SELECT 'documents:' || doc_id AS key, source, 1.0::DOUBLE AS dl FROM documents), nn AS (SELECT count(*) AS n FROM documents), dfr AS (SELECT count(*) AS df FROM documents WHERE source = 'src3')
SELECT key, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * 2.2::DOUBLE / 2.2::DOUBLE, 6) AS score FROM lens, nn, dfr WHERE source = 'src3' ORDER BY score DESC, key LIMIT 1000""")
def bm25_scoped(spark, d):
    return _top(text.match_texts(_docs(spark, d), "src3", ("text", "source"), within=("source",)), 1000)


_indexes: dict[tuple[str, str, tuple[str, ...]], str] = {}


def _index(spark: SparkSession, d: str, fields: tuple[str, ...]) -> str:
    """Path of the stored index of some fields of a folder's documents."""
    return _stored(spark, (d, fields), lambda path: text_index.build(_docs(spark, d), path, fields))


def _stored(spark: SparkSession, what: tuple, build: Callable[[str], None]) -> str:
    """Path of an index, built once for an application, in the shared folder."""
    context = spark.sparkContext
    at = (context.applicationId, *what)
    if at not in _indexes:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_indexes"
        folder = f"{root.rstrip('/')}/lodestone-index-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        new = f"{folder}/{uuid.uuid4().hex}"
        build(new)
        _indexes[at] = new
    return _indexes[at]


for _name, _terms, _query, _limit in (("or", "license reserved version", "License reserved VERSION license", 20), ("one", "license", "license", 20)):

    def _indexed(spark, d, _query=_query, _limit=_limit):
        return _top(text_index.match(spark, _index(spark, d, ("text",)), _query), _limit)

    _in = ", ".join(f"'{t}'" for t in _terms.split())
    QUERIES[f"bm25_indexed_{_name}"], ORACLES[f"bm25_indexed_{_name}"] = _indexed, f"WITH {_POSTINGS}, {_bm25(f'term IN ({_in})')} SELECT key, score FROM sc ORDER BY score DESC, key LIMIT {_limit}"

for _name, _query, _limit in (("prefix", "licen*", 20), ("phrase", '"apache license"', 30)):

    def _indexed(spark, d, _query=_query, _limit=_limit):
        return _top(text_index.match(spark, _index(spark, d, ("text",)), _query), _limit)

    QUERIES[f"bm25_indexed_{_name}"], ORACLES[f"bm25_indexed_{_name}"] = _indexed, ORACLES[f"bm25_{_name}"]


@query(f"WITH {_POSTINGS}, m AS (SELECT DISTINCT key FROM tokens_ WHERE term = 'license') SELECT lang AS value, count(*) AS n FROM m JOIN documents ON m.key = 'documents:' || doc_id WHERE source <> 'src1' GROUP BY lang")
def bm25_filter_facet(spark, d):
    found = text.match(_post(spark, d), "license").join(_docs(spark, d).select("key", "lang", "source"), "key").where("source <> 'src1'")
    return found.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n"))


@query()
def text_highlight(spark, d):
    marked = text.highlight(_docs(spark, d), '"apache license" reserved', ("text",))
    return marked.select("key", "field", F.transform("spans", lambda s: F.concat_ws("-", s["lo"], s["hi"])).cast("string").alias("spans"))


# ---- vectors ----


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = load(spark, d, "embeddings").withColumn("key", F.concat(F.lit("embeddings:"), F.col("vec_id")))
    return e, [float(x) for x in e.where("vec_id = 0").first().embedding]


_VEC = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT 'embeddings:' || vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings)"
for _metric, _dist in (("cosine", "1 - list_cosine_similarity(v, q)"), ("l2", "list_distance(v, q) ** 2"), ("ip", "-list_dot_product(v, q)")):
    _name = f"knn_{_metric}"

    def _knn(spark, d, metric=_metric):
        e, q = _vectors(spark, d)
        return vectors.knn(e, "embedding", q, 20, metric).select("key", F.round("dist", 6).alias("dist"))

    QUERIES[_name], ORACLES[_name] = _knn, f"WITH {_VEC} SELECT key, CASE WHEN abs(round({_dist}, 6)) = 0 THEN 0.0::DOUBLE ELSE round({_dist}, 6) END AS dist FROM e, q ORDER BY {_dist}, key LIMIT 20"


def _nonzero(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.when(F.col("dist") == 0, 0.0).otherwise(F.col("dist")))


for _metric in ("cosine", "l2", "ip"):
    QUERIES[f"knn_{_metric}"] = lambda spark, d, f=QUERIES[f"knn_{_metric}"]: _nonzero(f(spark, d))


def _cells(spark: SparkSession, d: str, metric: str) -> str:
    e, q = _vectors(spark, d)
    return _stored(spark, (d, "embedding", metric), lambda path: vector_index.build(e, path, "embedding", len(q), metric))


for _metric in ("cosine", "l2", "ip"):

    def _knn_indexed(spark, d, metric=_metric):
        found = vector_index.knn(spark, _cells(spark, d, metric), _vectors(spark, d)[1], 20, ef=16, exact=True)
        return _nonzero(found.select("key", F.round("dist", 6).alias("dist")))

    QUERIES[f"knn_indexed_{_metric}"], ORACLES[f"knn_indexed_{_metric}"] = _knn_indexed, ORACLES[f"knn_{_metric}"]


@query(f"""WITH {_VEC}, {_POSTINGS}, {_bm25(chr(39).join(['term IN (', 'license', ', ', 'version', ')']))},
a AS (SELECT replace(key, 'documents:', '') AS id, row_number() OVER (ORDER BY score DESC, key) AS r FROM sc ORDER BY score DESC, key LIMIT 40),
b AS (SELECT replace(key, 'embeddings:', '') AS id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(v, q), key) AS r FROM e, q ORDER BY r LIMIT 40)
SELECT id AS key, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) DESC, id LIMIT 10""")
def hybrid_rrf(spark, d):
    e, q = _vectors(spark, d)
    words = vectors.ranked(_top(text.match_texts(_docs(spark, d), "license version", ("text",)), 40), F.desc("score"), "key").withColumn("key", F.regexp_replace("key", "documents:", ""))
    near = vectors.ranked(vectors.knn(e, "embedding", q, 40), "dist", "key").withColumn("key", F.regexp_replace("key", "embeddings:", ""))
    return vectors.rrf([words, near], 10).withColumn("score", F.round("score", 6))


# ---- sets, sorted sets, lists, hashes, bitmaps, geo ----


def _users(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("member")).distinct()


_KINDS = "(SELECT DISTINCT event_type FROM events ORDER BY event_type)"


def _kinds(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in load(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]


_FIRST = f"event_type = (SELECT event_type FROM {_KINDS} LIMIT 1)"
_SETS = {
    "union": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS member FROM events",
    "inter": "SELECT CAST(user_id AS VARCHAR) AS member FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "diff": f"SELECT CAST(user_id AS VARCHAR) AS member FROM events GROUP BY user_id HAVING count(*) FILTER ({_FIRST}) > 0 AND count(*) FILTER (NOT {_FIRST}) = 0",
}

for _op, _sql in _SETS.items():

    def _setop(spark, d, op=_op):
        return getattr(sets, op)([_users(spark, d, k) for k in _kinds(spark, d)])

    QUERIES[f"set_{_op}"], ORACLES[f"set_{_op}"] = _setop, _sql


@query("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def set_card(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()
    return sets.card(e)


def _zset(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a status by their dearest order."""
    return load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(F.max("o_totalprice").alias("score"))


_ZSET = "z AS (SELECT o_orderstatus AS key, CAST(o_custkey AS VARCHAR) AS member, max(o_totalprice) AS score FROM orders GROUP BY ALL)"


@query(f"WITH {_ZSET} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z")
def zset_rank(spark, d):
    return zsets.rank(_zset(spark, d))


@query(f"WITH {_ZSET}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member, score, rank FROM r WHERE rank BETWEEN n - 10 AND n - 2")
def zset_range(spark, d):
    return zsets.range_(_zset(spark, d), -10, -2)


@query(f"WITH {_ZSET} SELECT key, member, score FROM z WHERE key = 'F' AND score > 100000 AND score <= 300000 ORDER BY score, member LIMIT 50 OFFSET 5")
def zset_range_by_score(spark, d):
    return zsets.range_by_score(_zset(spark, d).where("key = 'F'"), "(100000", 300000, 5, 50)


@query(f"WITH {_ZSET} SELECT key, member, score FROM z WHERE key = 'O' AND score >= 1000 ORDER BY score DESC, member DESC LIMIT 30")
def zset_rev_range_by_score(spark, d):
    return zsets.range_by_score(_zset(spark, d).where("key = 'O'"), 1000, "+inf", 0, 30, reverse=True)


@query(f"WITH {_ZSET} SELECT key, count(*) AS n FROM z WHERE score BETWEEN 50000 AND 250000 GROUP BY key")
def zset_count(spark, d):
    return zsets.count(_zset(spark, d), 50000, 250000)


def _two(spark: SparkSession, d: str) -> list[DataFrame]:
    return [_zset(spark, d).where(F.col("key") == k).select("member", "score") for k in ("F", "O")]


@query(f"WITH {_ZSET} SELECT member, round(sum(score * CASE WHEN key = 'F' THEN 2.0 ELSE 0.5 END), 4) AS score FROM z WHERE key IN ('F', 'O') GROUP BY member")
def zunion_weighted(spark, d):
    return zsets.union(_two(spark, d), [2.0, 0.5]).withColumn("score", F.round("score", 4))


@query(f"WITH {_ZSET} SELECT member, max(score) AS score FROM z WHERE key IN ('F', 'O') GROUP BY member HAVING count(*) = 2")
def zinter_max(spark, d):
    return zsets.inter(_two(spark, d), aggregate="MAX")


@query(f"WITH {_ZSET} SELECT member, score FROM z WHERE key = 'F' AND member NOT IN (SELECT member FROM z WHERE key = 'P')")
def zdiff(spark, d):
    z = _zset(spark, d)
    return zsets.diff([z.where("key = 'F'").select("member", "score"), z.where("key = 'P'").select("member", "score")])


@query(f"WITH {_ZSET} SELECT least(count(*), 500) AS n FROM (SELECT member FROM z WHERE key IN ('F', 'O') GROUP BY member HAVING count(*) = 2)")
def zintercard(spark, d):
    return zsets.inter_card(_two(spark, d), 500)


@query(f"WITH {_ZSET} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM z) WHERE r <= 7 AND score < 120000")
def zpop_below(spark, d):
    return zsets.pop_min(_zset(spark, d), 7, 120000.0)[0]


@query("SELECT 'u' AS key, CAST(user_id AS VARCHAR) AS member, max(value) AS score FROM events GROUP BY user_id")
def zadd_gt(spark, d):
    new = load(spark, d, "events").select(F.lit("u").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"))
    half = new.where("score < 50").groupBy("key", "member").agg(F.max("score").alias("score"))
    return zsets.add(half, new, gt=True)


def _hash(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("visits"), (F.col("c_custkey") % 100).cast("string"))
    return load(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), fields.alias("fields"))


@query("SELECT 'customer:' || c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS missing FROM customer")
def hash_project(spark, d):
    return hashes.get(_hash(spark, d), "name", "segment", "missing")


@query("SELECT 'customer:' || c_custkey AS key, CAST(c_custkey % 100 + 5 AS VARCHAR) AS visits, '2.5' AS score FROM customer")
def hash_incr(spark, d):
    return hashes.get(hashes.increment(hashes.increment(_hash(spark, d), "visits", 5), "score", 2.5), "visits", "score")


@query("SELECT 'customer:' || c_custkey AS key, unnest(['name', 'segment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer")
def hash_scan(spark, d):
    return hashes.entries(hashes.delete(_hash(spark, d), "visits"), "*[nm]e*")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return load(spark, d, "events").groupBy(F.concat(F.lit("user:"), F.col("user_id")).alias("key")).agg(items.alias("items"))


_LISTS = "l AS (SELECT 'user:' || user_id AS key, list(event_type ORDER BY event_id) AS items FROM events GROUP BY user_id)"


@query(f"WITH {_LISTS} SELECT key, array_to_string(items[2:-2], ',') AS items FROM l")
def list_range(spark, d):
    return lists.range_(_lists(spark, d), 1, -2).withColumn("items", F.array_join("items", ","))


@query(f"WITH {_LISTS} SELECT key, items[-1] AS item, CAST(len(items) AS BIGINT) AS n FROM l")
def list_index(spark, d):
    rows = _lists(spark, d)
    return lists.index(rows, -1).join(lists.length(rows), "key")


@query(f"WITH {_LISTS} SELECT key, array_to_string(list_filter(items, lambda x: x <> 'click'), ',') AS items FROM l WHERE len(list_filter(items, lambda x: x <> 'click')) > 0")
def list_remove(spark, d):
    return lists.remove(_lists(spark, d), 0, "click").withColumn("items", F.array_join("items", ","))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(bit_count(bit_or(1::BIGINT << CAST(event_id % 32 AS INTEGER))) AS BIGINT) AS n FROM events GROUP BY user_id")
def bit_counts(spark, d):
    e = load(spark, d, "events").select("user_id", (F.col("event_id") % 32).alias("b"))
    byte = lambda k: F.lpad(F.hex(F.coalesce(F.bit_or(F.when(F.floor(F.col("b") / 8) == k, F.pow(F.lit(2), 7 - F.col("b") % 8).cast("long"))), F.lit(0).cast("long"))), 2, "0")
    maps = e.groupBy("user_id").agg(F.unhex(F.concat(*[byte(k) for k in range(4)])).alias("bits"))
    return maps.select(F.col("user_id").cast("string").alias("key"), bitmaps.bit_count(F.col("bits")).alias("n"))


@query("SELECT c_custkey, hex((c_custkey % 256) & 60) AS f_and, CAST((c_custkey % 256) >> 5 & 1 AS INTEGER) AS f_get FROM customer WHERE c_custkey % 256 & 60 > 15")
def bit_ops(spark, d):
    b = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"))
    rows = load(spark, d, "customer").where((F.col("c_custkey") % 256).bitwiseAND(F.lit(60)) > 15)
    return rows.select("c_custkey", F.hex(bitmaps.bit_op("AND", b, F.lit(bytes([60])))).alias("f_and"), bitmaps.get_bit(b, 2).alias("f_get"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers at places that follow from their key."""
    lon = (F.col("s_suppkey") * 37 % 3600) / 10.0 - 180.0
    lat = (F.col("s_suppkey") * 53 % 1600) / 10.0 - 80.0
    return load(spark, d, "supplier").select(F.lit("suppliers").alias("key"), F.col("s_name").alias("member"), lon.alias("lon"), lat.alias("lat"))


_PLACES = "p AS (SELECT s_name AS member, (s_suppkey * 37 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon, (s_suppkey * 53 % 1600) / 10.0::DOUBLE - 80.0::DOUBLE AS lat FROM supplier)"
_HAVERSINE = "2 * 6372797.560856::DOUBLE * asin(sqrt(sin((radians(lat) - radians(10.0::DOUBLE)) / 2) ** 2 + cos(radians(10.0::DOUBLE)) * cos(radians(lat)) * sin((radians(lon) - radians(20.0::DOUBLE)) / 2) ** 2)) / 1000"


@query(f"WITH {_PLACES} SELECT member, round({_HAVERSINE}, 3) AS dist FROM p WHERE {_HAVERSINE} <= 5000 ORDER BY {_HAVERSINE}, member LIMIT 25")
def geo_radius(spark, d):
    return geo.search(_places(spark, d), 20.0, 10.0, radius=5000, unit="km", count=25).select("member", F.round("dist", 3).alias("dist"))


@query(f"WITH {_PLACES} SELECT member, round({_HAVERSINE}, 3) AS dist FROM p")
def geo_dist(spark, d):
    return _places(spark, d).select("member", F.round(geo.distance(F.lit(20.0), F.lit(10.0), F.col("lon"), F.col("lat"), "km"), 3).alias("dist"))


@query()
def geo_hash(spark, d):
    return geo.add(_places(spark, d)).select("member", "score", geo.geohash(F.col("score")).alias("hash"))


# ---- streams and feeds ----


def _stream(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.lit("events").alias("stream"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("order"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("fields"), "event_id", "user_id")
    return entries.add(None, e)


_STREAM = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq FROM events)"


@query(f"WITH {_STREAM}, b AS (SELECT min(ms) + (max(ms) - min(ms)) // 4 AS lo, min(ms) + (max(ms) - min(ms)) // 2 AS hi FROM s) SELECT ms, seq, event_id FROM s, b WHERE ms BETWEEN lo AND hi ORDER BY ms, seq LIMIT 200")
def stream_range(spark, d):
    s = _stream(spark, d)
    lo, hi = s.agg(F.min("ms"), F.max("ms")).first()
    return entries.range_(s, str(lo + (hi - lo) // 4), str(lo + (hi - lo) // 2), 200).select("ms", "seq", "event_id")


@query(f"WITH {_STREAM} SELECT ms, seq, event_id FROM s ORDER BY ms DESC, seq DESC LIMIT 500")
def stream_trim(spark, d):
    return entries.trim(_stream(spark, d), maxlen=500).select("ms", "seq", "event_id")


@query(f"WITH {_STREAM} SELECT 'events' AS stream, count(*) AS length, arg_min(ms || '-' || seq, (ms, seq)) AS first_id, arg_max(ms || '-' || seq, (ms, seq)) AS last_id FROM s")
def stream_info(spark, d):
    return entries.info(_stream(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Every event is delivered to one of four consumers; two in three are acknowledged."""
    s = _stream(spark, d)
    base = s.select(F.lit("g").alias("grp"), "ms", "seq", F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer"), F.col("ms").alias("at"), "event_id")
    return base.withColumn("action", F.lit("deliver")).drop("event_id").unionByName(base.where("event_id % 3 <> 0").withColumns({"action": F.lit("ack"), "at": F.col("at") + 5}).drop("event_id"))


@query(f"WITH {_STREAM} SELECT 'g' AS grp, 'c' || user_id % 4 AS consumer, count(*) AS n, arg_min(ms || '-' || seq, (ms, seq)) AS min_id, arg_max(ms || '-' || seq, (ms, seq)) AS max_id FROM s WHERE event_id % 3 = 0 GROUP BY 1, 2")
def group_pending(spark, d):
    return entries.pending_summary(entries.pending(_log(spark, d)))


@query(f"WITH {_STREAM}, t AS (SELECT max(ms) AS now FROM s), i AS (SELECT ms, seq FROM s, t WHERE event_id % 3 = 0 AND now - ms >= 1000 ORDER BY ms, seq LIMIT 100) SELECT consumer, count(*) AS n FROM (SELECT CASE WHEN (ms, seq) IN (SELECT (ms, seq) FROM i) THEN 'rescue' ELSE 'c' || user_id % 4 END AS consumer FROM s WHERE event_id % 3 = 0) GROUP BY consumer")
def group_autoclaim(spark, d):
    log = _log(spark, d)
    now = _stream(spark, d).agg(F.max("ms")).first()[0]
    claimed = entries.auto_claim(log, "g", "rescue", now, 1000, count=100)
    return entries.pending(claimed).groupBy("consumer").agg(F.count("*").alias("n"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.when(F.col("event_id") % 17 == 0, "del").otherwise("set").alias("op"), F.col("event_type").alias("value"))
    return feed.number(e, 4)


@query("SELECT key, value FROM (SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS last FROM events GROUP BY user_id) WHERE last % 17 <> 0")
def feed_replay(spark, d):
    return feed.replay(_feed(spark, d))


@query("SELECT count(*) AS frames, 4::BIGINT AS shards FROM events")
def feed_tail(spark, d):
    t = feed.tail(_feed(spark, d))
    return t.agg(F.sum("offset").alias("frames"), F.count("*").alias("shards"))


@query("SELECT channel, count(*) AS n FROM (SELECT CASE WHEN event_id % 17 = 0 THEN 'del' ELSE 'set' END AS op, 'user:' || user_id AS key FROM events) CROSS JOIN LATERAL (SELECT unnest(['__keyspace@0__:' || key, '__keyevent@0__:' || op]) AS channel) GROUP BY channel")
def keyspace_notifications(spark, d):
    return feed.notifications(_feed(spark, d)).groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT channel, pattern, count(*) AS n FROM (SELECT event_type AS channel, unnest(['c*', '*e*']) AS pattern FROM events) WHERE (pattern = 'c*' AND starts_with(channel, 'c')) OR (pattern = '*e*' AND contains(channel, 'e')) GROUP BY ALL")
def pubsub_patterns(spark, d):
    return live.psubscribe(load(spark, d, "events").select(F.col("event_type").alias("channel")), "c*", "*e*").groupBy("channel", "pattern").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Extension: event-time windows, as a batch; the same function runs on a stream."""
    e = load(spark, d, "events")
    return live.windowed(e, "event_type", "1 hour", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- sources, compiler ----


@query(f"WITH {_CUSTOMERS} SELECT key, c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, city, price, c_acctbal FROM customers_")
def source_typed(spark, d):
    return sources.typed(customers(spark, d), CUSTOMERS)


@query("SELECT 'customer:' || c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def dump_load(spark, d):
    back = sources.load(sources.dump(_hash(spark, d).withColumn("expire_at", F.lit(5).cast("long"))))
    return hashes.get(back, "name", "segment")


SCHEMA = """
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text NOT NULL, c_nationkey int, c_mktsegment varchar(20), c_acctbal double precision);
CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint REFERENCES customer(c_custkey), o_orderstatus char(1), o_totalprice double precision, o_orderpriority text);
CREATE INDEX by_status ON orders (o_orderstatus, o_totalprice DESC);
CREATE INDEX ON orders (o_totalprice) INCLUDE (o_orderpriority);
CREATE VIEW dear AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $1 AND o_totalprice > 1000 ORDER BY o_totalprice DESC LIMIT 30;
CREATE VIEW urgent AS SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 5000 AND 90000 AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice LIMIT 40;
CREATE VIEW of_customer AS SELECT o_orderkey FROM orders WHERE o_custkey = :customer LIMIT 500;
CREATE VIEW rich AS SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC LIMIT 10;
"""


@query(f"WITH {_ORDERS} SELECT key, o_orderkey, o_totalprice FROM orders_ WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, key LIMIT 30")
def sql_view_card(spark, d):
    c = ddl.compile_sql(SCHEMA)
    return ddl.run(c.cards["dear"], load(spark, d, "orders"), c.tables["orders"], {"1": "F"})


@query(f"WITH {_ORDERS} SELECT key, o_orderkey, o_orderpriority FROM orders_ WHERE o_totalprice BETWEEN 5000 AND 90000 AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice, key LIMIT 40")
def sql_view_residual(spark, d):
    c = ddl.compile_sql(SCHEMA)
    return ddl.run(c.cards["urgent"], load(spark, d, "orders"), c.tables["orders"])


@query("""SELECT * FROM (VALUES ('dear', true, 'orders.by_status', 'orderpath driving 2 residual 0'), ('urgent', true, 'orders.o_totalprice', 'range driving 2 residual 1'),
('of_customer', true, 'orders.o_custkey', 'range driving 1 residual 0'), ('rich', false, NULL, 'CREATE INDEX ON customer (c_mktsegment, c_acctbal DESC)')) t(query, served, path, plan)""")
def sql_plan(spark, d):
    return ddl.report(spark, ddl.compile_sql(SCHEMA))


@query("SELECT * FROM (VALUES ('orders', 'orders:', 'o_orderkey', 6::BIGINT, 5::BIGINT, 2::BIGINT, 'o_ts'), ('customer', 'customer:', 'c_custkey', 5, 3, 0, NULL)) t(name, prefix, pk, columns, indexes, orderpaths, \"window\")")
def table_list(spark, d):
    r = Registry()
    for t in (ORDERS, CUSTOMERS):
        r.declare(t)
    return r.list_tables(spark)


@query("SELECT 'orders' AS \"table\", 'o_orderpriority' AS \"column\", 16::BIGINT AS refused, 'INDEX o_orderpriority range' AS declaration")
def index_advise(spark, d):
    r = Registry()
    r.declare(ORDERS)
    for _ in range(16):
        r.advise("orders", "o_orderpriority")
    return r.advice(spark)


# ---- further verbs ----


@query()
def index_explain(spark, d):
    return paths.explain(paths.scalar(orders(spark, d), ORDERS, "o_totalprice", 1000, 2000), ORDERS, "o_totalprice")


@query(f"WITH {_POSTINGS}, {_bm25(chr(39).join(['term IN (', 'license', ', ', 'version', ')']))} SELECT key, lang, score FROM sc JOIN documents ON sc.key = 'documents:' || doc_id WHERE source <> 'src1' ORDER BY lang DESC, key LIMIT 30 OFFSET 3")
def text_claused(spark, d):
    docs = _docs(spark, d)
    found = text.match_texts(docs, "license version", ("text",)).withColumn("score", F.round("score", 6))
    return text.claused(found, docs.select("key", "lang", "source"), F.col("source") != "src1", ("lang", True), limit=30, offset=3).select("key", "lang", "score")


@query(f"WITH {_POSTINGS}, {_bm25(chr(39).join(['term IN (', 'license', ')']))}, r AS (SELECT key, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS seat FROM sc JOIN documents ON sc.key = 'documents:' || doc_id) SELECT key, source, score FROM r WHERE seat = 1 ORDER BY score DESC, key LIMIT 10")
def text_distinct(spark, d):
    docs = _docs(spark, d)
    found = text.match_texts(docs, "license", ("text",)).withColumn("score", F.round("score", 6))
    return text.claused(found, docs.select("key", "source"), distinct="source").select("key", "source", "score")


@query(f"WITH {_ZSET}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member, score FROM r WHERE NOT r BETWEEN 3 AND n - 4")
def zset_remove_ranks(spark, d):
    return zsets.without_ranks(_zset(spark, d), 3, -4)


@query(f"WITH {_ZSET} SELECT key, member, score FROM z WHERE NOT (score >= 60000 AND score < 200000)")
def zset_remove_scores(spark, d):
    return zsets.without_scores(_zset(spark, d), 60000, "(200000")


@query(f"WITH {_ZSET} SELECT count(*) FILTER (z.score < m.score OR (z.score = m.score AND z.member < m.member)) AS rank FROM z, (SELECT * FROM z WHERE key = 'O' AND member = (SELECT min(member) FROM z WHERE key = 'O')) m WHERE z.key = 'O'")
def zset_rank_of(spark, d):
    z = _zset(spark, d)
    return zsets.rank_of(z, "O", z.where("key = 'O'").agg(F.min("member")).first()[0])


@query(f"WITH {_LISTS} SELECT key, CAST(coalesce(list_position(items, 'click'), 0) - 1 AS INTEGER) AS at FROM l WHERE list_contains(items, 'click')")
def list_positions(spark, d):
    return lists.positions(_lists(spark, d), "click").where(F.size("positions") > 0).select("key", F.get("positions", 0).alias("at"))


@query(f"WITH {_LISTS} SELECT key, array_to_string(['x'] || items[3:], ',') AS items FROM l WHERE len(items) > 2 UNION ALL SELECT key, 'x' FROM l WHERE 1 = 0")
def list_push_pop(spark, d):
    return lists.push(lists.pop(_lists(spark, d), 2)[1], ["x"], left=True).withColumn("items", F.array_join("items", ","))


@query("SELECT 'customer:' || c_custkey AS key, CAST(CASE WHEN c_custkey % 2 = 0 THEN 400 ELSE -1 END AS BIGINT) AS visits, -2::BIGINT AS missing FROM customer")
def hash_ttl(spark, d):
    h = _hash(spark, d)
    even = F.pmod(F.split_part("key", F.lit(":"), F.lit(2)).cast("long"), F.lit(2)) == 0
    both = hashes.expire(h.where(even), 1000, ("visits",)).unionByName(hashes.persist(hashes.expire(h.where(~even), 1000, ("visits",)), ("visits",)))
    return hashes.ttl(both, 600, "visits", "missing")


@query(f"WITH {_STREAM}, m AS (SELECT min(ms) AS lo FROM s) SELECT ms, seq, event_id FROM s, m WHERE ms > lo OR (ms = lo AND seq > 0) ORDER BY ms, seq LIMIT 40")
def stream_read(spark, d):
    s = _stream(spark, d)
    return entries.read(s, f"{s.agg(F.min('ms')).first()[0]}-0", 40).select("ms", "seq", "event_id")


@query(f"WITH {_STREAM}, t AS (SELECT max(ms) AS now FROM s) SELECT 'c' || user_id % 4 AS consumer, ms, seq, now - ms AS idle FROM s, t WHERE event_id % 3 = 0 AND user_id % 4 = 2 AND now - ms >= 5000 ORDER BY ms, seq LIMIT 25")
def group_idle(spark, d):
    now = _stream(spark, d).agg(F.max("ms")).first()[0]
    return entries.idle(entries.pending(_log(spark, d)), now, 5000, count=25, consumer="c2").select("consumer", "ms", "seq", "idle")


@query("SELECT count(*) AS n FROM events WHERE event_id % 5 = 0")
def stream_delete(spark, d):
    s = _stream(spark, d)
    return entries.delete(s, s.where("event_id % 5 <> 0")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS member FROM events WHERE user_id % 3 <> 0")
def set_remove(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), "user_id")
    return sets.remove(sets.add(e.where("user_id % 2 = 0").select("key", "member").distinct(), e), e.where("user_id % 3 = 0").select("key", "member").distinct())


@query(f"WITH {_PLACES} SELECT member FROM p WHERE 2 * 6372797.560856::DOUBLE * asin(sqrt(sin(radians(lat - 10) / 2) ** 2)) <= 1000000 AND 2 * 6372797.560856::DOUBLE * asin(sqrt(cos(radians(lat)) ** 2 * sin(radians(lon - 20) / 2) ** 2)) <= 2000000")
def geo_box(spark, d):
    return geo.search(_places(spark, d), 20.0, 10.0, box=(4000, 2000), unit="km").select("member")


_FIRST_1000 = "f AS (SELECT *, row_number() OVER (ORDER BY ms, seq) AS r FROM s)"


def _short_log(spark: SparkSession, d: str, actions: list[tuple]) -> DataFrame:
    return spark.createDataFrame(actions, "grp string, action string, ms long, seq long, consumer string, at long, no long")


@query(f"WITH {_STREAM}, {_FIRST_1000} SELECT 'alice' AS consumer, ms, seq FROM f WHERE r <= 300 UNION ALL SELECT 'carol', ms, seq FROM f WHERE r > 500 AND r <= 700")
def group_read(spark, d):
    """Three reads of a new group, the second without pending entries: no entry comes twice."""
    s = _stream(spark, d)
    log = entries.create_group(_short_log(spark, d, []), "g", "0", 1)
    for k, (consumer, n) in enumerate((("alice", 300), ("bob", 200), ("carol", 200))):
        _, log = entries.read_group(s, log, "g", n, consumer, 2 + k, noack=consumer == "bob")
    return entries.pending(log).select("consumer", "ms", "seq")


@query(f"WITH {_STREAM}, {_FIRST_1000} SELECT ms, seq, event_id FROM f WHERE r <= 50 AND event_id % 4 <> 0 ORDER BY ms, seq LIMIT 20")
def group_replay(spark, d):
    """What a consumer has read and not settled, acks in the millisecond of the delivery included."""
    s = _stream(spark, d)
    got, log = entries.read_group(s, _short_log(spark, d, []), "g", 50, "alice", 5)
    log = entries.ack(log, "g", got.where("event_id % 4 = 0"), 5)
    return entries.replay(s, log, "g", "alice", count=20).select("ms", "seq", "event_id")


@query(f"WITH {_STREAM}, {_FIRST_1000} SELECT CASE WHEN event_id % 3 = 0 THEN 'bob' ELSE 'alice' END AS consumer, count(*) AS pending, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 90 END::BIGINT AS idle FROM f WHERE r <= 100 GROUP BY 1, 3")
def group_claim(spark, d):
    """Entries claimed by id; each consumer's pending entries and idle time."""
    s = _stream(spark, d)
    got, log = entries.read_group(s, _short_log(spark, d, []), "g", 100, "alice", 10)
    log = entries.claim(log, "g", "bob", got.where("event_id % 3 = 0"), 100, least=50)
    return entries.consumers(log, 100).select("consumer", "pending", "idle")


@query(f"WITH {_STREAM}, {_FIRST_1000} SELECT ms, seq FROM f WHERE r > 5 AND r <= 15")
def group_cursor(spark, d):
    """A group that is set back reads again from there; a deleted consumer leaves nothing pending."""
    s = _stream(spark, d)
    got, log = entries.read_group(s, _short_log(spark, d, []), "g", 40, "alice", 10)
    fifth = got.orderBy("ms", "seq").limit(5).collect()[-1]
    _, log = entries.delete_consumer(log, "g", "alice", 11)
    log = entries.set_cursor(log, "g", f"{fifth.ms}-{fifth.seq}", 12)
    return entries.pending(entries.read_group(s, log, "g", 10, "bob", 13)[1]).select("ms", "seq")


@query(f"WITH {_KEYSPACE} SELECT key FROM ks WHERE starts_with(key, 'orders:') ORDER BY key LIMIT 60")
def keys_scan_pages(spark, d):
    """A walk by cursor: two pages of forty and twenty keys."""
    ks = _keyspace(spark, d).where(F.col("key").startswith("orders:"))
    first, at = keys.scan_page(ks, None, 40)
    return first.unionByName(keys.scan_page(ks, at, 20)[0]).select("key")


@query(f"WITH {_KEYSPACE} SELECT 'customer:copy' AS key, value FROM ks WHERE key = 'customer:5' UNION ALL SELECT key, CASE WHEN key = 'customer:1' THEN 'new' ELSE value END FROM ks WHERE starts_with(key, 'customer:') AND key <> 'customer:2'")
def strings_getset_copy(spark, d):
    ks = _keyspace(spark, d).where(F.col("key").startswith("customer:")).select("key", "value", "expire_at")
    _, ks = keys.get_set(ks, "customer:1", "new")
    _, ks = keys.get_del(ks, "customer:2")
    return keys.copy(ks, "customer:5", "customer:copy").select("key", "value")


@query(f"WITH {_KEYSPACE} SELECT key, value || CASE WHEN key = 'customer:3' THEN '!' ELSE '' END AS value FROM ks WHERE starts_with(key, 'customer:')")
def strings_append(spark, d):
    return keys.append(_keyspace(spark, d).where(F.col("key").startswith("customer:")).select("key", "value"), "customer:3", "!")


@query("SELECT 'customer:' || c_custkey AS key, c_acctbal + 0.5::DOUBLE AS value FROM customer")
def strings_incr_float(spark, d):
    c = load(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    return keys.incr_float(c, c.select("key", F.lit(0.5).alias("delta"))).select("key", F.col("value").cast("double").alias("value"))


@query(f"WITH {_ZSET} SELECT member, score FROM z WHERE key = 'F' AND starts_with(member, '1')")
def zset_scan(spark, d):
    return zsets.scan(_zset(spark, d), "F", "1*")


@query(f"WITH {_ZSET}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM z) SELECT key, member, score FROM r WHERE r > 7 OR score >= 120000")
def zpop_rest(spark, d):
    return zsets.pop_min(_zset(spark, d), 7, below=120000)[1].select("key", "member", "score")


@query(f"WITH {_ZSET} SELECT 'zset' AS type, key, member AS item, score FROM z UNION ALL SELECT 'set', event_type, CAST(user_id AS VARCHAR), NULL FROM (SELECT DISTINCT event_type, user_id FROM events) UNION ALL SELECT 'string', 'customer:' || c_custkey, c_name, 7 FROM customer UNION ALL SELECT 'list', 'n:' || n_regionkey, string_agg(n_name, ',' ORDER BY n_name), NULL FROM nation GROUP BY n_regionkey")
def dump_load_all(spark, d):
    """Strings, lists, sets and sorted sets as command lines and back."""
    c = load(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"), F.lit(7).cast("long").alias("expire_at"))
    n = load(spark, d, "nation").groupBy(F.concat(F.lit("n:"), F.col("n_regionkey")).alias("key")).agg(F.sort_array(F.collect_list("n_name")).alias("items"))
    e = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"))
    lines = sources.dump_strings(c).unionByName(sources.dump_lists(n)).unionByName(sources.dump_sets(e)).unionByName(sources.dump_zsets(_zset(spark, d)))
    back = sources.load_all(lines)
    row = lambda kind, item, score: back[kind].select(F.lit(kind).alias("type"), "key", item.alias("item"), score.cast("double").alias("score"))
    none = F.lit(None)
    return row("zset", F.col("member"), F.col("score")).unionByName(row("set", F.col("member"), none)).unionByName(row("string", F.col("value"), F.col("expire_at"))).unionByName(row("list", F.array_join("items", ","), none))
