"""Views: trees of index conditions, their order, top-k and dereference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import Leaf, Node, Table, View
from lodestone.errors import Refused
from lodestone.operators import paths

#: Most bytes of a dereference target that are broadcast, counted row by row.
BROADCAST_BYTES = 8 << 20


def condition(df: DataFrame, table: Table, tree: Leaf | Node) -> Column:
    """The tree as one predicate; a row that a leaf's index lacks is outside that leaf."""
    if isinstance(tree, Leaf):
        path = table.index(tree.index)
        return F.coalesce(paths._test(df, table, path.fields[0], tree.low, tree.high, None), F.lit(False))
    left, right = condition(df, table, tree.left), condition(df, table, tree.right)
    return {"AND": left & right, "OR": left | right, "DIFF": left & ~right}[tree.op]


def members(df: DataFrame, table: Table, view: View) -> DataFrame:
    """All members with `key` and `order_value`; a row without an order value is left out."""
    path = table.index(view.order)
    order = paths.value(df, table, path.fields[0] if hasattr(path, "fields") else path.columns[0])
    return paths.keyed(df.where(condition(df, table, view.tree)), table).withColumn("order_value", order).where(F.col("order_value").isNotNull())


def _order(view: View) -> list[Column]:
    v, k = F.col("order_value"), F.col("key")
    return [v.desc(), k.desc()] if view.desc else [v.asc(), k.asc()]


def materialise(df: DataFrame, table: Table, view: View, path: str) -> None:
    """Write the view's members (the first TOPK of them) as Parquet in view order; again whenever the table has changed (REBUILD).

    Files follow the order, so a page reads the row groups that its bounds touch.
    """
    if not view.materialized:
        raise Refused(f"{view.name} is not MATERIALIZED")
    rows = members(df, table, view)
    (rows.orderBy(*_order(view)).limit(view.topk) if view.topk else rows.orderBy(*_order(view))).write.mode("overwrite").parquet(path)


def query(df: DataFrame, table: Table, view: View, limit: int = paths.LIMIT, cursor: tuple[object, str] | None = None, fields: tuple[str, ...] = (), stored: str | None = None) -> DataFrame:
    """A page of the view, computed, or read where materialise() has stored it. Descending order turns the (value, key) pair round, the key too."""
    limit, _ = paths.limits(limit)
    v, k = F.col("order_value"), F.col("key")
    order = _order(view)
    if stored is not None:
        rows = df.sparkSession.read.parquet(stored)
    else:
        rows = members(df, table, view)
        if view.topk:
            rows = rows.orderBy(*order).limit(view.topk)
    if cursor:
        after = v < cursor[0] if view.desc else v > cursor[0]
        rows = rows.where(after | ((v == cursor[0]) & (k < cursor[1] if view.desc else k > cursor[1])))
    rows = rows.orderBy(*order).limit(limit)
    return rows.select("key", *fields) if fields else rows


def template(text: str, key: Column) -> Column:
    """A VIA template, in which {key} is the member's key and {key.N} its N-th part between colons, as an expression."""
    parts = re.split(r"(\{key(?:\.\d+)?\})", text)
    if "{" in "".join(parts[::2]) or "}" in "".join(parts[::2]):
        raise Refused(f"VIA {text}: only {{key}} and {{key.N}} are known")
    pick = lambda p: key if p == "{key}" else F.coalesce(F.get(F.split(key, ":"), int(p[5:-1])), F.lit(""))
    return F.concat(*[pick(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def via(rows: DataFrame, target: DataFrame, text: str | Column, fields: tuple[str, ...], key: str = "key") -> DataFrame:
    """Left lookup of each member's target row by key; a missing target gives nulls, a member is never lost.

    `target` has a unique column `key`. It is broadcast only if its rows sum up to BROADCAST_BYTES at most.
    """
    wanted = target.select(F.col("key").alias("_target"), *[F.col(f).alias(f"via_{f}") for f in fields])
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wanted.columns), F.lit(64))
    if (wanted.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    at = template(text, F.col(key)) if isinstance(text, str) else text
    return rows.join(wanted, at == F.col("_target"), "left").drop("_target")


def explain(df: DataFrame, table: Table, view: View) -> DataFrame:
    """Rows of each leaf, in the tree's order, and of the whole, in one pass."""
    leaves: list[Leaf] = []

    def walk(t):
        leaves.append(t) if isinstance(t, Leaf) else (walk(t.left), walk(t.right))

    walk(view.tree)
    counts = [F.count_if(condition(df, table, x)).alias(f"leaf_{i}") for i, x in enumerate(leaves)]
    return df.agg(*counts, F.count_if(condition(df, table, view.tree)).alias("members"))


def verify(df: DataFrame, table: Table, view: View) -> DataFrame:
    """Members, and how many the order leaves out."""
    path = table.index(view.order)
    order = paths.value(df, table, path.fields[0])
    inside = condition(df, table, view.tree)
    return df.agg(F.count_if(inside & order.isNotNull()).alias("members"), F.count_if(inside & order.isNull()).alias("order_excluded"))
