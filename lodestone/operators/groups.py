"""Grouped aggregates: count, sum, min, max and average of one measure by one group field, and ranked groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import Table
from lodestone.errors import Refused
from lodestone.operators import paths

LIMIT, MOST_LIMIT = 100, 1000
METRICS = {"count": ("n", True), "sum": ("total", True), "max": ("high", True), "min": ("low", False)}


def _input(df: DataFrame, table: Table, index: str) -> DataFrame:
    path = table.index(index)
    if getattr(path, "kind", "") != "agg":
        raise Refused(f"{index} is not KIND agg")
    if table.type_of(path.fields[0]) not in ("i64", "f64"):
        raise Refused("KIND agg measures an i64 or f64 field")
    # sums are doubles even of integers; a row that lacks either field is out
    return df.select(paths.value(df, table, path.group).alias("grp"), paths.value(df, table, path.fields[0]).cast("double").alias("m")).where("grp is not null and m is not null")


def _totals() -> list:
    return [F.count("m").alias("n"), F.sum("m").alias("total"), F.min("m").alias("low"), F.max("m").alias("high"), F.avg("m").alias("mean")]


def group(df: DataFrame, table: Table, index: str, name) -> DataFrame:
    """One row for one group; an unknown group has n = 0 and nulls."""
    return _input(df, table, index).where(F.col("grp") == name).agg(*_totals())


def groups(df: DataFrame, table: Table, index: str, by: str = "count", limit: int = LIMIT) -> DataFrame:
    """The first `limit` groups by a metric (count, sum and max descending, min ascending), ties by group."""
    if by not in METRICS:
        raise Refused(f"GROUPS BY {by}")
    column, desc = METRICS[by]
    order = F.col(column).desc() if desc else F.col(column).asc()
    return _input(df, table, index).groupBy("grp").agg(*_totals()).orderBy(order, "grp").limit(max(1, min(limit, MOST_LIMIT)))


def excluded(df: DataFrame, table: Table, index: str) -> DataFrame:
    """Rows that the aggregate leaves out, since a field is missing or does not coerce."""
    path = table.index(index)
    g, m = paths.value(df, table, path.group), paths.value(df, table, path.fields[0])
    return df.agg(F.count_if(g.isNull() | m.isNull()).alias("excluded"), F.count("*").alias("rows"))
