"""Range, equality and composite-path queries with their clauses, as DataFrame plans.

Every result is totally ordered: by the driving value, or what SORT names, then by the row key.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import PATH_BYTES, Index, OrderPath, Table
from lodestone.errors import Refused
from lodestone.functions.coerce import bound, coerced

LIMIT, MOST_LIMIT, MOST_OFFSET = 100, 10_000, 10_000


@dataclass(frozen=True)
class Filter:
    """FILTER field RANGE low high, or EQ low where high is not given."""

    field: str
    low: object
    high: object = None


def keyed(df: DataFrame, table: Table) -> DataFrame:
    """df with `key`, the prefix and the primary key."""
    return df.withColumn("key", F.concat(F.lit(table.prefix), F.col(table.pk).cast("string")))


def value(df: DataFrame, table: Table, column: str) -> Column:
    """A column as its declared type; null where missing or not coercible."""
    return coerced(F.col(column), table.type_of(column), dict(df.dtypes)[column])


def _test(df: DataFrame, table: Table, column: str, low, high, now, swap: bool = False) -> Column:
    kind = table.type_of(column)
    low = bound(low, kind, now)
    high = low if high is None else bound(high, kind, now)
    if swap and low > high:
        low, high = high, low
    source = dict(df.dtypes)[column]
    # a bare column reaches the Parquet filters; NaN is above every upper bound, so it needs no test of its own
    plain = source in {"i64": ("int", "bigint", "smallint", "tinyint"), "f64": ("double",), "str": ("string",)}[kind]
    col = F.col(column) if plain else value(df, table, column)
    return col == low if low == high else (col >= low) & (col <= high)


def limits(limit: int = LIMIT, offset: int = 0, most: int = MOST_LIMIT) -> tuple[int, int]:
    if offset < 0 or offset > MOST_OFFSET:
        raise Refused(f"OFFSET is 0..{MOST_OFFSET}")
    return max(1, min(limit, most)), offset


def scalar(df: DataFrame, table: Table, index: str, low, high=None, filters: tuple[Filter, ...] = (), now: dt.datetime | None = None) -> DataFrame:
    """Rows of an index whose value lies in [low, high] (high None: equals low), after the filters, with `key`."""
    path = table.index(index)
    if not isinstance(path, Index) or path.kind not in ("range", "unique"):
        raise Refused(f"{index} does not answer RANGE or EQ")
    stored = dict(path.values)
    if wrong := next((f.field for f in filters if f.field not in stored and f.field not in path.fields), None):
        raise Refused(f"FILTER {wrong}: not among VALUES of {index}")
    tests = [_test(df, table, path.fields[0], low, high, now), *(_test(df, table, f.field, f.low, f.high, now) for f in filters)]
    return keyed(df.where(reduce(Column.__and__, tests)), table)


def composite(df: DataFrame, table: Table, index: str, equals: tuple[tuple[str, object], ...], span: tuple[str, object, object] | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Rows of an order path whose leading columns equal `equals`, and the next one lies in `span`.

    A row with a missing column, or a text of over 255 bytes, is not on the path. Ends of the span come in any order.
    """
    path = table.index(index)
    if not isinstance(path, OrderPath):
        raise Refused(f"{index} is no ORDERPATH")
    named = [c for c, _ in equals] + ([span[0]] if span else [])
    if tuple(named) != path.columns[: len(named)]:
        raise Refused(f"WHERE must name leading columns of {index}: {', '.join(path.columns)}")
    tests = [_test(df, table, c, v, None, now) for c, v in equals]
    if span:
        tests.append(_test(df, table, *span, now, swap=True))
    return keyed(df.where(reduce(Column.__and__, tests, F.lit(True))), table).where(on_path(df, table, path))


def on_path(df: DataFrame, table: Table, path: OrderPath) -> Column:
    tests = [value(df, table, c).isNotNull() & ((F.octet_length(F.col(c).cast("string")) <= PATH_BYTES) if table.type_of(c) == "str" else F.lit(True)) for c in path.columns]
    return reduce(Column.__and__, tests)


def ordering(df: DataFrame, table: Table, index: str) -> list[Column]:
    """Driving order of an index or order path, ending in the key."""
    path = table.index(index)
    columns, desc = (path.columns, path.desc) if isinstance(path, OrderPath) else (path.fields[:1], (False,))
    return [*(value(df, table, c).desc() if d else value(df, table, c).asc() for c, d in zip(columns, desc, strict=True)), F.col("key").asc()]


def page(rows: DataFrame, table: Table, index: str, limit: int = LIMIT, offset: int = 0, sort: tuple[str, bool] | None = None, distinct: str | None = None, cursor: tuple[object, str] | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """One page of a matched set.

    sort: (column, descending); a missing value comes last either way, ties by key. distinct: at most one row per
    value, the first in page order; a missing value never collapses. cursor: (value, key) of the last row seen.
    """
    if cursor and (sort or distinct or offset):
        raise Refused("CURSOR does not go with SORT, DISTINCT or OFFSET")
    path = table.index(index)
    limit, offset = limits(limit, offset)
    stored = {c for c, _ in getattr(path, "values", ())} | set(getattr(path, "fields", ())) | set(getattr(path, "columns", ()))
    for clause, c in (("SORT", sort and sort[0]), ("DISTINCT", distinct)):
        if c and c not in stored:
            raise Refused(f"{clause} {c}: not among VALUES of {index}")
    order = ordering(rows, table, index)
    if sort:
        v = value(rows, table, sort[0])
        order = [v.desc_nulls_last() if sort[1] else v.asc_nulls_last(), F.col("key").asc()]
    if cursor:
        v = value(rows, table, path.fields[0])
        rows = rows.where((v > cursor[0]) | ((v == cursor[0]) & (F.col("key") > cursor[1])))
    if distinct:
        v = value(rows, table, distinct)
        # rows without a value stand for themselves: they are partitions of their own
        ranked = rows.withColumn("_seat", F.row_number().over(Window.partitionBy(v, F.when(v.isNull(), F.col("key"))).orderBy(*order)))
        rows = ranked.where(F.col("_seat") == 1).drop("_seat")
    rows = rows.orderBy(*order)
    rows = rows.offset(offset).limit(limit) if offset else rows.limit(limit)
    return rows.select("key", *fields) if fields else rows


def facets(rows: DataFrame, table: Table, fields: tuple[str, ...]) -> DataFrame:
    """(field, value, n) over the whole matched set, one pass for all fields; rows without a value count nowhere."""
    labels = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(rows, table, f).cast("string").alias("value")) for f in fields]))
    counted = rows.select(labels.alias("f")).where("f.value is not null").groupBy("f.field", "f.value").agg(F.count("*").alias("n"))
    return counted.orderBy("field", F.desc("n"), "value")


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def compose(df: DataFrame, table: Table, op: str, left: tuple[str, object, object], right: tuple[str, object, object], limit: int = LIMIT, cursor: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Rows that satisfy both (AND) or either (OR) of two index conditions, in key order."""
    tests = []
    for name, low, high in (left, right):
        path = table.index(name)
        if not isinstance(path, Index) or path.kind not in ("range", "unique"):
            raise Refused(f"COMPOSE over {name}")
        tests.append(F.coalesce(_test(df, table, path.fields[0], low, high, now), F.lit(False)))
    if op not in ("AND", "OR"):
        raise Refused(f"COMPOSE {op}")
    rows = keyed(df.where(tests[0] & tests[1] if op == "AND" else tests[0] | tests[1]), table)
    if cursor is not None:
        rows = rows.where(F.col("key") > cursor)
    return rows.orderBy("key").limit(limits(limit)[0])


def explain(rows: DataFrame, table: Table, index: str) -> DataFrame:
    """(path, kind, est_rows, plan) of a matched set, from Spark's plan and statistics; nothing runs.

    est_rows is the optimiser's row count, null where the source has no statistics.
    """
    path = table.index(index)
    plan = rows._jdf.queryExecution()
    rows_known = plan.optimizedPlan().stats().rowCount()
    est = int(str(rows_known.get())) if rows_known.isDefined() else None
    pushed = [x.strip() for x in plan.executedPlan().toString().splitlines() if "PushedFilters" in x]
    line = pushed[0][pushed[0].index("PushedFilters") :].split("ReadSchema")[0].rstrip(", ") if pushed else "no filter reaches the scan"
    return rows.sparkSession.createDataFrame([(f"{table.name}.{path.name}", getattr(path, "kind", "orderpath"), est, line)], "path string, kind string, est_rows long, plan string")
