"""Audits: index and table verification, duplicates, digests, plan and migration checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import Index, OrderPath, Table
from lodestone.operators import paths


def verify_table(df: DataFrame, table: Table) -> DataFrame:
    """(path, rows, entries, absent, coerce_failures) of each declared path, in one pass over the table.

    absent: a column is missing; coerce_failures: nothing is missing but a value does not coerce, or a text is too
    long for an order path.
    """
    each: list[Index | OrderPath] = [*table.indexes, *table.paths]
    counts = []
    for i, p in enumerate(each):
        columns = p.columns if isinstance(p, OrderPath) else (*p.fields, *([p.group] if p.group else []))
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        good = paths.on_path(df, table, p) if isinstance(p, OrderPath) else reduce(lambda a, b: a & b, [F.col(c).isNotNull() if table.type_of(c) == "vector" else paths.value(df, table, c).isNotNull() for c in columns])
        counts += [F.count_if(good).alias(f"e{i}"), F.count_if(missing).alias(f"a{i}"), F.count_if(~missing & ~good).alias(f"c{i}")]
    if not each:
        return df.sparkSession.createDataFrame([], "path string, rows long, entries long, absent long, coerce_failures long")
    one = df.agg(F.count("*").alias("rows"), *counts)
    lines = F.explode(F.array(*[F.struct(F.lit(p.name).alias("path"), F.col("rows"), F.col(f"e{i}").alias("entries"), F.col(f"a{i}").alias("absent"), F.col(f"c{i}").alias("coerce_failures")) for i, p in enumerate(each)]))
    return one.select(lines.alias("l")).select("l.*")


def duplicates(df: DataFrame, table: Table, index: str) -> DataFrame:
    """Values that two rows or more hold; a unique index reports them and enforces nothing."""
    v = paths.value(df, table, table.index(index).fields[0])
    return df.select(v.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).where("n > 1")


def verify_stored(df: DataFrame, stored: DataFrame, table: Table, index: str) -> DataFrame:
    """A stored copy (key, value) of an index against the table: missing, stale and wrong entries."""
    v = paths.value(df, table, table.index(index).fields[0])
    now = paths.keyed(df, table).select("key", v.alias("now")).where("now is not null")
    both = now.join(stored.select("key", F.col("value").alias("then")), "key", "full")
    return both.agg(F.count("now").alias("checked"), F.count_if(F.col("then").isNull()).alias("missing"), F.count_if(F.col("now").isNull()).alias("stale"), F.count_if(F.col("now") != F.col("then")).alias("drift"))


def spot_check(df: DataFrame, stored: DataFrame, table: Table, index: str, n: int = 64) -> DataFrame:
    """Up to n rows (the feature's limit) with the smallest hashes of their keys, their value and the stored one: (key, value, stored, same)."""
    v = paths.value(df, table, table.index(index).fields[0])
    picked = paths.keyed(df, table).select("key", v.alias("value")).where("value is not null").orderBy(F.xxhash64("key"), "key").limit(n)
    both = stored.select("key", F.col("value").alias("stored")).join(F.broadcast(picked), "key", "right")
    return both.select("key", "value", "stored", F.col("value").eqNullSafe(F.col("stored")).alias("same"))


def window_parts(df: DataFrame, table: Table) -> DataFrame:
    """Buckets of a table's WINDOW: (bucket, rows, hot). A bucket is hot if it begins within `span` of the newest."""
    w = table.window
    v = paths.value(df, table, w.column)
    parts = df.select(F.floor(v / w.bucket).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("rows"))
    newest = F.max("bucket").over(Window.partitionBy())
    return parts.withColumn("hot", F.col("bucket") > newest - F.lit(-(-w.span // w.bucket)))


def shadow(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Compare two answers to one query: rows missing, extra, changed, and (with a position column) out of order."""
    a = old.select(F.col(key).alias("k"), F.xxhash64(*[c for c in old.columns if c != order]).alias("h_old"), *([F.col(order).alias("p_old")] if order else [F.lit(None).alias("p_old")]))
    b = new.select(F.col(key).alias("k"), F.xxhash64(*[c for c in new.columns if c != order]).alias("h_new"), *([F.col(order).alias("p_new")] if order else [F.lit(None).alias("p_new")]))
    both = a.join(b, "k", "full")
    return both.agg(F.count_if(F.col("h_new").isNull()).alias("missing"), F.count_if(F.col("h_old").isNull()).alias("extra"), F.count_if(F.col("h_old") != F.col("h_new")).alias("changed"), F.count_if(F.col("p_old") != F.col("p_new")).alias("moved"))


def overlap(owners: DataFrame) -> DataFrame:
    """(owner, name) -> names that several owners share."""
    return owners.distinct().groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("owner")), ",").alias("owners")).where("n > 1")


def equal_columns(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of columns that agree in a share of rows of at least `least`, all pairs in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    lines = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col(f"s{i}") / F.col("rows")).alias("share")) for i, (a, b) in enumerate(pairs)]))
    return one.select(lines.alias("l")).select("l.*").where(F.col("share") >= least)


def sources_of(inputs: dict[str, DataFrame]) -> DataFrame:
    """Union of key sources: each key with the names of the sources that have it."""
    each = [d.select("key", F.lit(n).alias("source")) for n, d in inputs.items()]
    return reduce(DataFrame.union, each).distinct().groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


def doctor(report: DataFrame) -> int:
    """0 if a verify_table() report is clean, 1 if rows are excluded by coercion."""
    return int((report.agg(F.sum("coerce_failures")).first()[0] or 0) > 0)
