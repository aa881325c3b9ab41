"""Hashes as (key, fields map<string,string>[, deadlines map<string,bigint>]) frames; times are in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused

_NONE = "map<string,bigint>"


def get(df: DataFrame, *fields: str) -> DataFrame:
    return df.select("key", *[F.element_at("fields", f).alias(f) for f in fields])


def exists(df: DataFrame, field: str) -> DataFrame:
    return df.select("key", F.map_contains_key("fields", field).alias("found"))


def length(df: DataFrame) -> DataFrame:
    return df.select("key", F.size("fields").cast("long").alias("n"))


def keys(df: DataFrame) -> DataFrame:
    return df.select("key", F.sort_array(F.map_keys("fields")).alias("names"))


def values(df: DataFrame) -> DataFrame:
    """In order of the field names."""
    return df.select("key", F.transform(F.sort_array(F.map_entries("fields")), lambda e: e["value"]).alias("values"))


def entries(df: DataFrame, pattern: str = "*") -> DataFrame:
    """(key, field, value), as HGETALL and HSCAN give them."""
    from lodestone.operators.keys import like

    return df.select("key", F.explode("fields").alias("field", "value")).where(like(F.col("field"), pattern))


def set_(df: DataFrame, new: DataFrame, nx: bool = False) -> DataFrame:
    """Upsert a frame of (key, fields); nx keeps what is there. Setting a field clears its deadline."""
    both = df.withColumnRenamed("fields", "old").join(new.select("key", F.col("fields").alias("new")), "key", "full")
    empty = F.create_map().cast("map<string,string>")
    old, fresh = F.coalesce("old", empty), F.coalesce("new", empty)
    over, under = (old, fresh) if nx else (fresh, old)
    out = F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)
    rest = [c for c in df.columns if c not in ("key", "fields")]
    kept = [F.map_filter(c, lambda k, v: F.lit(True) if nx else ~F.map_contains_key(fresh, k)).alias(c) if c == "deadlines" else F.col(c) for c in rest]
    return both.select("key", out.alias("fields"), *kept)


def delete(df: DataFrame, *fields: str) -> DataFrame:
    """A hash without a field left is gone."""
    return df.withColumn("fields", F.map_filter("fields", lambda k, v: ~k.isin(*fields))).where(F.size("fields") > 0)


def increment(df: DataFrame, field: str, by: int | float) -> DataFrame:
    """A missing field counts from 0; an integer out of range, or a text that is no number, is an error."""
    kind = "long" if isinstance(by, int) else "double"
    new = F.coalesce(F.element_at("fields", field).cast(kind), F.lit(0).cast(kind)) + F.lit(by)
    return df.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, v: k != field), F.create_map(F.lit(field), new.cast("string"))))


def _deadlines(df: DataFrame) -> Column:
    return F.coalesce("deadlines", F.create_map().cast(_NONE)) if "deadlines" in df.columns else F.create_map().cast(_NONE)


def expire(df: DataFrame, at: int, fields: tuple[str, ...], only: str = "") -> DataFrame:
    """Set deadlines; NX: only without one, XX: only with one, GT or LT: only later or earlier (none counts as never)."""
    if only not in ("", "NX", "XX", "GT", "LT"):
        raise Refused(f"HEXPIRE {only}")
    old = _deadlines(df)

    def sets(f: str) -> Column:
        had = F.element_at(old, f)
        return F.map_contains_key("fields", f) & {"": F.lit(True), "NX": had.isNull(), "XX": had.isNotNull(), "GT": F.coalesce(F.lit(at) > had, F.lit(False)), "LT": F.coalesce(F.lit(at) < had, F.lit(True))}[only]

    new = F.map_from_entries(F.filter(F.array(*[F.when(sets(f), F.struct(F.lit(f).alias("key"), F.lit(at).cast("long").alias("value"))) for f in fields]), lambda x: x.isNotNull()))
    return df.withColumn("deadlines", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))


def persist(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return df.withColumn("deadlines", F.map_filter(_deadlines(df), lambda k, v: ~k.isin(*fields)))


def ttl(df: DataFrame, now: int, *fields: str) -> DataFrame:
    """Milliseconds left: -1 without a deadline, -2 without the field."""
    d = _deadlines(df)
    return df.select("key", *[F.when(~F.map_contains_key("fields", f), -2).when(F.element_at(d, f).isNull(), -1).otherwise(F.element_at(d, f) - now).cast("long").alias(f) for f in fields])


def live(df: DataFrame, now: int) -> DataFrame:
    """Without the fields whose deadline has passed, and without hashes that lose all fields so."""
    d = _deadlines(df)
    return df.withColumn("fields", F.map_filter("fields", lambda k, v: F.coalesce(F.element_at(d, k) > now, F.lit(True)))).where(F.size("fields") > 0)
