"""The keyspace as a frame (key, type, value..[, expire_at]); expire_at in milliseconds, null for never.

Also plain strings, (key, value[, expire_at]), and prefix statistics and digests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused


def glob(pattern: str) -> str:
    r"""A glob (* ? [a-c] [^x] \x) as a Java regular expression for whole strings."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(r"[\s\S]*")
        elif c == "?":
            out.append(r"[\s\S]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] == "^" else "") + re.sub(r"([\[\]&^\\])", r"\\\1", body.lstrip("^")) + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"


def like(col: Column, pattern: str) -> Column:
    """A glob test; a plain prefix stays a prefix test, which reaches the Parquet filters."""
    if pattern == "*":
        return F.lit(True)
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return col.startswith(pattern[:-1])
    return col.rlike(glob(pattern))


def scan(df: DataFrame, pattern: str = "*", kind: str | None = None) -> DataFrame:
    rows = df.where(like(F.col("key"), pattern))
    return rows.where(F.col("type") == kind) if kind else rows


def scan_page(df: DataFrame, cursor: str | None = None, count: int = 10, pattern: str = "*", kind: str | None = None) -> tuple[DataFrame, str | None]:
    """(page, next cursor): the `count` keys after the cursor, of which those that match stay; a None cursor ends the walk.

    Keys come in order, so that every key there throughout the walk is seen exactly once.
    """
    ahead = df if cursor is None else df.where(F.col("key") > cursor)
    window = ahead.orderBy("key").limit(max(1, count))
    seen = window.agg(F.count("*").alias("n"), F.max("key").alias("last")).first()
    return scan(window, pattern, kind), seen.last if seen.n == max(1, count) else None


def random_key(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1).select("key")


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def live(df: DataFrame, now: int) -> DataFrame:
    return df.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def delete(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(~F.col("key").isin(*keys))


def exists(df: DataFrame, keys: list[str]) -> DataFrame:
    """A key named twice counts twice."""
    asked = df.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return df.join(F.broadcast(asked), "key").agg(F.count("*").alias("n"))


def expire(df: DataFrame, at: int | None, *keys: str) -> DataFrame:
    """Set the deadline of keys; None takes it away."""
    return df.withColumn("expire_at", F.when(F.col("key").isin(*keys), F.lit(at).cast("long")).otherwise(F.col("expire_at")))


def ttl(df: DataFrame, now: int, keys: list[str]) -> DataFrame:
    """Milliseconds left: -1 without a deadline, -2 without the key."""
    asked = df.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    found = live(df, now).select("key", "expire_at", F.lit(True).alias("_there"))
    left = F.when(F.col("_there").isNull(), -2).when(F.col("expire_at").isNull(), -1).otherwise(F.col("expire_at") - now)
    return asked.join(found, "key", "left").select("key", left.cast("long").alias("ttl"))


def rename(df: DataFrame, old: str, new: str, nx: bool = False) -> DataFrame:
    """The old key's row takes the new key; nx: only if there is none. Without the old key nothing changes."""
    have = {r.key for r in df.where(F.col("key").isin(old, new)).select("key").distinct().collect()}
    if old not in have:
        raise Refused(f"no key {old}")
    if nx and new in have:
        return df
    return df.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


# ---- strings ----


def mget(df: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, key, value) in the asked order, null for missing keys."""
    asked = df.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
    return asked.join(df.select("key", "value"), "key", "left").select("pos", "key", "value").orderBy("pos")


def set_(df: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False) -> DataFrame:
    """Upsert (key, value[, expire_at][, seq]), the last by seq for each key; a set clears an old deadline."""
    if nx and xx:
        raise Refused("NX does not go with XX")
    order = F.col("seq") if "seq" in new.columns else F.lit(0)
    late = F.col("expire_at") if "expire_at" in new.columns else F.lit(None).cast("long")
    last = new.groupBy("key").agg(F.max_by(F.struct(F.col("value").alias("v"), late.alias("e")), order).alias("n"))
    both = df.join(last, "key", "full")
    take = F.col("n").isNotNull() & (F.col("value").isNull() if nx else F.col("value").isNotNull() if xx else F.lit(True))
    out = both.select("key", F.when(take, F.col("n.v")).otherwise(F.col("value")).alias("value"), F.when(take, F.col("n.e")).otherwise(F.col("expire_at") if "expire_at" in df.columns else F.lit(None)).cast("long").alias("expire_at"))
    return out.where(F.col("value").isNotNull())


def get_set(df: DataFrame, key: str, value: str) -> tuple[str | None, DataFrame]:
    """(old value, the frame with the new one, its deadline gone)."""
    new = df.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return _one(df, key), set_(df, new)


def get_del(df: DataFrame, key: str) -> tuple[str | None, DataFrame]:
    return _one(df, key), delete(df, key)


def get_ex(df: DataFrame, key: str, at: int | None) -> tuple[str | None, DataFrame]:
    """(value, the frame with the deadline `at`; None takes it away)."""
    return _one(df, key), expire(df, at, key)


def copy(df: DataFrame, old: str, new: str, replace: bool = False) -> DataFrame:
    """The old key's rows again under the new key, deadline included; nothing changes without the old key, or if the new one is there and replace isn't given."""
    have = {r.key for r in df.where(F.col("key").isin(old, new)).select("key").distinct().collect()}
    if old not in have or (new in have and not replace):
        return df
    return df.where(F.col("key") != new).unionByName(df.where(F.col("key") == old).withColumn("key", F.lit(new)))


def touch(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): how many of the keys there are; a key named twice counts twice."""
    return exists(df, keys)


def flush(df: DataFrame, prefix: str = "") -> DataFrame:
    """The keyspace without the keys under a prefix; without any for none."""
    return df.where(~F.col("key").startswith(prefix))


def _one(df: DataFrame, key: str) -> str | None:
    row = df.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def append(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.withColumn("value", F.when(F.col("key") == key, F.concat("value", F.lit(text))).otherwise(F.col("value")))


def incr(df: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add (key, delta) sums to whole numbers; what is out of range, or no number, is an error (ANSI)."""
    total = deltas.groupBy("key").agg(F.sum("delta").alias("d"))
    both = df.join(total, "key", "full")
    new = F.when(F.col("d").isNull(), F.col("value")).otherwise((F.coalesce(F.col("value").cast("long"), F.lit(0)) + F.col("d")).cast("string"))
    return both.select("key", new.alias("value"))


def incr_float(df: DataFrame, deltas: DataFrame) -> DataFrame:
    total = deltas.groupBy("key").agg(F.sum("delta").alias("d"))
    new = F.when(F.col("d").isNull(), F.col("value")).otherwise((F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.col("d")).cast("string"))
    return df.join(total, "key", "full").select("key", new.alias("value"))


def strlen(df: DataFrame) -> DataFrame:
    return df.select("key", F.octet_length("value").cast("long").alias("n"))


def get_range(value: Column, start: int, stop: int) -> Column:
    """Bytes start..stop, both included, negative from the end."""
    b = value.cast("binary")
    n = F.octet_length(b)
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.substring(b, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def set_range(value: Column, at: int, patch: bytes) -> Column:
    """Overwrite bytes from `at`; a gap fills with zeros."""
    b = F.coalesce(value.cast("binary"), F.lit(b""))
    head = F.rpad(b, at, b"\0") if at else F.lit(b"")
    return F.concat(head, F.lit(patch), F.substring(b, F.lit(at + len(patch) + 1), F.lit(2147483647)))


# ---- prefixes ----


def prefix_stats(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("key").startswith(prefix)).agg(F.count("*").alias("n"), F.count("expire_at").alias("with_ttl"))


def digest(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """Order-free digest of the rows under a prefix: XOR of the first 60 bits of each row's MD5, as any engine can take it."""
    parts = [F.concat(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("key", *columns)]
    row = F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.where(F.col("key").startswith(prefix)).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest"))
