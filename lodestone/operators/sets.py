"""Sets as (key, member) frames with distinct rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(s: DataFrame, key: str) -> DataFrame:
    return s.where(F.col("key") == key).select("member")


def is_member(s: DataFrame, key: str, member: str) -> DataFrame:
    return s.where((F.col("key") == key) & (F.col("member") == member)).agg((F.count("*") > 0).alias("found"))


def card(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("n"))


def add(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.unionByName(new.select("key", "member")).distinct()


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def union(inputs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [x.select("member") for x in inputs]).distinct()


def inter(inputs: list[DataFrame]) -> DataFrame:
    """One grouping over all inputs."""
    each = [x.select("member", F.lit(i).alias("src")) for i, x in enumerate(inputs)]
    return reduce(DataFrame.union, each).groupBy("member").agg(F.countDistinct("src").alias("n")).where(F.col("n") == len(inputs)).select("member")


def diff(inputs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), inputs[1:], inputs[0].select("member"))


def store(result: DataFrame, key: str) -> DataFrame:
    """A result as the set `key`."""
    return result.select(F.lit(key).alias("key"), "member")


def random_members(s: DataFrame, key: str, n: int, seed: int, repeats: bool = False) -> DataFrame:
    """n members drawn by a seed: distinct ones, or with repeats from numbered members."""
    own = members(s, key)
    if not repeats:
        return own.orderBy(F.xxhash64(F.lit(seed), "member"), "member").limit(n)
    size = own.count()
    if not size:
        return own
    draws = own.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("at"))
    from pyspark.sql import Window

    numbered = own.withColumn("at", (F.row_number().over(Window.orderBy("member")) - 1).cast("long"))
    return draws.join(numbered, "at").select("member")


def pop(s: DataFrame, key: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(popped members, the frame without them)."""
    out = random_members(s, key, n, seed)
    return out, remove(s, store(out, key))


def scan(s: DataFrame, key: str, pattern: str = "*") -> DataFrame:
    from lodestone.operators.keys import like

    return members(s, key).where(like(F.col("member"), pattern))
