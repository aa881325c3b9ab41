"""Sorted sets as (key, member, score) frames with distinct (key, member); order is (score, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import ranks

ORDER = ("score", "member")


def score(z: DataFrame, key: str, member: str) -> DataFrame:
    return z.where((F.col("key") == key) & (F.col("member") == member)).select("score")


def card(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("n"))


def rank(z: DataFrame) -> DataFrame:
    """Every member's rank from 0."""
    return ranks.numbered(z, "key", ORDER, "rank").withColumn("rank", F.col("rank") - 1)


def rank_of(z: DataFrame, key: str, member: str) -> DataFrame:
    """One member's rank by counting those before it: no sort, no window."""
    own = z.where((F.col("key") == key) & (F.col("member") == member)).select(F.col("score").alias("s"))
    before = (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < member))
    return z.where(F.col("key") == key).crossJoin(F.broadcast(own)).agg(F.when(F.count("*") > 0, F.count_if(before)).alias("rank"))


def _slice(z: DataFrame, start: int, stop: int) -> tuple[DataFrame, Column]:
    rows = ranks.numbered(z, "key", ORDER).withColumn("_r", F.col("_r") - 1)
    if start < 0 or stop < 0:
        rows = ranks.sizes(rows, "key")
    lo = F.lit(start) if start >= 0 else F.greatest(F.col("_n") + start, F.lit(0))
    hi = F.lit(stop) if stop >= 0 else F.col("_n") + stop
    return rows, F.col("_r").between(lo, hi)


def range_(z: DataFrame, start: int, stop: int) -> DataFrame:
    """Members by rank, both ends included; negative ranks count from the end."""
    rows, inside = _slice(z, start, stop)
    return rows.where(inside).withColumn("rank", F.col("_r").cast("long")).drop("_r", "_n")


def without_ranks(z: DataFrame, start: int, stop: int) -> DataFrame:
    rows, inside = _slice(z, start, stop)
    return rows.where(~inside).drop("_r", "_n")


def bounds(low: str | float, high: str | float) -> Column:
    """Score limits; '(1.5' excludes its end, '-inf' and '+inf' are open."""

    def one(x, below: bool) -> Column:
        text = str(x)
        out = text.startswith("(")
        try:
            v = F.lit(float(text[1:] if out else text))
        except ValueError as e:
            raise Refused(f"{text} is not a float") from e
        s = F.col("score")
        return (s > v if out else s >= v) if below else (s < v if out else s <= v)

    return one(low, True) & one(high, False)


def range_by_score(z: DataFrame, low, high, offset: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Of one key: members with a score in the limits, in order (reverse: from the highest), paged."""
    rows = z.where(bounds(low, high))
    rows = rows.orderBy(F.desc("score"), F.desc("member")) if reverse else rows.orderBy("score", "member")
    rows = rows.offset(offset) if offset else rows
    return rows if count is None or count < 0 else rows.limit(count)


def count(z: DataFrame, low, high) -> DataFrame:
    return z.where(bounds(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def without_scores(z: DataFrame, low, high) -> DataFrame:
    return z.where(~bounds(low, high))


def pop_min(z: DataFrame, n: int, below: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): for each key the n lowest members, only those with a score under `below` if given."""
    out = ranks.first(z, "key", ORDER, n)
    out = out if below is None else out.where(F.col("score") < below)
    return out, z.join(out.select("key", "member"), ["key", "member"], "left_anti")


def scan(z: DataFrame, key: str, pattern: str = "*") -> DataFrame:
    """(member, score) of a set, members that match a glob."""
    from lodestone.operators.keys import like

    return z.where((F.col("key") == key) & like(F.col("member"), pattern)).select("member", "score")


def add(z: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> DataFrame:
    """Upsert (key, member, score[, seq]); of several new scores of a member the last by seq counts (incr: their sum)."""
    if (nx and (xx or gt or lt)) or (gt and lt):
        raise Refused("ZADD flags NX, XX, GT and LT do not combine so")
    if incr:
        new = new.groupBy("key", "member").agg(F.sum("score").alias("new"))
    elif "seq" in new.columns:
        new = new.groupBy("key", "member").agg(F.max_by("score", "seq").alias("new"))
    else:
        new = new.groupBy("key", "member").agg(F.max("score").alias("new"))
    both = z.join(new, ["key", "member"], "full")
    old, fresh = F.col("score"), F.col("new")
    value = old + fresh if incr else fresh
    change = F.when(old.isNull(), F.lit(not xx)).otherwise(F.lit(False) if nx else value > old if gt else value < old if lt else F.lit(True))
    return both.select("key", "member", F.when(fresh.isNotNull() & change, F.coalesce(value, fresh)).otherwise(old).alias("score")).where(F.col("score").isNotNull())


def remove(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def _stacked(inputs: list[DataFrame], weights: list[float] | None) -> DataFrame:
    weights = weights or [1.0] * len(inputs)
    if len(weights) != len(inputs):
        raise Refused("WEIGHTS must match the inputs")
    each = [(x if "score" in x.columns else x.withColumn("score", F.lit(1.0))).select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("src")) for i, (x, w) in enumerate(zip(inputs, weights, strict=True))]
    return reduce(DataFrame.unionByName, each)


def _fold(how: str) -> Column:
    if how not in ("SUM", "MIN", "MAX"):
        raise Refused(f"AGGREGATE {how}")
    return {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[how]("score").alias("score")


def union(inputs: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """(member, score) over (member, score) inputs; a plain set's members score 1."""
    return _stacked(inputs, weights).groupBy("member").agg(_fold(aggregate))


def inter(inputs: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """Members of every input, in one grouping rather than a chain of joins."""
    return _stacked(inputs, weights).groupBy("member").agg(_fold(aggregate), F.countDistinct("src").alias("_n")).where(F.col("_n") == len(inputs)).drop("_n")


def diff(inputs: list[DataFrame]) -> DataFrame:
    """Members of the first input that no other has, with their scores."""
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), inputs[1:], inputs[0])


def inter_card(inputs: list[DataFrame], limit: int = 0) -> DataFrame:
    n = F.count("*")
    return inter(inputs).agg((F.least(n, F.lit(limit)) if limit else n).alias("n"))
