"""Lists as (key, items array) frames; indexes count from 0, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused

ITEMS = F.col


def _at(a: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.size(a) + i


def length(df: DataFrame) -> DataFrame:
    return df.select("key", F.size("items").cast("long").alias("n"))


def index(df: DataFrame, i: int) -> DataFrame:
    return df.select("key", F.get("items", _at(F.col("items"), i)).alias("item"))


def sliced(a: Column, start: int, stop: int) -> Column:
    lo = F.greatest(_at(a, start), F.lit(0))
    hi = F.least(_at(a, stop), F.size(a) - 1)
    return F.slice(a, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def range_(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Both ends included."""
    return df.withColumn("items", sliced(F.col("items"), start, stop))


def trim(df: DataFrame, start: int, stop: int) -> DataFrame:
    """A list trimmed to nothing is gone."""
    return range_(df, start, stop).where(F.size("items") > 0)


def push(df: DataFrame, values: list[str], left: bool = False) -> DataFrame:
    new = F.array(*map(F.lit, reversed(values) if left else values))
    return df.withColumn("items", F.concat(new, "items") if left else F.concat("items", new))


def pop(df: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped, from the end it is taken from; rest). Lists that become empty are gone from the rest."""
    a = F.col("items")
    n_ = F.least(F.lit(n), F.size(a))
    out = F.slice(a, F.lit(1), n_) if left else F.reverse(F.slice(a, F.size(a) - n_ + 1, n_))
    rest = F.slice(a, n_ + 1, F.size(a) - n_) if left else F.slice(a, F.lit(1), F.size(a) - n_)
    return df.withColumn("items", out), df.withColumn("items", rest).where(F.size("items") > 0)


def set_(df: DataFrame, i: int, item: str) -> DataFrame:
    a = F.col("items")
    at = _at(a, i)
    checked = F.when((at < 0) | (at >= F.size(a)), F.raise_error(F.lit("index out of range")).cast("array<string>"))
    return df.withColumn("items", checked.otherwise(F.transform(a, lambda x, k: F.when(k == at, F.lit(item)).otherwise(x))))


def insert(df: DataFrame, pivot: str, item: str, before: bool = True) -> DataFrame:
    """Beside the first pivot; a list without it stays."""
    a = F.col("items")
    at = F.array_position(a, pivot).cast("int")
    cut = at - 1 if before else at
    return df.withColumn("items", F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), cut), F.array(F.lit(item)), F.slice(a, cut + 1, F.size(a) - cut))))


def remove(df: DataFrame, count: int, item: str) -> DataFrame:
    """The first `count` equal items (negative: the last, 0: all)."""
    a = F.reverse("items") if count < 0 else F.col("items")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    most = abs(count) if count else 2147483647
    step = lambda s, x: F.when((x == item) & (s["n"] < most), F.struct((s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(s["n"].alias("n"), F.concat(s["out"], F.array(x)).alias("out")))
    out = F.aggregate(a, start, step)["out"]
    return df.withColumn("items", F.reverse(out) if count < 0 else out).where(F.size("items") > 0)


def positions(df: DataFrame, item: str, rank: int = 1, count: int = 1, most: int = 0) -> DataFrame:
    """Places of equal items from the rank-th match on (negative: from the end), count of them (0: all), within `most` items."""
    if rank == 0:
        raise Refused("RANK 0")
    a = F.col("items")
    order = F.reverse(a) if rank < 0 else a
    hits = F.filter(F.transform(order, lambda x, k: F.when((x == item) & ((k < most) if most else F.lit(True)), k)), lambda k: k.isNotNull())
    hits = F.slice(hits, abs(rank), count or 2147483647)
    return df.select("key", (F.transform(hits, lambda k: F.size(a) - 1 - k) if rank < 0 else hits).alias("positions"))


def move(df: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """Take one item from a list's end and put it on another's (or its own); nothing happens without a source."""
    taken = df.where(F.col("key") == source).select((F.element_at("items", 1) if from_left else F.element_at("items", -1)).alias("moved"), F.lit(target).alias("to"))
    a = F.col("items")
    rest = F.slice(a, F.lit(2), F.size(a)) if from_left else F.slice(a, F.lit(1), F.size(a) - 1)
    rows = df.withColumn("items", F.when(F.col("key") == source, rest).otherwise(a))
    both = rows.join(F.broadcast(taken), F.col("key") == F.col("to"), "full").select(F.coalesce("key", "to").alias("key"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.when(F.col("moved").isNull(), F.array().cast("array<string>")).otherwise(F.array("moved")).alias("m"))
    return both.select("key", (F.concat("m", "items") if to_left else F.concat("items", "m")).alias("items")).where(F.size("items") > 0)
