"""Change feeds: ordered frames (shard, generation, offset, key, op, value), their slices, replay and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import ranks

COUNT, MOST_COUNT = 256, 4096


def read(log: DataFrame, shard: int, generation: int, offset: int, count: int = COUNT, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Frames of a shard from a cursor on; a cursor of another generation must start over."""
    now = log.where(F.col("shard") == shard).agg(F.max("generation").alias("g")).first().g
    if now is not None and generation != now:
        raise Refused(f"FEEDRESYNC: generation is {now}")
    rows = log.where((F.col("shard") == shard) & (F.col("generation") == generation) & (F.col("offset") >= offset))
    if prefixes:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes]))
    return rows.orderBy("offset").limit(max(1, min(count, MOST_COUNT)))


def tail(log: DataFrame) -> DataFrame:
    """Each shard's newest (generation, next offset)."""
    last = log.groupBy("shard").agg(F.max(F.struct("generation", "offset")).alias("l"))
    return last.select("shard", "l.generation", (F.col("l.offset") + 1).alias("offset"))


def shards(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("shard").alias("n"))


def replay(log: DataFrame, base: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """(key, value) after a snapshot and the frames behind it: the last frame of each key decides, one grouping."""
    frames = log if upto is None else log.where(F.col("offset") <= upto)
    rows = frames.select("key", F.struct("generation", "offset").alias("at"), "op", "value")
    if base is not None:
        rows = rows.unionByName(base.select("key", F.struct(F.lit(-1).cast("long").alias("generation"), F.lit(-1).cast("long").alias("offset")).alias("at"), F.lit("set").alias("op"), "value"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "at").alias("l"))
    return last.where(F.col("l.op") != "del").select("key", "l.value")


def number(changes: DataFrame, n_shards: int, order: str = "seq") -> DataFrame:
    """(seq, key, op, value) -> a feed: shard from the key's hash, offsets gapless within it."""
    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    rows = changes.withColumn("shard", shard).withColumn("generation", F.lit(0).cast("long"))
    return ranks.numbered(rows, "shard", (order,), "offset").withColumn("offset", F.col("offset") - 1)


def verb_class(verb: Column) -> Column:
    """The class of a writing verb: g (any key), h, l, s, z, t (streams), x (expired) or $ (strings)."""
    v = F.lower(verb)
    return (
        F.when(v.isin("del", "unlink", "expire", "pexpire", "persist", "rename"), "g")
        .when(v == "expired", "x")
        .when(v.rlike("^(z|geo)"), "z")
        .when(v.startswith("h"), "h")
        .when(v.startswith("x"), "t")
        .when(v.rlike("^(l|rp)"), "l")
        .when(v.rlike("^(sadd|srem|spop|smove|s(inter|union|diff)store)$"), "s")
        .otherwise("$")
    )


def notifications(log: DataFrame, flags: str = "KEA") -> DataFrame:
    """(channel, message) for frames (key, op = verb): K a channel for the key, E one for the event, then classes, A for all.

    Works on batches and streams; psubscribe() picks channels. Without K or E, or without a class, nothing is sent.
    """
    if wrong := set(flags) - set("KEAghlsztx$"):
        raise Refused(f"notification flags {''.join(sorted(wrong))}")
    rows = log if "A" in flags else log.where(verb_class(F.col("op")).isin(*(set(flags) - set("KE"))))
    event = F.lower("op")
    sent = [F.struct(F.concat(F.lit("__keyspace@0__:"), F.col("key")).alias("channel"), event.alias("message"))] if "K" in flags else []
    sent += [F.struct(F.concat(F.lit("__keyevent@0__:"), event).alias("channel"), F.col("key").alias("message"))] if "E" in flags else []
    if not sent:
        return log.select(F.col("key").alias("channel"), F.col("op").alias("message")).where(F.lit(False))
    return rows.select(F.explode(F.array(*sent)).alias("m")).select("m.*")
