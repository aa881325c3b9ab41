"""Structured Streaming: tails of tables, channels, event-time windows and continuously upserted state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.keys import like


def tail(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A growing folder of Parquet files as a stream; the checkpoint of the query is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(messages: DataFrame, *channels: str) -> DataFrame:
    """Messages (channel, ..) of named channels; works on batches and streams."""
    return messages.where(F.col("channel").isin(*channels))


def psubscribe(messages: DataFrame, *patterns: str) -> DataFrame:
    """Messages of channels that fit a glob, once for each pattern that fits."""
    hits = F.filter(F.array(*[F.when(like(F.col("channel"), p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    return messages.withColumn("pattern", F.explode(hits))


def windowed(events: DataFrame, by: str, size: str, value: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count and sum in event-time windows; what comes later than the watermark is left out. An extension."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, by: str, gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count in sessions that end after a gap. An extension."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def running_groups(events: DataFrame, by: str, value: str) -> DataFrame:
    """Aggregates kept as the stream grows: (group, n, total, low, high), an update for each touched group."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for f in frames:
            v = f["m"].dropna()
            if len(v):
                n, total, low, high = n + len(v), total + float(v.sum()), min(low, float(v.min())), max(high, float(v.max()))
        state.update((n, total, low, high))
        if n:
            yield pd.DataFrame({"grp": [key[0]], "n": [n], "total": [total], "low": [low], "high": [high]})

    rows = events.select(F.col(by).cast("string").alias("grp"), F.col(value).cast("double").alias("m")).where("grp is not null")
    return rows.groupBy("grp").applyInPandasWithState(update, "grp string, n long, total double, low double, high double", "n long, total double, low double, high double", "update", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "key", order: str = "seq") -> StreamingQuery:
    """Write the last row of each key of each micro-batch under path/batch=n; read_state() folds the batches."""

    def write(batch: DataFrame, n: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("l")).select("l.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, path: str, key: str = "key", order: str = "seq") -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("l")).select("l.*")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return the result as a table (for tests and small tails)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def block(read: Callable[[], DataFrame], timeout: float, every: float = 0.5) -> DataFrame | None:
    """Ask again until an answer has a row, and return that answer; None after `timeout` seconds (0: wait for ever).

    The blocking forms (BLPOP, BZPOPMIN, XREAD BLOCK) as polls: read() must look at its tables anew each time, and
    waiting readers are served in no order.
    """
    end = time.monotonic() + timeout if timeout else float("inf")
    while True:
        found = read()
        if not found.isEmpty():
            return found
        if time.monotonic() >= end:
            return None
        time.sleep(min(every, max(0.0, end - time.monotonic())))


def transform(df: DataFrame, script: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A script over a frame: the counterpart of server-side scripting; it runs as a plan, not atomically."""
    return df.transform(script)
