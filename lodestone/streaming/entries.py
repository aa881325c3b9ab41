"""Streams as (stream, ms, seq, fields) frames, consumer groups and their pending entries, by batch replay.

An id is a pair (ms, seq), ordered as such. Pending entries are ([stream,] grp, ms, seq, consumer, delivered, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import ranks

TOP = (1 << 63) - 1


def parse_id(text: str, low: bool = True) -> tuple[int, int, bool]:
    """(ms, seq, exclusive) of '-', '+', 'ms', 'ms-seq' or '(' before one."""
    out = text.startswith("(")
    text = text[out:]
    if text in ("-", "+"):
        return (0, 0, out) if text == "-" else (TOP, TOP, out)
    ms, _, seq = text.partition("-")
    try:
        return int(ms), int(seq) if seq else (0 if low else TOP), out
    except ValueError as e:
        raise Refused(f"stream id {text}") from e


def _after(i: tuple[int, int, bool]) -> Column:
    ms, seq, out = i
    s = F.col("seq") > seq if out else F.col("seq") >= seq
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & s)


def _before(i: tuple[int, int, bool]) -> Column:
    ms, seq, out = i
    s = F.col("seq") < seq if out else F.col("seq") <= seq
    return (F.col("ms") < ms) | ((F.col("ms") == ms) & s)


def text_id() -> Column:
    return F.concat_ws("-", "ms", "seq")


def add(stream: DataFrame | None, new: DataFrame, by: str = "stream", last_ids: DataFrame | None = None) -> DataFrame:
    """Append (stream, ms, order, fields): seq numbers entries of a millisecond in order, after those already there.

    last_ids: (stream, ms, seq) set for streams apart from their entries (XSETID); new ids must be above them too.
    """
    seq = (F.row_number().over(Window.partitionBy(by, "ms").orderBy("order")) - 1).cast("long")
    rows = new.withColumn("seq", seq)
    if stream is not None or last_ids is not None:
        there = [x.select(by, "ms", "seq") for x in (stream, last_ids) if x is not None]
        last = (there[0].unionByName(there[1]) if len(there) == 2 else there[0]).groupBy(by).agg(F.max(F.struct("ms", "seq")).alias("last"))
        rows = rows.join(last, by, "left")
        rows = rows.withColumn("seq", F.when(F.col("ms") == F.col("last.ms"), F.col("seq") + F.col("last.seq") + 1).otherwise(F.col("seq")))
        late = F.col("ms") < F.col("last.ms")
        rows = rows.withColumn("seq", F.when(late, F.raise_error(F.lit("id is not above the last one")).cast("long")).otherwise(F.col("seq"))).drop("last")
    rows = rows.drop("order")
    return rows if stream is None else stream.unionByName(rows)


def length(stream: DataFrame) -> DataFrame:
    return stream.groupBy("stream").agg(F.count("*").alias("n"))


def range_(stream: DataFrame, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    rows = stream.where(_after(parse_id(start)) & _before(parse_id(end, low=False)))
    rows = rows.orderBy(F.desc("ms"), F.desc("seq"), "stream") if reverse else rows.orderBy("ms", "seq", "stream")
    return rows if count is None else rows.limit(count)


def newest(stream: DataFrame, *names: str) -> dict[str, str]:
    """The last id of each named stream, 0-0 if it has none: what $ stands for when a read begins."""
    last = stream.where(F.col("stream").isin(*names)).groupBy("stream").agg(F.max(F.struct("ms", "seq")).alias("l"))
    return {**dict.fromkeys(names, "0-0"), **{r.stream: f"{r.l.ms}-{r.l.seq}" for r in last.collect()}}


def read(stream: DataFrame, after: str | dict[str, str], count: int | None = None) -> DataFrame:
    """Entries after an id, of one or more streams, `count` of each; a dict names the streams, each with its id."""
    if isinstance(after, dict):
        test = F.lit(False)
        for name, at in after.items():
            test |= (F.col("stream") == name) & _after((*parse_id(at)[:2], True))
    else:
        test = _after((*parse_id(after)[:2], True))
    rows = stream.where(test)
    if count is not None:
        rows = ranks.first(rows, "stream", ("ms", "seq"), count)
    return rows.orderBy("stream", "ms", "seq")


def delete(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids.select("stream", "ms", "seq"), ["stream", "ms", "seq"], "left_anti")


def trim(stream: DataFrame, maxlen: int | None = None, minid: str | None = None) -> DataFrame:
    """Keep the newest maxlen entries of each stream, or those from minid on; exact in either case."""
    if (maxlen is None) == (minid is None):
        raise Refused("give MAXLEN or MINID")
    if minid is not None:
        return stream.where(_after(parse_id(minid)))
    return ranks.last(stream, "stream", ("ms", "seq"), maxlen)


def info(stream: DataFrame) -> DataFrame:
    return stream.groupBy("stream").agg(F.count("*").alias("length"), F.min(F.struct("ms", "seq")).alias("first"), F.max(F.struct("ms", "seq")).alias("last")).select("stream", "length", F.concat_ws("-", "first.ms", "first.seq").alias("first_id"), F.concat_ws("-", "last.ms", "last.seq").alias("last_id"))


# ---- consumer groups, replayed from a log of actions ----
#
# A log is ([stream,] grp, action, ms, seq, consumer, at[, no]), in order of (at, no); where rows of an entry tie, a
# delivery comes before a claim and that before an ack. Actions: deliver, pass (delivered without being
# pending), claim, justid (a claim that doesn't count), ack, and setid, which places the group's cursor.

_RANK = {"setid": 0, "deliver": 1, "pass": 1, "claim": 2, "justid": 2, "ack": 3}


def _by(log: DataFrame) -> list[str]:
    return [c for c in ("stream", "grp") if c in log.columns]


def _order(log: DataFrame) -> Column:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("action"))
    return F.struct("at", F.col("no") if "no" in log.columns else F.lit(0).alias("no"), rank.alias("rank"))


def _of(log: DataFrame, grp: str, stream: str | None) -> DataFrame:
    rows = log.where(F.col("grp") == grp)
    return rows if stream is None else rows.where(F.col("stream") == stream)


def _put(log: DataFrame, rows: DataFrame, grp: str, action: str, consumer, at: int, stream: str | None) -> DataFrame:
    """The log with an action for each (ms, seq) of rows, after all that it has."""
    new = rows.select("ms", "seq").withColumns({"grp": F.lit(grp), "action": F.lit(action), "consumer": F.lit(consumer).cast("string"), "at": F.lit(at).cast("long")})
    if "stream" in log.columns:
        new = new.withColumn("stream", F.lit(stream))
    if "no" in log.columns:
        last = log.agg(F.max("no")).first()[0]
        new = new.withColumn("no", F.lit(0 if last is None else last + 1).cast("long"))
    return log.unionByName(new.select(*log.columns))


def pending(log: DataFrame) -> DataFrame:
    """Pending entries after a log: a delivery or claim gives the entry to a consumer and counts up, an ack settles it. One grouping."""
    rows = log.where(F.col("action").isin("deliver", "claim", "justid", "ack"))
    own = rows.groupBy(*_by(log), "ms", "seq").agg(F.max_by(F.struct("action", "consumer", "at"), _order(log)).alias("last"), F.count_if(F.col("action").isin("deliver", "claim")).alias("n"))
    return own.where(F.col("last.action") != "ack").select(*_by(log), "ms", "seq", F.col("last.consumer").alias("consumer"), F.col("last.at").alias("delivered"), "n")


def cursor(log: DataFrame, grp: str, stream: str | None = None) -> tuple[int, int] | None:
    """The id a group has come to: what was last set, and whatever it was given since; None without either."""
    rows = _of(log, grp, stream).where(F.col("action").isin("deliver", "pass", "setid")).select("ms", "seq", "action", _order(log).alias("o"))
    last_set = rows.where("action = 'setid'").agg(F.max("o").alias("o")).first().o
    if last_set is not None:
        rows = rows.where(F.col("o") >= F.struct(F.lit(last_set["at"]).alias("at"), F.lit(last_set["no"]).alias("no"), F.lit(last_set["rank"]).alias("rank")))
    top = rows.agg(F.max(F.struct("ms", "seq")).alias("l")).first().l
    return (top.ms, top.seq) if top else None


def create_group(log: DataFrame, grp: str, start: str = "0", at: int = 0, stream: str | None = None) -> DataFrame:
    """The log with a group whose first entry is the one after `start`; refused if there is one of this name."""
    if _of(log, grp, stream).limit(1).count():
        raise Refused(f"group {grp} exists")
    return set_cursor(log, grp, start, at, stream)


def set_cursor(log: DataFrame, grp: str, start: str, at: int, stream: str | None = None) -> DataFrame:
    ms, seq, _ = parse_id(start)
    return _put(log, log.sparkSession.createDataFrame([(ms, seq)], "ms long, seq long"), grp, "setid", None, at, stream)


def destroy_group(log: DataFrame, grp: str, stream: str | None = None) -> DataFrame:
    gone = F.col("grp") == grp
    return log.where(~(gone if stream is None else gone & (F.col("stream") == stream)))


def delete_consumer(log: DataFrame, grp: str, consumer: str, at: int, stream: str | None = None) -> tuple[int, DataFrame]:
    """(how many pending entries the consumer had, the log without them)."""
    own = pending(_of(log, grp, stream)).where(F.col("consumer") == consumer)
    return own.count(), _put(log, own, grp, "ack", consumer, at, stream)


def read_group(stream: DataFrame, log: DataFrame, grp: str, count: int, consumer: str, at: int, noack: bool = False, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New entries of a group: the first `count` after its cursor; and the log with their deliveries. noack: they never pend."""
    last = cursor(log, grp, name)
    rows = read(stream if name is None else stream.where(F.col("stream") == name), f"{last[0]}-{last[1]}" if last else "0-0", count)
    return rows, _put(log, rows, grp, "pass" if noack else "deliver", consumer, at, name)


def replay(stream: DataFrame, log: DataFrame, grp: str, consumer: str, after: str = "0", count: int | None = None, name: str | None = None) -> DataFrame:
    """A consumer's own pending entries after an id, in order, with their fields, null for entries deleted since; nothing changes."""
    ms, seq, _ = parse_id(after)
    own = pending(_of(log, grp, name)).where((F.col("consumer") == consumer) & _after((ms, seq, True))).select("ms", "seq")
    have = stream if name is None else stream.where(F.col("stream") == name)
    rows = own.join(have, ["ms", "seq"], "left").orderBy("ms", "seq")
    return rows if count is None else rows.limit(count)


def ack(log: DataFrame, grp: str, ids: DataFrame, at: int, name: str | None = None) -> DataFrame:
    """The log after the (ms, seq) of ids are settled; ids that don't pend change nothing."""
    own = pending(_of(log, grp, name)).join(ids.select("ms", "seq").distinct(), ["ms", "seq"], "left_semi")
    return _put(log, own, grp, "ack", None, at, name)


def claim(log: DataFrame, grp: str, consumer: str, ids: DataFrame, now: int, least: int = 0, justid: bool = False, force: bool = False, name: str | None = None) -> DataFrame:
    """The log after `consumer` has claimed those (ms, seq) of ids that have pended `least` milliseconds; force: also those that don't pend."""
    asked = ids.select("ms", "seq").distinct()
    own = pending(_of(log, grp, name))
    rows = own.where(F.lit(now) - F.col("delivered") >= least).join(asked, ["ms", "seq"], "left_semi").select("ms", "seq")
    if force:
        rows = rows.unionByName(asked.join(own, ["ms", "seq"], "left_anti"))
    return _put(log, rows, grp, "justid" if justid else "claim", consumer, now, name)


def consumers(log: DataFrame, now: int) -> DataFrame:
    """Each consumer of each group: its pending entries, and milliseconds since it last read or claimed."""
    seen = log.where(F.col("action").isin("deliver", "pass", "claim", "justid")).groupBy(*_by(log), "consumer").agg((F.lit(now) - F.max("at")).alias("idle"))
    return seen.join(pending(log).groupBy(*_by(log), "consumer").agg(F.count("*").alias("n")), [*_by(log), "consumer"], "left").select(*_by(log), "consumer", F.coalesce("n", F.lit(0)).alias("pending"), "idle")


def pending_summary(pel: DataFrame) -> DataFrame:
    """Entries of each group and consumer, with the lowest and highest id."""
    by = [*_by(pel), "consumer"]
    return pel.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("lo"), F.max(F.struct("ms", "seq")).alias("hi")).select(*by, "n", F.concat_ws("-", "lo.ms", "lo.seq").alias("min_id"), F.concat_ws("-", "hi.ms", "hi.seq").alias("max_id"))


def idle(pel: DataFrame, now: int, least: int, start: str = "-", end: str = "+", count: int | None = None, consumer: str | None = None) -> DataFrame:
    """Pending entries that have waited `least` milliseconds or longer."""
    rows = pel.where((F.lit(now) - F.col("delivered") >= least) & _after(parse_id(start)) & _before(parse_id(end, low=False)))
    if consumer is not None:
        rows = rows.where(F.col("consumer") == consumer)
    rows = rows.withColumn("idle", F.lit(now) - F.col("delivered")).orderBy(*_by(pel), "ms", "seq")
    return rows if count is None else rows.limit(count)


def auto_claim(log: DataFrame, grp: str, consumer: str, now: int, least: int, start: str = "-", count: int = 100, justid: bool = False, name: str | None = None) -> DataFrame:
    """The log after `consumer` has claimed the first `count` idle entries of the group."""
    rows = idle(pending(_of(log, grp, name)), now, least, start, count=count)
    return _put(log, rows, grp, "justid" if justid else "claim", consumer, now, name)
