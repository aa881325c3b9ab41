"""Streams, groups, feeds, live queries, sources, and that nothing needs the training-data subpackage."""

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from lodestone.catalog import Table, Window
from lodestone.errors import Refused
from lodestone.operators import audits
from lodestone.sources import tables
from lodestone.streaming import entries, feed, live


@pytest.fixture(scope="module")
def stream(spark):
    rows = [("s", 5, 1, {"a": "1"}), ("s", 5, 2, {"a": "2"}), ("s", 7, 3, {"a": "3"}), ("t", 5, 4, {"a": "4"})]
    return entries.add(None, spark.createDataFrame(rows, "stream string, ms long, order long, fields map<string,string>"))


def ids(df):
    return [(r.stream, r.ms, r.seq) for r in df.collect()]


def test_entries(spark, stream):
    s = stream.where("stream = 's'")
    assert ids(entries.range_(s)) == [("s", 5, 0), ("s", 5, 1), ("s", 7, 0)]
    assert ids(entries.range_(s, "(5-0", "5")) == [("s", 5, 1)]
    assert ids(entries.range_(s, "-", "+", 1, reverse=True)) == [("s", 7, 0)]
    assert ids(entries.read(stream, "5-0", 1)) == [("s", 5, 1)]
    assert ids(entries.range_(entries.trim(stream, maxlen=1))) == [("t", 5, 0), ("s", 7, 0)]
    assert ids(entries.trim(s, minid="6")) == [("s", 7, 0)]
    more = spark.createDataFrame([("s", 7, 1, {"a": "9"})], "stream string, ms long, order long, fields map<string,string>")
    assert ids(entries.range_(entries.add(s, more), "7-1")) == [("s", 7, 1)]
    with pytest.raises(Exception):  # noqa: B017
        entries.add(s, more.withColumn("ms", F.lit(1).cast("long"))).collect()
    with pytest.raises(Refused):
        entries.parse_id("x-1")
    assert entries.info(s).first().last_id == "7-0"


def test_groups(spark, stream):
    s = stream.where("stream = 's'")
    log = spark.createDataFrame([], "grp string, action string, ms long, seq long, consumer string, at long")
    got, log = entries.read_group(s, log, "g", 2, "alice", 10)
    assert ids(got) == [("s", 5, 0), ("s", 5, 1)]
    got, log = entries.read_group(s, log, "g", 2, "bob", 20)
    assert ids(got) == [("s", 7, 0)]
    log = log.unionByName(spark.createDataFrame([("g", "ack", 5, 0, "alice", 30)], log.schema))
    assert {(r.ms, r.seq, r.consumer, r.n) for r in entries.pending(log).collect()} == {(5, 1, "alice", 1), (7, 0, "bob", 1)}
    assert [r.ms for r in entries.idle(entries.pending(log), 40, 25).collect()] == [5]
    log = entries.auto_claim(log, "g", "carol", 40, 25)
    assert {(r.ms, r.consumer, r.n) for r in entries.pending(log).collect()} == {(5, "carol", 2), (7, "bob", 1)}
    assert entries.pending_summary(entries.pending(log)).count() == 2


def test_feed(spark):
    log = feed.number(spark.createDataFrame([(1, "a", "set", "1"), (2, "b", "set", "2"), (3, "a", "set", "3"), (4, "b", "del", None)], "seq long, key string, op string, value string"), 1)
    assert {r.key: r.value for r in feed.replay(log).collect()} == {"a": "3"}
    assert {r.key: r.value for r in feed.replay(log, upto=1).collect()} == {"a": "1", "b": "2"}
    base = spark.createDataFrame([("z", "9"), ("a", "0")], "key string, value string")
    assert {r.key: r.value for r in feed.replay(log, base).collect()} == {"a": "3", "z": "9"}
    assert [r.offset for r in feed.read(log, 0, 0, 1, 2).collect()] == [1, 2]
    assert [r.key for r in feed.read(log, 0, 0, 0, prefixes=("b",)).collect()] == ["b", "b"]
    with pytest.raises(Refused):
        feed.read(log, 0, 7, 0)
    assert feed.tail(log).first().offset == 4


def test_live(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 3}", float(i), f"chan.{i % 2}") for i in range(30)], "seq long, key string, v double, channel string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    src = lambda: live.tail(spark, str(tmp_path / "in"), rows.schema)
    assert live.run_once(live.psubscribe(src(), "chan.*", "*.1"), "subs").count() == 45
    assert live.run_once(live.subscribe(src(), "chan.0"), "sub").count() == 15
    counts = live.run_once(live.windowed(src(), "key", "10 minutes", "v"), "win", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 30
    live.upsert(src(), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    assert {r.key: r.seq for r in live.read_state(spark, str(tmp_path / "state")).collect()} == {"k0": 27, "k1": 28, "k2": 29}
    groups = live.run_once(live.running_groups(src(), "key", "v"), "grp", "update")
    assert {r.grp: r.n for r in groups.groupBy("grp").agg(F.max("n").alias("n")).collect()} == {"k0": 10, "k1": 10, "k2": 10}


def test_sources(spark, tmp_path):
    t = Table("w", "w:", "id", (("id", "i64"), ("at", "i64")), window=Window("at", 20, 10)).check()
    df = spark.range(40).selectExpr("id", "id as at")
    tables.save(df, str(tmp_path / "w"), t)
    assert tables.read(spark, str(tmp_path / "w")).where("window_bucket = 3").count() == 10
    assert sorted((r.bucket, r.hot) for r in audits.window_parts(df, t).collect()) == [(0, False), (1, False), (2, True), (3, True)]
    h = spark.createDataFrame([("k 1", {'a "b"': "x\ny", "n": "5 6"}, 9), ("k2", {"z": ""}, None)], "key string, fields map<string,string>, expire_at long")
    back = {r.key: (r.fields, r.expire_at) for r in tables.load(tables.dump(h)).collect()}
    assert back == {"k 1": ({'a "b"': "x\ny", "n": "5 6"}, 9), "k2": ({"z": ""}, None)}


def test_nothing_imports_the_training_data_subpackage():
    root = pathlib.Path(__file__).parent.parent / "lodestone"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), f


def test_group_faults(spark, stream):
    """NOACK moves the cursor, an ack ties with its delivery, streams of one group are apart, XSETID floors new ids."""
    s = stream.where("stream = 's'")
    log = spark.createDataFrame([], "stream string, grp string, action string, ms long, seq long, consumer string, at long, no long")
    log = entries.create_group(log, "g", "0", 1, stream="s")
    with pytest.raises(Refused):
        entries.create_group(log, "g", "0", 1, stream="s")
    got, log = entries.read_group(stream, log, "g", 1, "a", 5, noack=True, name="s")
    assert ids(got) == [("s", 5, 0)]
    got, log = entries.read_group(stream, log, "g", 1, "a", 5, name="s")
    assert ids(got) == [("s", 5, 1)] and entries.pending(log).count() == 1
    other, log = entries.read_group(stream, log, "g", 9, "a", 5, name="t")
    assert ids(other) == ids(stream.where("stream = 't'"))
    log = entries.ack(log, "g", got, 5, name="s")
    assert {r.stream for r in entries.pending(log).collect()} == {"t"}
    forced = entries.claim(log, "g", "b", got, 6, force=True, name="s")
    assert {(r.consumer, r.n) for r in entries.pending(forced).where("stream = 's'").collect()} == {("b", 2)}
    n, gone = entries.delete_consumer(forced, "g", "b", 7, stream="s")
    assert n == 1 and entries.pending(gone).where("stream = 's'").count() == 0
    assert entries.destroy_group(gone, "g", "t").where("stream = 't'").count() == 0
    again = entries.set_cursor(gone, "g", "0", 8, "s")
    assert entries.cursor(again, "g", "s") == (0, 0) and entries.cursor(gone, "g", "s") == (5, 1)
    floor = spark.createDataFrame([("s", 9, 4)], "stream string, ms long, seq long")
    new = spark.createDataFrame([("s", 9, 0, {"f": "v"})], "stream string, ms long, order long, fields map<string,string>")
    assert ids(entries.add(None, new, last_ids=floor)) == [("s", 9, 5)]
    with pytest.raises(Exception):  # noqa: B017
        entries.add(s, new.withColumn("ms", F.lit(8).cast("long")), last_ids=floor).collect()


def test_loads_merge_lines(spark):
    lines = spark.createDataFrame([(1, 'HSET "k" "a" "1" "b" "2"'), (2, 'HSET "k" "a" "3" "a" "4"'), (0, 'HSET "k" "b" "0" "c" "9"'), (3, 'PEXPIREAT "k" 5')], "line long, value string")
    got = tables.load(lines).first()
    assert (got.fields, got.expire_at) == ({"a": "4", "b": "2", "c": "9"}, 5)
