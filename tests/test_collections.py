"""Sets, sorted sets, lists, hashes, strings, bitmaps and geo sets on small frames."""

import pytest
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import bitmaps, geo, hashes, keys, lists, sets, zsets


@pytest.fixture(scope="module")
def z(spark):
    return spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "w", 2.0), ("a", "v", 5.0), ("b", "x", 10.0), ("b", "q", 3.0)], "key string, member string, score double")


def members(df):
    return [r.member for r in df.collect()]


def test_zsets(spark, z):
    a = z.where("key = 'a'")
    assert {(r.key, r.member): r["rank"] for r in zsets.rank(z).collect()} == {("a", "x"): 0, ("a", "w"): 1, ("a", "y"): 2, ("a", "v"): 3, ("b", "q"): 0, ("b", "x"): 1}
    assert zsets.rank_of(z, "a", "y").first()["rank"] == 2
    assert zsets.rank_of(z, "a", "nope").first()["rank"] is None
    assert sorted(members(zsets.range_(a, -2, -1))) == ["v", "y"]
    assert sorted(members(zsets.without_ranks(a, 0, 1))) == ["v", "y"]
    assert members(zsets.range_by_score(a, "(1", "+inf")) == ["w", "y", "v"]
    assert members(zsets.range_by_score(a, 1, 2, 1, 1)) == ["w"]
    assert members(zsets.range_by_score(a, "-inf", 2, reverse=True)) == ["y", "w", "x"]
    popped, rest = zsets.pop_min(z, 2, below=3.0)
    assert sorted((r.key, r.member) for r in popped.collect()) == [("a", "w"), ("a", "x")]
    assert rest.count() == 4
    with pytest.raises(Refused):
        zsets.bounds("abc", 1)


def test_zadd(spark, z):
    new = spark.createDataFrame([("a", "x", 0.5, 1), ("a", "x", 3.0, 2), ("a", "n", 9.0, 3)], "key string, member string, score double, seq int")
    get = lambda df: {r.member: r.score for r in df.where("key = 'a'").collect()}
    assert get(zsets.add(z, new)) == {"x": 3.0, "y": 2.0, "w": 2.0, "v": 5.0, "n": 9.0}
    assert get(zsets.add(z, new, nx=True))["x"] == 1.0
    assert "n" not in get(zsets.add(z, new, xx=True))
    assert get(zsets.add(z, new, lt=True))["x"] == 1.0
    assert get(zsets.add(z, new, incr=True))["x"] == 4.5
    with pytest.raises(Refused):
        zsets.add(z, new, gt=True, lt=True)


def test_algebra(spark, z):
    a, b = (z.where(F.col("key") == k).select("member", "score") for k in "ab")
    plain = spark.createDataFrame([("x",)], "member string")
    got = lambda df: {r.member: r.score for r in df.collect()}
    assert got(zsets.union([a, b], [2, 1])) == {"x": 12.0, "y": 4.0, "w": 4.0, "v": 10.0, "q": 3.0}
    assert got(zsets.inter([a, b], aggregate="MIN")) == {"x": 1.0}
    assert got(zsets.inter([a, plain])) == {"x": 2.0}
    assert sorted(got(zsets.diff([a, b]))) == ["v", "w", "y"]
    assert zsets.inter_card([a, b]).first().n == 1
    s = [spark.createDataFrame([(m,) for m in x], "member string") for x in ("abc", "bcd", "c")]
    assert [sorted(members(f(s))) for f in (sets.union, sets.inter, sets.diff)] == [["a", "b", "c", "d"], ["c"], ["a"]]
    full = sets.store(s[0], "k")
    out, rest = sets.pop(full, "k", 2, seed=1)
    assert out.count() == 2 and rest.count() == 1
    assert sets.random_members(full, "k", 5, 1, repeats=True).count() == 5
    assert members(sets.scan(full, "k", "[ab]")) in (["a", "b"], ["b", "a"])


def test_lists(spark):
    df = spark.createDataFrame([("l", ["a", "b", "a", "c"])], "key string, items array<string>")
    items = lambda d: d.first()["items"] if d.count() else None
    assert items(lists.range_(df, 1, -2)) == ["b", "a"]
    assert items(lists.range_(df, -100, 100)) == ["a", "b", "a", "c"]
    assert items(lists.trim(df, 5, 9)) is None
    assert [lists.index(df, i).first()["item"] for i in (0, -1, 9)] == ["a", "c", None]
    assert items(lists.push(df, ["x", "y"], left=True))[:3] == ["y", "x", "a"]
    out, rest = lists.pop(df, 2, left=False)
    assert (items(out), items(rest)) == (["c", "a"], ["a", "b"])
    assert items(lists.set_(df, -1, "z")) == ["a", "b", "a", "z"]
    assert items(lists.insert(df, "b", "n", before=False)) == ["a", "b", "n", "a", "c"]
    assert items(lists.remove(df, 1, "a")) == ["b", "a", "c"]
    assert items(lists.remove(df, -1, "a")) == ["a", "b", "c"]
    assert items(lists.remove(df, 0, "a")) == ["b", "c"]
    assert lists.positions(df, "a", count=0).first().positions == [0, 2]
    assert lists.positions(df, "a", rank=-1).first().positions == [2]
    two = {r.key: r["items"] for r in lists.move(df, "l", "m", True, True).collect()}
    assert two == {"l": ["b", "a", "c"], "m": ["a"]}
    assert items(lists.move(df, "l", "l", False, True)) == ["c", "a", "b", "a"]


def test_hashes(spark):
    df = spark.createDataFrame([("h", {"a": "1", "b": "x"})], "key string, fields map<string,string>")
    assert tuple(hashes.get(df, "a", "z").first()) == ("h", "1", None)
    new = spark.createDataFrame([("h", {"a": "2", "c": "3"}), ("i", {"k": "v"})], "key string, fields map<string,string>")
    assert {r.key: r.fields for r in hashes.set_(df, new).collect()} == {"h": {"a": "2", "b": "x", "c": "3"}, "i": {"k": "v"}}
    assert hashes.set_(df, new, nx=True).where("key = 'h'").first().fields == {"a": "1", "b": "x", "c": "3"}
    assert hashes.increment(df, "a", 4).first().fields["a"] == "5"
    assert hashes.delete(df, "a", "b").count() == 0
    e = hashes.expire(df, 100, ("a", "zz"))
    assert tuple(hashes.ttl(e, 40, "a", "b", "zz").first()) == ("h", 60, -1, -2)
    assert hashes.live(e, 100).first().fields == {"b": "x"}
    assert hashes.expire(e, 50, ("a",), "GT").first().deadlines == {"a": 100}
    assert hashes.expire(e, 50, ("a",), "LT").first().deadlines == {"a": 50}
    assert hashes.persist(e, ("a",)).first().deadlines == {}
    assert hashes.keys(df).first().names == ["a", "b"] and hashes.values(df).first()["values"] == ["1", "x"]


def test_keyspace(spark):
    df = spark.createDataFrame([("u:1", "hash", "v1", None), ("u:2", "string", "v2", 50), ("w:1", "hash", "v3", None)], "key string, type string, value string, expire_at long")
    assert sorted(r.key for r in keys.scan(df, "u:?", "hash").collect()) == ["u:1"]
    assert keys.live(df, 50).count() == 2
    assert keys.exists(df, ["u:1", "u:1", "no"]).first().n == 2
    assert {r.key: r.ttl for r in keys.ttl(df, 20, ["u:1", "u:2", "no"]).collect()} == {"u:1": -1, "u:2": 30, "no": -2}
    assert sorted(r.key for r in keys.rename(df, "u:1", "w:1").collect()) == ["u:2", "w:1"]
    assert keys.rename(df, "u:1", "w:1", nx=True).count() == 3
    with pytest.raises(Refused):
        keys.rename(df, "no", "x")
    s = df.select("key", "value", "expire_at")
    new = spark.createDataFrame([("u:1", "a", 1), ("u:1", "b", 2), ("n", "c", 3)], "key string, value string, seq int")
    assert {r.key: r.value for r in keys.set_(s, new).collect()} == {"u:1": "b", "u:2": "v2", "w:1": "v3", "n": "c"}
    assert {r.key for r in keys.set_(s, new, xx=True).collect()} == {"u:1", "u:2", "w:1"}
    n = spark.createDataFrame([("c", "41")], "key string, value string")
    d = spark.createDataFrame([("c", 1), ("d", 5)], "key string, delta long")
    assert {r.key: r.value for r in keys.incr(n, d).collect()} == {"c": "42", "d": "5"}
    one = spark.createDataFrame([("abcdef",)], "v string")
    assert bytes(one.select(keys.get_range(F.col("v"), -3, -2).alias("x")).first().x) == b"de"
    assert bytes(one.select(keys.set_range(F.col("v"), 8, b"z").alias("x")).first().x) == b"abcdef\0\0z"
    assert keys.digest(df, "u:", "value").first() == keys.digest(df.orderBy(F.desc("key")), "u:", "value").first()


def test_bitmaps(spark):
    df = spark.createDataFrame([(bytearray(b"foobar"), bytearray(b"ab"))], "a binary, b binary")
    a, b = F.col("a"), F.col("b")
    got = df.select(bitmaps.bit_count(a).alias("n"), bitmaps.bit_count(a, 1, 1).alias("n1"), bitmaps.get_bit(a, 1).alias("g"), bitmaps.get_bit(a, 999).alias("far"), bitmaps.bit_pos(a, 1).alias("p1"), bitmaps.bit_pos(F.lit(b"\xff"), 0).alias("p0"), bitmaps.set_bit(b, 23, 1).alias("s"), bitmaps.bit_op("AND", a, b).alias("and"), bitmaps.bit_op("XOR", a, a).alias("xor"), bitmaps.bit_op("NOT", b).alias("not")).first()
    assert (got.n, got.n1, got.g, got.far, got.p1, got.p0) == (26, 6, 1, 0, 1, 8)
    assert bytes(got.s) == b"ab\x01"
    assert bytes(got["and"]) == bytes([ord("f") & ord("a"), ord("o") & ord("b"), 0, 0, 0, 0])
    assert bytes(got["xor"]) == bytes(6) and bytes(got["not"]) == bytes([158, 157])


def test_geo(spark):
    df = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669), ("s", "off", 0.0, 89.0)], "key string, member string, lon double, lat double")
    g = geo.add(df)
    got = {r.member: (r.score, r.h) for r in g.select("member", "score", geo.geohash(F.col("score")).alias("h")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"Palermo": 3479099956230698, "Catania": 3479447370796909}
    assert got["Palermo"][1].startswith("sqc8b49rny") and got["Catania"][1].startswith("sqdtr74hyu")
    assert abs(geo.dist(g, "Palermo", "Catania").first().dist - 166274.1516) < 5
    assert members(geo.search(g, 15.0, 37.0, radius=200, unit="km", desc=False)) == ["Catania", "Palermo"]
    assert members(geo.search(g, 15.0, 37.0, radius=100, unit="km")) == ["Catania"]
    assert sorted(members(geo.search(g, 15.0, 37.0, box=(400, 400), unit="km"))) == ["Catania", "Palermo"]
    assert members(geo.search_by_member(g, "Palermo", radius=1, unit="m")) == ["Palermo"]
    assert geo.search_by_member(g, "nobody", radius=1).count() == 0
    with pytest.raises(Refused):
        geo.search(g, 0, 0)
