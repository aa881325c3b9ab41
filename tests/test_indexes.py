"""Places by pieces, the stored vector index, tokenizers as parameters, polls, notifications and stored searches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import geo, ranks, text, text_index, vector_index, vectors, zsets
from lodestone.streaming import entries, feed, live


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", f"m{i:05d}", float(rnd.randrange(40))) for i in range(6000)]
    return spark.createDataFrame([*rows, (None, "x", 1.0), (None, "y", None), ("hot", "same", 5.0)], "key string, member string, score double")


def test_numbered_in_pieces(scores):
    window = Window.partitionBy("key").orderBy("score", "member")
    want = scores.withColumn("_r", F.row_number().over(window).cast("long"))
    got = ranks.numbered(scores, "key", ("score", "member"), piece_rows=100)
    assert "_piece" in got._jdf.queryExecution().analyzed().toString()
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_first_and_last(scores, monkeypatch):
    z = scores.where("key is not null")
    want = {n: (sorted(map(tuple, ranks.first(z, "key", ("score", "member"), n).collect())), sorted(map(tuple, ranks.last(z, "key", ("score", "member"), n).collect()))) for n in (1, 50)}
    monkeypatch.setattr(ranks, "TOP_ROWS", 0)
    for n, (first, last) in want.items():
        assert sorted(map(tuple, ranks.first(z, "key", ("score", "member"), n).collect())) == first
        assert sorted(map(tuple, ranks.last(z, "key", ("score", "member"), n).collect())) == last
    assert sorted(map(tuple, zsets.pop_min(z, 50)[0].collect())) == want[50][0]


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(5)
    middles = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(f"p{i:05d}", [m + rnd.gauss(0, 0.4) for m in middles[i % 30]]) for i in range(4000)]
    odd = [("zero", [0.0] * 16), ("short", [1.0]), ("null", None), ("nan", [float("nan")] * 16), ("twin", rows[0][1])]
    return spark.createDataFrame(rows + odd, "key string, v array<double>"), rows


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_vector_index(spark, points, tmp_path, metric):
    df, rows = points
    vector_index.build(df, str(tmp_path), "v", 16, metric)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == len(rows) + 2  # every usable row has a cell
    found = 0
    for _, q in rows[:12]:
        want = [r.key for r in vectors.knn(df, "v", q, 10, metric).collect()]
        assert [r.key for r in vector_index.knn(spark, str(tmp_path), q, 10, ef=16, exact=True).collect()] == want
        found += len(set(want) & {r.key for r in vector_index.knn(spark, str(tmp_path), q, 10, ef=16).collect()})
    assert found >= 0.9 * 120
    with pytest.raises(Refused):
        vector_index.knn(spark, str(tmp_path), [1.0], 3)
    with pytest.raises(Refused):
        vector_index.knn(spark, str(tmp_path), rows[0][1], 3, ef=5000)


def test_vector_index_recall_of_embeddings(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("key", F.col("vec_id").cast("string"))
    queries = [[float(x) for x in r.embedding] for r in e.where("vec_id % 50 = 0").limit(10).collect()]
    vector_index.build(e, str(tmp_path), "embedding", len(queries[0]))
    hits = 0
    for q in queries:
        want = {r.key for r in vectors.knn(e, "embedding", q, 10).collect()}
        hits += len(want & {r.key for r in vector_index.knn(spark, str(tmp_path), q, 10).collect()})
    assert hits >= 0.9 * 10 * len(queries)


def test_vector_index_empty(spark, points, tmp_path):
    vector_index.build(points[0].limit(0), str(tmp_path), "v", 16)
    assert vector_index.knn(spark, str(tmp_path), [1.0] * 16).collect() == []


def test_other_tokenizer(spark, tmp_path):
    df = spark.createDataFrame([("a", "x-1 y-2"), ("b", "y-2 z-3")], "key string, body string")
    blanks = text.Tokenizer(lambda c: F.filter(F.split(c, " "), lambda t: t != ""), str.split)
    assert [r.key for r in text.match_texts(df, "x-1", ("body",), cut=blanks).collect()] == ["a"]
    assert {r.term for r in text.postings(df, ("body",), cut=blanks).collect()} == {"x-1", "y-2", "z-3"}
    text_index.build(df, str(tmp_path), ("body",), cut=blanks)
    assert {r.key for r in text_index.match(spark, str(tmp_path), "y-2", cut=blanks).collect()} == {"a", "b"}


def test_block(spark):
    answers = iter([spark.range(0), spark.range(0), spark.range(2)])
    assert live.block(lambda: next(answers), 30, every=0.01).count() == 2
    assert live.block(lambda: spark.range(0), 0.05, every=0.01) is None


def test_read_from_newest(spark):
    new = spark.createDataFrame([("s", 5, 1), ("s", 6, 2), ("t", 9, 3)], "stream string, ms long, order long")
    s = entries.add(None, new)
    at = entries.newest(s, "s", "u")
    assert at == {"s": "6-0", "u": "0-0"}
    assert entries.read(s, at).collect() == []
    more = entries.add(s, spark.createDataFrame([("s", 6, 4), ("u", 1, 5)], "stream string, ms long, order long"))
    assert [(r.stream, r.ms, r.seq) for r in entries.read(more, at).collect()] == [("s", 6, 1), ("u", 1, 0)]


def test_notifications(spark):
    log = spark.createDataFrame([("a", "SET"), ("b", "ZADD"), ("c", "DEL"), ("d", "SINTERSTORE"), ("e", "SETEX"), ("f", "RPOPLPUSH"), ("g", "GEOADD"), ("h", "XADD"), ("i", "expired"), ("j", "HDEL")], "key string, op string")
    assert {r.key: r.c for r in log.select("key", feed.verb_class(F.col("op")).alias("c")).collect()} == dict(zip("abcdefghij", "$zgs$lztxh", strict=True))
    assert sorted(map(tuple, feed.notifications(log, "Ez").collect())) == [("__keyevent@0__:geoadd", "g"), ("__keyevent@0__:zadd", "b")]
    assert sorted(map(tuple, feed.notifications(log, "Kg").collect())) == [("__keyspace@0__:c", "del")]
    assert feed.notifications(log, "KE").collect() == [] and feed.notifications(log, "A").collect() == []
    with pytest.raises(Refused):
        feed.notifications(log, "Q")


def test_stored_search(spark):
    g = geo.add(spark.createDataFrame([("k", "a", 13.361389, 38.115556), ("k", "b", 15.087269, 37.502669)], "key string, member string, lon double, lat double"))
    found = geo.search(g, 15.0, 37.0, radius=100.0, unit="km")
    assert [(r.key, r.member, r.score) for r in geo.store(found, "near").collect()] == [("near", "b", 3479447370796909.0)]
    assert 56 < geo.store(found, "near", with_dist=True).first().score < 57
