"""Tokens, BM25, phrases, prefixes, typos, highlights and vectors."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import text, vectors


def frame(spark, texts):
    return spark.createDataFrame([(f"p:{i}", t) for i, t in enumerate(texts, 1)], "key string, body string")


def test_tokens(spark):
    s = "全文检索 Rust-lang a 検 x9 中A文"
    want = ["全文", "文检", "检索", "rust", "lang", "検", "x9", "中", "文"]
    df = spark.createDataFrame([(s,), ("Hello a WORLD x",), ("",), (None,)], "s string")
    assert [r.t for r in df.select(text.tokens(F.col("s")).alias("t")).collect()] == [want, ["hello", "world"], [], None]
    assert text.query_tokens(s) == want


def scores(df):
    return {r.key: round(r.score, 9) for r in df.collect()}


def test_bm25_by_hand(spark):
    docs = [["rust", "search", "rust"], ["text", "search"], []]
    df = frame(spark, [" ".join(d) for d in docs])
    n, avgdl = 2, 2.5  # a document without a token counts nowhere

    def one(tf, f, dl):
        return math.log((n - f + 0.5) / (f + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    want = {"p:1": one(2, 1, 3) + one(1, 2, 3), "p:2": one(1, 2, 2)}
    for got in (text.match_texts(df, "rust search search", ("body",)), text.match(text.postings(df, ("body",)), "rust search search")):
        assert scores(got) == pytest.approx(want)


def test_phrases_prefixes_typos(spark):
    df = frame(spark, ["the quick brown fox jumps", "quick red then a brown hare", "a brown quick animal appears", "quiet night"])
    post = text.postings(df, ("body",))
    for ask, want in (('"quick brown"', {"p:1"}), ("qui*", {"p:1", "p:2", "p:3", "p:4"}), ("quick", {"p:1", "p:2", "p:3"}), ("中", set())):
        assert set(scores(text.match_texts(df, ask, ("body",)))) == want
        assert scores(text.match_texts(df, ask, ("body",))) == scores(text.match(post, ask))
    assert set(scores(text.match_texts(df, "quikc", ("body",), typo=2))) == {"p:1", "p:2", "p:3", "p:4"}  # quiet is two edits off as well
    assert set(scores(text.match_texts(df, "qwick", ("body",), typo=1))) == {"p:1", "p:2", "p:3"}
    with pytest.raises(Refused):
        text.match_texts(df, "quick", ("body",), typo=3)
    with pytest.raises(Refused):
        text.parse('"quick brown"', positions=False)


def test_weighted_fields(spark):
    df = spark.createDataFrame([("d:1", "rust", "nothing here"), ("d:2", "other", "rust here")], "key string, title string, body string")
    got = text.top(text.match_texts(df, "rust", ("title", "body"), weights={"title": 5, "body": 1})).collect()
    assert [r.key for r in got] == ["d:1", "d:2"]
    assert set(scores(text.match_texts(df, "rust", ("title", "body"), within=("body",)))) == {"d:2"}


def test_highlight(spark):
    df = frame(spark, ["Été: the quick brown fox, quick", "slow"])
    got = {r.key: [tuple(s) for s in r.spans] for r in text.highlight(df, '"quick brown" fox', ("body",)).collect()}
    s = "Été: the quick brown fox, quick".encode()
    assert {k: [s[a:b].decode() for a, b in v] for k, v in got.items()} == {"p:1": ["quick", "brown", "fox"]}


def test_vectors(spark):
    rows = [("e:1", [1.0, 0.0]), ("e:2", [0.0, 2.0]), ("e:3", [3.0, 3.0]), ("e:4", [1.0]), ("e:5", [float("nan"), 1.0]), ("e:6", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    got = [(r.key, round(r.dist, 6)) for r in vectors.knn(df, "v", [1.0, 0.0], 10).collect()]
    assert got == [("e:1", 0.0), ("e:3", round(1 - math.sqrt(0.5), 6)), ("e:2", 1.0), ("e:6", 1.0)]
    assert [r.key for r in vectors.knn(df, "v", [1.0, 0.0], 2, "ip").collect()] == ["e:3", "e:1"]
    assert [(r.key, r.dist) for r in vectors.knn(df, "v", [1.0, 0.0], 2, "l2").collect()] == [("e:1", 0.0), ("e:6", 1.0)]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "key string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "key string, rank int")
    assert [r.key for r in vectors.rrf([a, b]).collect()] == ["y", "x", "z"]


def test_stored_index_agrees_with_texts(spark, tmp_path):
    from lodestone.operators import text_index

    df = spark.createDataFrame([(f"p:{k}", " ".join(["rust", "search", "licence", "text", "rusty"][: k % 6] * (k % 3 + 1)), "rust" if k % 4 == 0 else None) for k in range(60)], "key string, body string, title string")
    at = str(tmp_path / "index")
    text_index.build(df, at, ("body", "title"), buckets=5)
    for q, within, weights, typo in (("rust text", (), None, 0), ("rust", ("title",), None, 0), ("ru*", ("body",), None, 0), ('"search licence" text', (), {"title": 5.0}, 0), ("rustt", (), None, 1), ("nothing", (), None, 0)):
        assert scores(text_index.match(spark, at, q, within, weights, typo)) == scores(text.match_texts(df, q, ("body", "title"), within, weights, typo)), q
    plan = text_index.match(spark, at, "rust")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    with pytest.raises(Refused):
        text_index.match(spark, at, "x", ("other",))
    text_index.build(df.limit(0), str(tmp_path / "none"), ("body",))
    assert text_index.match(spark, str(tmp_path / "none"), "rust").count() == 0


def test_typos_count_bytes(spark):
    df = frame(spark, ["cafe", "café", "caff"])
    assert sorted(scores(text.match_texts(df, "cafe", ("body",), typo=1))) == ["p:1", "p:3"]
    assert sorted(scores(text.match_texts(df, "cafe", ("body",), typo=2))) == ["p:1", "p:2", "p:3"]
