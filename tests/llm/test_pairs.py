"""Near-duplicate, suffix and language-model operators, and the pipeline, against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from lodestone.llm import backoff, bpe, components, embeddings, ordinal, queries, simhash, suffixes
from tests.llm.test_rowwise import edge_rows, fill, SCHEMA


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    want = roots(edges, {x for e in edges for x in e})
    for parts in (1, 9):
        got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(parts)).collect()}
        assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_print(text):
    w = bytes((text or "").encode()).lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) <= 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    for t in [None, "", "one", "A b", "A b\tC", *("".join(rng.choices("ab C\né ", k=rng.randint(0, 200))) for _ in range(200))]:
        assert simhash.fingerprint((t or "").encode()) == slow_print(t)


def test_links_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in rng.choice(base, 600)]
    fps = np.unique(np.array([*map(int, base), *near, 0, (1 << 64) - 1, 7], np.uint64))
    ints = fps.view(np.int64).tolist()
    pairs = [(ints[i], ints[j]) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1)]
    want = roots(pairs, ints)
    for block in (50_000, 2):  # also with cells dealt into many blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.u: r.v for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in ints], "fp long"))).collect()}
        assert {n: got.get(n, n) for n in ints} == want


def test_simhash_edges(spark, edge, empty):
    rows = simhash.classes(edge).collect()
    assert len(rows) == len(edge_rows())
    blank = {r.component_id for r in rows if not (r.text or "").strip()}
    assert blank == {2}  # null and wordless texts are one class
    kept = simhash.near_copies_removed(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0
    assert simhash.classes(empty).count() == 0 and simhash.near_copies_removed(empty).count() == 0


def slow_similar(rows):
    """Pairs of ids whose texts have the same five-word shingles or a similarity of 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]


def test_near_copies_by_hand(spark, sf, edge, empty):
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 300))]
        for changes in (0, 1, 2, 4, 6, 9):
            copy = list(base)
            for k in rng.sample(range(len(base)), min(len(base), changes)):
                copy[k] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    rows = list(enumerate([*texts, None, "", " \n", "one", "ONE ", "one two"]))
    pairs = slow_similar(rows)
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in pairs) > 20  # three bits of a fingerprint would not do
    top = roots(pairs, range(len(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()) == sorted(i for i, r in top.items() if i == r)
    kept = corpus_pipeline.near_duplicates(spark, edge, sf)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0
    assert corpus_pipeline.near_duplicates(spark, empty, sf).count() == 0


def test_wide_links_are_whole(spark, monkeypatch):
    """The range join of four-word fingerprints and sizes against all pairs, also with counts that fill many cells and blocks."""
    rng = np.random.default_rng(8)
    n = 900
    src = rng.integers(0, 90, n)
    noise = rng.integers(0, 1 << 64, (4, n), dtype=np.uint64) & rng.integers(0, 1 << 64, (4, n), dtype=np.uint64) & rng.integers(0, 1 << 64, (4, n), dtype=np.uint64)
    prints = rng.integers(0, 1 << 64, (4, 90), dtype=np.uint64)[:, src] ^ noise
    prints[:, :40] |= rng.integers(0, 1 << 64, (4, 40), dtype=np.uint64) | rng.integers(0, 1 << 64, (4, 40), dtype=np.uint64)  # heavy words, in other cells
    size = np.exp(rng.uniform(0, 7, 90))[src].astype(np.int64) + rng.integers(0, 6, n)
    rows = [(k, int(size[k]), *map(int, prints[:, k].view(np.int64))) for k in range(n)]
    df = spark.createDataFrame(rows, "cls long, n long, p0 long, p1 long, p2 long, p3 long").repartition(4)
    for most in ((50, 84), (26, 60)):
        pairs = []
        for a in range(n):
            d = np.bitwise_count(prints[:, a : a + 1] ^ prints).astype(int)
            near = (d[:2].sum(axis=0) <= most[0]) & (d.sum(axis=0) <= most[1]) & (5 * np.minimum(size, size[a]) >= 4 * np.maximum(size, size[a])) & (np.minimum(size, size[a]) >= 4)
            pairs += [(a, int(b)) for b in np.flatnonzero(near) if b > a]
        want = roots(pairs, range(n))
        assert len(pairs) > 50
        for block in (32_768, 7):
            monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
            got = {r.u: r.v for r in components.components(simhash.wide_links(df, 0.8, most)).collect()}
            assert {k: got.get(k, k) for k in range(n)} == want, (most, block)


def test_near_duplicates_meet_by_the_range_join(spark, sf, monkeypatch):
    """The pipeline's stage gets its candidates from the range join of fingerprints by segment counts, and from nothing beside it."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "some quite different words that no other text has")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()) == [1, 3]
    asked = []
    real = simhash.wide_links

    def none(sets, *limits):
        asked.extend(sets.select("n", "p0", "p1", "p2", "p3").collect())
        return real(sets, *limits).where("false")

    monkeypatch.setattr(simhash, "wide_links", none)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()) == [1, 2, 3]
    h = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    assert sorted(map(tuple, asked)) == sorted((len(x), *np.array(simhash.wide_print(x), np.uint64).view(np.int64).tolist()) for x in h)


def slow_repeats(rows, window):
    """(bytes, removed, spans, digest) of each (id, text), judged in order of id."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                cut[i : i + window] = b"\1" * window
            seen.add(raw[i : i + window])
        kept = bytes(x for x, c in zip(raw, cut, strict=True) if not c)
        out.append((len(raw), sum(cut), sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_by_hand(spark, monkeypatch):
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcdé ", k=rng.randint(90, 260))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passage), "".join(rng.choices("xyzw ", k=rng.randint(1, 120))), "q" * 150]) for _ in range(rng.randint(0, 5))) for _ in range(120)] + [None, "", "a" * 1000, "ab" * 400]
    rows = list(enumerate(texts))
    want = slow_repeats(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, bucket, batch in ((1 << 24, 1 << 24, 1 << 18), (2000, 3000, 700)):
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(suffixes, "BATCH_BYTES", batch)
        monkeypatch.setattr(suffixes, "SLICE", max(400, chunk // 16))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(df.repartition(5)).collect()}
        assert [got[i] for i, _ in rows] == want


def test_suffix_order():
    rng = random.Random(6)
    for k in range(40):
        strings = [bytes(rng.choices(b"ab" if k % 2 else b"abcdef\x00", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 30))]
        sizes = np.array(list(map(len, strings)))
        _, common = suffixes.collection_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes), sizes)
        order = sorted(s[i:] for s in strings for i in range(len(s) + 1))
        want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(order, order[1:], strict=False)]
        assert common.tolist() == want


def test_hot_minimiser(spark):
    """Very many different strings around one passage: cut finer, with the same result."""
    rng = random.Random(9)
    shared = "the only passage that all of these short texts have in common is this one here"
    texts = ["".join(rng.choices("abcdefgh ", k=40)) + shared + rng.choice(["", "x", "yz"]) + "".join(rng.choices("abcdefgh ", k=rng.choice([5, 40]))) for _ in range(1300)]
    texts += [t[: 60 + k % 90] + "é" for k, t in enumerate(texts[:200])]
    rows = list(enumerate(texts))
    want = slow_repeats(rows, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i, _ in rows] == want and any(r for _, r, _, _ in want)


def test_finer():
    """Equal windows of two strings of one minimiser get equal seeds; each window is in one part."""
    rng = np.random.default_rng(2)
    seen = {}
    for _ in range(300):
        raw = b"left " * int(rng.integers(8)) + b"zqpassage" * 12 + bytes(rng.integers(97, 100, 60).astype(np.uint8))
        off = np.array([0, len(raw)])
        _, start, n, seed, *_ = suffixes.strings_of(np.frombuffer(raw, np.uint8), off, 100, 32)
        for s, k, h in zip(start.tolist(), n.tolist(), seed, strict=True):
            string = raw[s : s + k + 99]
            parts = suffixes.finer(string, int(h.view(np.int64)), 100, 32)
            windows = [(lo + i, new) for lo, hi, new in parts for i in range(hi - lo - 99)]
            assert sorted(at for at, _ in windows) == list(range(k))
            for at, new in windows:
                assert seen.setdefault((int(h), string[at : at + 100]), new) == new


def test_string_hashes():
    """A string's second hash is 32 bits of XXH3 of its bytes, equal bytes have equal first hashes; texts too short for a window have no strings."""
    raw = np.random.default_rng(4).integers(97, 100, 700).astype(np.uint8)
    raw[400:700] = raw[50:350]
    d, start, n, seed, string, other = suffixes.strings_of(raw, np.array([0, 50, 400, 700]), 100, 32)
    base, firsts = np.array([0, 50, 400]), {}
    for k in range(len(d)):
        at = base[d[k]] + start[k]
        body = raw[at : at + n[k] + 99].tobytes()
        assert int(other[k]) == xxhash.xxh3_64_intdigest(body) & 0xFFFFFFFF
        assert firsts.setdefault(body, (seed[k], string[k])) == (seed[k], string[k])
    assert n[d == 1].sum() == 251 and n[d == 2].sum() == 201 and 0 not in d and len(firsts) < len(d)
    assert [len(x) for x in suffixes.strings_of(raw, np.array([0, *range(99, 700, 99), 700]), 100, 32)] == [0] * 6


def test_may_repeat():
    """No string that shares a window with another is left out; strings that share the minimiser alone are."""
    rng = np.random.default_rng(8)
    common = rng.integers(97, 123, 40).astype(np.uint8)
    raws = [np.concatenate([rng.integers(97, 123, 90).astype(np.uint8), common, rng.integers(97, 123, 90).astype(np.uint8)]) for _ in range(40)]
    raws += [np.concatenate([r[: 150 + i], rng.integers(97, 123, 60).astype(np.uint8)]) for i, r in enumerate(raws[:12])]
    raws += [np.concatenate([rng.integers(97, 123, 60).astype(np.uint8), r[70 - i :]]) for i, r in enumerate(raws[12:24])]
    off = np.cumsum([0, *map(len, raws)])
    d, start, n, seed, *_ = suffixes.strings_of(np.concatenate(raws), off, 100, 32)
    by = np.argsort(seed, kind="stable")
    bodies = [raws[d[i]][start[i] : start[i] + n[i] + 99] for i in by]
    sizes = np.array(list(map(len, bodies)))
    kept = suffixes._may_repeat(np.concatenate(bodies), np.cumsum(sizes), sizes, seed[by].view(np.int64), 100, 32)
    seen = Counter(w for b in bodies for w in {b[i : i + 100].tobytes() for i in range(len(b) - 99)})
    shares = [any(seen[b[i : i + 100].tobytes()] > 1 for i in range(len(b) - 99)) for b in bodies]
    assert any(shares) and all(k for k, share in zip(kept, shares, strict=True) if share)
    alone = [not k for k, h in zip(kept, seed[by], strict=True) if Counter(seed.tolist())[int(h)] > 1]
    assert any(alone)
    none = np.zeros(0, np.int64)
    assert not len(suffixes._may_repeat(np.zeros(0, np.uint8), none, none, none, 100, 32))


def test_hash_collisions():
    """Strings that share the first hash and not the second are never taken for copies."""
    seed, string, other = np.array([7, 7, 7, 7], np.uint64), np.array([1, 1, 1, 1], np.uint64), np.array([5, 6, 5, 5], np.uint64)
    order, new, kinds = suffixes._first_copies(seed, string, other, np.array([10, 20, 30, 40]))
    copies = order[~new].tolist()
    assert copies == [3] and (kinds > 1).all()  # the third stays for the suffix order


def slow_text(raw, runs):
    """The text without characters that lie in a run whole."""
    out, at = [], 0
    for c in raw.decode():
        size = len(c.encode())
        if not any(lo <= at and at + size <= hi for lo, hi in runs):
            out.append(c)
        at += size
    return "".join(out)


def test_whole_characters():
    raw = "aéß字x".encode()
    for lo in range(len(raw)):
        for hi in range(lo + 1, len(raw) + 1):
            runs = suffixes.whole_characters(raw, [(lo, hi)])
            assert b"".join(raw[a:b] for a, b in zip([0, *(h for _, h in runs)], [*(x for x, _ in runs), len(raw)], strict=True)).decode() == slow_text(raw, [(lo, hi)])


def test_removed(spark):
    rows = [(1, "é" + "y" * 99 + "z", "a", 3, "o", 7, None), (2, "w" + "é" + "y" * 99 + "q", "a", 5, "p", 8, 1.5), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, kept_text string, N_removed int, n_spans double")
    out = suffixes.removed(df)
    assert out.columns == df.columns
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got[1] == rows[0] and got[3] == rows[2]
    assert got[2] == (2, "wq", "a", 2, "p", 8, 1.5)
    assert suffixes.removed(df.limit(0)).columns == df.columns


def test_repeats_edges(spark, edge, empty):
    out = suffixes.repeats(edge, as_text=True).collect()
    assert len(out) == len(edge_rows())
    long = next(r for r in out if r.doc_id == 5)
    assert long.n_removed == long.n_bytes - 18 and len(long.kept_text) == 18  # one period stays
    assert next(r for r in out if r.doc_id == 2).kept_text is None
    twice = spark.createDataFrame([(1, "z" * 40 + "x" * 130), (1, "z" * 40 + "x" * 130), (None, "x" * 120)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixes.repeats(twice).collect())
    assert got == [("1", 129), ("1", 129), ("None", 120)]
    assert suffixes.repeats(empty).count() == 0


def test_embeddings_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 8))
    x = [(centre[rng.integers(12)] + rng.standard_normal(8) * rng.choice([0, 0.05, 0.12])).astype(np.float32).tolist() for _ in range(400)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(x)]
    rows += [(400, x[0], None), (401, None, 1), (402, [0.0] * 8, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [1.0] * 7, 1), (405, [None] + [1.0] * 7, 1), (406, [1.0], 1), (407, [], 1), (None, x[1], rows[1][2]), (408, x[1], rows[1][2])]
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs, links = [], Counter()
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.98:
                    pairs.append((a, b))
                    links.update((a, b))
    top = roots(pairs, range(len(rows)))
    low = {}
    for k, r in top.items():
        if rows[k][0] is not None:
            low[r] = min(low.get(r, 1 << 60), rows[k][0])
    want = sorted((str(rows[k][0]), links[k], low.get(top[k])) for k in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile in (2048, 16):
        got = embeddings.link(df, tile=tile).collect()
        assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.link(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((200, 64)), rng.standard_normal((200, 64))
    b[:100] = a[:100] + rng.standard_normal((100, 64)) * 0.15
    i, j = embeddings.near_pairs(a, b, 0.98)
    cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(cos >= 0.98)), strict=True))


def slow_scores(texts, order):
    words = [(t or "").encode().split() for t in texts]
    tables = [Counter(tuple(d[i : i + k]) for d in words for i in range(len(d) - k + 1)) for k in range(1, order + 1)]
    n, out = sum(tables[0].values()), []
    for d in words:
        s, single = 0.0, 0
        for i, w in enumerate(d):
            most = min(order, i + 1)
            k = next((k for k in range(most, 1, -1) if tables[k - 1][tuple(d[i - k + 1 : i + 1])] >= 2), 1)
            s += (most - k) * math.log(0.4)
            s += math.log(tables[k - 1][tuple(d[i - k + 1 : i + 1])] / tables[k - 2][tuple(d[i - k + 1 : i])]) if k > 1 else math.log(tables[0][w,] / n)
            single += k == 1
        out.append((len(d), single, s))
    return out


def test_backoff_by_hand(spark, edge, empty):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["the", "of", "a", "rust", "é", "x,"], k=rng.randint(0, 50))) for _ in range(150)] + [None, "", " \x0b", "\x85one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for d, chunk, order in ((df.repartition(3), 1 << 24, 3), (df, 300, 3), (df, 300, 2), (df, 1000, 4), (df, 1000, 1)):
        got = {r.doc_id: r for r in backoff.score(d, chunk_bytes=chunk, order=order).collect()}
        for k, (n, single, s) in enumerate(slow_scores(texts, order)):
            assert (got[k].n_words, got[k].n_backoff) == (n, single) and got[k].log_score == pytest.approx(s, abs=2e-6)
    assert len(backoff.score(edge).collect()) == len(edge_rows())
    assert len(backoff.score(edge, keep=[]).collect()) == len(edge_rows())
    assert backoff.score(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    line = lambda r, names: tuple(str(r[i]) for i in sorted(range(len(names)), key=names.__getitem__))
    assert sorted(line(r, df.columns) for r in df.collect()) == sorted(line(r, columns) for r in cursor.fetchall())


def slow_runs(rows, window):
    """Maximal removed runs of each (id, text), judged in order of id."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                cut[i : i + window] = b"\1" * window
            seen.add(raw[i : i + window])
        out.append([m.span() for m in re.finditer(b"\1+", bytes(cut))])
    return out


def slow_mix(rows):
    """How often each row comes: targets dealt again and again, draws from MD5."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in rows.items()}
    sources = sorted({r.source for r in rows.values()}, key=lambda x: (x is None, x or ""))
    total = [sum(n for i, n in words.items() if rows[i].source == x) for x in sources]
    rate = {x: t / n if n else 0.0 for x, t, n in zip(sources, fill(total), total, strict=True)}
    out = {}
    for i, r in rows.items():
        digest = "null" if r.text is None else hashlib.md5(r.text.encode()).hexdigest()
        u = int(hashlib.md5(f"7:{i}:{digest}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = math.floor(rate[r.source]) + (u < rate[r.source] % 1)
    return out


def test_pipeline(spark, sf):
    """Each stage against what a brute-force version makes of the stage's own input, and run() against the stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    weights, cuts = ordinal.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    features = ordinal.Features()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs, corpus_pipeline.stash(stage(spark, docs, sf))
        assert after.columns == columns, name
        old, new = {r.doc_id: r for r in before.collect()}, after.collect()
        ids = sorted(old)
        if name == "quality":
            score = {i: sum(np.float32(weights[a]) * b for a, b in zip(*features(r.text or ""), strict=True)) for i, r in old.items()}
            sure = [i for i in ids if abs(score[i] - cuts[-1]) > 1e-4]
            assert sorted({r.doc_id for r in new} & set(sure)) == [i for i in sure if score[i] >= cuts[-1]] and len(new) < len(ids)
        if name == "near_duplicates":
            top = roots(slow_similar([(i, r.text) for i, r in old.items()]), ids)
            assert sorted(r.doc_id for r in new) == [i for i in ids if top[i] == i]
        if name == "repeated_passages":
            got = {r.doc_id: r for r in new}
            for i, runs in zip(ids, slow_runs([(i, old[i].text) for i in ids], 100), strict=True):
                want = slow_text(old[i].text.encode(), runs)
                assert (got[i].text, got[i].n_chars) == (want, len(want) if want != old[i].text else old[i].n_chars)
        if name == "mix":
            assert Counter(r.doc_id for r in new) == +Counter(slow_mix(old))
        if name != "repeated_passages":
            assert all(tuple(r) == tuple(old[r.doc_id]) for r in new)  # rows pass unchanged
        docs = after
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    ref = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        got = ref.encode_ordinary(r.text or "")
        want.append((r.doc_id, r.source, len(got), hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    out = corpus_pipeline.run(spark, sf).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_pipeline_edges(spark, sf):
    """Nulls, empty texts, repeated rows, an empty table and clashing names in every stage that returns documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_removed int, fingerprint string, size int, KEPT_TEXT double"
    text = "several plain words in a row that nothing rejects at all " * 4
    rows = [(1, text, "en", "a", len(text), "x", 1, "f", 2, 0.5), (None, None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "y", 2, "g", 3, 1.5), (2, "", "en", "a", 0, "y", 2, "g", 3, 1.5), (3, text + "more", None, "b", 9, "z", 4, "h", 5, 2.5)]
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            if name != "tokens":
                assert out.columns == docs.columns, name
                if name != "repeated_passages":
                    assert all(tuple(r) in rows for r in got), name
                else:
                    assert len(got) == n and all(r.n_removed == q[6] and r.kept == q[5] for r in got for q in rows if q[0] == r.doc_id)
            else:
                assert len(got) == n
            if name == "near_duplicates" and n:
                assert sorted(str(r.doc_id) for r in got) == ["1", "2"]  # wordless texts are one class, the smallest id stays
