"""Operators that judge rows one by one, and the native ones: edge cases and brute-force versions."""

import hashlib
import math
import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, divergence, licences, mixing, ordinal, queries, sharding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, N_TOKENS int"


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    long = "lorem ipsum dolor " * 30_000
    return [(1, "plain words here", "en", "a", "k", 1), (2, None, None, None, None, None), (None, "no id", "en", "a", None, 2), (3, "", "en", "b", "k", 3), (4, " \t\n\x0b", "de", "b", "k", 4), (5, long, "en", "c", "k", 5), (6, "same", "en", "a", "k", 6), (6, "same", "en", "a", "k", 6), (7, "é😀ß x\x00y", "fr", "c", "k", 7)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken(codec):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng, tokens = random.Random(5), list(codec.ranks)
    texts = ["", "a" * 5000, " " * 3000, "=-" * 2000, "naïve 日本語 \x1c\x85 <|endoftext|>"]
    texts += [b"".join(rng.choices(tokens, k=rng.randint(1, 8))).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["".join(rng.choices("ab 1é\n", k=rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_new_words_share_a_pass(codec, monkeypatch):
    """The automaton runs once a text over its short unknown pre-tokens, not once for each; memos that turn over change nothing."""

    class Counted:
        def __init__(self, inner):
            self.inner, self.passes = inner, 0

        def iter_long(self, chars):
            self.passes += 1
            return self.inner.iter_long(chars)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    rng = random.Random(11)
    text = " ".join("".join(rng.choices(["tion", "th", "éê", "Ā", "日", "er", "ing", "q"], k=rng.randint(1, 9))) for _ in range(2000))
    text += " " + "thingé" * 40 + " " + "a" * 64 + " " + "b" * 65 + "\n \x1c" + "=-" * 200
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    own = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    own.automaton = Counted(own.automaton)
    assert own.encode(text) == ref.encode_ordinary(text)
    assert own.automaton.passes == 1
    monkeypatch.setattr(bpe, "WORD_MEMO", 300)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 40, raising=False)
    for t in (text, text[::-1], text):
        assert own.encode(t) == ref.encode_ordinary(t)
    assert sum(map(len, own.words.values())) <= 300


def test_bpe_edges(spark, edge, empty, codec):
    got = bpe.encode_texts(edge, RANKS, public_tokenizers.PATTERN, ids=True)
    assert [c for c in got.columns if c.lower() == "n_tokens"] == ["n_tokens"]  # the clashing one is replaced
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    for r, (_, text, *_rest) in zip(sorted(rows, key=str), sorted(rows, key=str), strict=True):
        del text
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest() and r.n_tokens == len(r.token_ids)
    assert bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices(["a ", "b ", "c\n", "\n", "#", "é", "\x0b", "\xa0", "b a c\n"], k=rng.randint(0, 60)))
        assert divergence.base_counts(t)[:5] == base_by_hand(t), repr(t)


def test_divergence(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ref = divergence.references(docs)
    for lang, (classes, place, words) in ref.items():
        texts = [r.text or "" for r in docs.where(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")) == lang).collect()]
        assert (sum(divergence.class_counts(t) for t in texts) == classes).all()
        every = [w for t in texts for w in divergence.plain_words(t.encode())]
        counts = {w: every.count(w) for w in set(every)} if len(every) < 60_000 else None
        assert words.sum() == len(every)
        if counts:
            assert {w for w, n in counts.items() if w and n >= divergence.LEAST_SHARE * len(every)} == set(place)
    assert divergence.distance(np.array([1, 0]), np.array([0, 1])) == 1.0
    assert divergence.distance(np.array([2, 2]), np.array([1, 1])) == 0.0
    got = divergence.judge(edge).collect()
    assert len(got) == len(edge_rows()) and {r.base_failed for r in got if r.doc_id != 5} == {True}
    assert divergence.judge(empty).count() == 0


def slow_distance(p, q):
    """By the definition, from shares."""
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    h = lambda d: -sum(x * math.log2(x) for x in d if x)
    return math.sqrt(max(0.0, h([(a + b) / 2 for a, b in zip(p, q, strict=True)]) - (h(p) + h(q)) / 2))


def slow_class(c):
    kind = unicodedata.category(c)
    if c in "\t\n\x0b\x0c\r ":
        return 0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 2 if c.islower() else 3
    for k, chars in ((6, "#*$%&|<>"), (7, ".,;:'\"()-"), (8, "!?")):
        if c in chars:
            return k
    return 9 if ord(c) > 65535 else 1 if kind == "Nd" else 5 if kind == "Lu" else 4 if kind[0] in "LM" else 9


def test_divergence_verdict(spark, sf):
    """Distances and the verdict against histograms made by hand, with the references of the whole table."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows += [r for r in spark.createDataFrame([(900, "%|&# " * 80 + "word " * 60, "en"), (901, "zq xv " * 70, None), (902, "die der " * 90, "")], "doc_id long, text string, lang string").collect()]
    strip = lambda t: [w.strip(b".,;:'\"()-!?") for w in (t or "").encode().lower().split()]
    classes, words = {}, {}
    for r in rows:
        classes.setdefault(r.lang, Counter()).update(map(slow_class, r.text or ""))
        words.setdefault(r.lang, Counter()).update(strip(r.text))
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence.judge(df).collect()}
    seen = set()
    for r in rows:
        t, g = r.text or "", got[r.doc_id]
        n, chars, *_, repeat = base_by_hand(t)
        by_class = by_word = None
        if chars >= 200:
            own = Counter(map(slow_class, t))
            by_class = slow_distance([own[k] for k in range(10)], [classes[r.lang][k] for k in range(10)])
        if n >= 100:
            all_words = sum(words[r.lang].values())
            common = sorted(w for w, k in words[r.lang].items() if w and k >= 0.004 * all_words)
            own, ref = Counter(strip(t)), words[r.lang]
            hist = lambda c: [c[w] for w in common] + [sum(c.values()) - sum(c[w] for w in common)]
            by_word = slow_distance(hist(own), hist(ref))
        for want, have in ((by_class, g.class_distance), (by_word, g.word_distance)):
            assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-6)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (g.base_failed, g.kept) == (failed, not failed and (by_class or 0) <= 0.25 and (by_word or 0) <= 0.32)
        seen.add((g.base_failed, g.kept))
    assert (False, True) in seen and (True, False) in seen
    known = divergence.references(df.where("lang = 'en'"))
    other = {r.doc_id: r for r in divergence.judge(df, known=known).collect()}
    assert all(other[r.doc_id].class_distance == got[r.doc_id].class_distance for r in rows if r.lang == "en")
    assert all(not other[r.doc_id].class_distance for r in rows if r.lang == "de")


def test_divergence_parts_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, divergence.judge(docs.repartition(n), keep=["doc_id"]).collect())) for n in (1, 5))
    assert a == b


def test_ordinal_by_hand():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(400):
        g = int(rng.integers(3))
        rows.append((np.array([7, 8 + g, 20 + int(rng.integers(40))]), np.ones(3)))
        grades.append(g)
    w, t = ordinal.fit(rows, np.array(grades), least_z=2)
    assert t[0] < t[1]
    s = np.array([w[i] @ v for i, v in rows])
    assert s[np.array(grades) == 0].mean() < s[np.array(grades) == 1].mean() < s[np.array(grades) == 2].mean()
    w, t = ordinal.fit([], np.array([]))
    assert not w.any() and t[0] < t[1]


def test_ordinal_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 4 <> 0"))
    held = ordinal.score(docs.where("doc_id % 4 = 0"), model, keep=["doc_id"]).join(labels, "doc_id")
    share = {(r.quality, r.toxic): r.k for r in held.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1, 0] > 0.93 and share[0, 0] < 0.05 and share[1, 1] < 0.3


def test_ordinal_fits_off_the_driver(spark, sf, monkeypatch):
    """The driver gets one row of weights and thresholds, those of a fit made here by hand, however many rows are labelled."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    text, features = {r.doc_id: r.text or "" for r in docs.collect()}, ordinal.Features()
    rated = sorted((r.doc_id, 0 if r.quality == 0 else 1 if r.toxic == 1 else 2) for r in labels.collect() if r.doc_id in text and None not in (r.quality, r.toxic))
    want = ordinal.fit([(a.astype(np.int32), b.astype(np.float32)) for a, b in (features(text[i]) for i, _ in rated)], np.array([g for _, g in rated]), least_z=2)
    asked, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: asked.append(real(self)) or asked[-1])
    w, t = ordinal.train(docs, labels, least_z=2)
    assert len(rated) > 50 and np.count_nonzero(w) and np.array_equal(w, want[0]) and np.array_equal(t, want[1])
    assert list(map(len, asked)) == [1] and sum(map(len, asked[0][0])) == 12 * np.count_nonzero(w) + t.nbytes


def test_ordinal_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (5, None, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = ordinal.rejected_removed(edge, labels)
    assert got.columns == edge.columns
    got.collect()
    assert ordinal.rejected_removed(empty, labels).count() == 0
    none = ordinal.rejected_removed(edge, labels.limit(0))
    assert none.count() == len(edge_rows())  # nothing to fit: nothing is rejected
    scored = ordinal.score(edge, ordinal.train(edge, labels)).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in scored)


def test_fit_against_plain_descent():
    """The fit reaches the likelihood that plain gradient descent with numeric slopes reaches on the same rows."""
    rng = np.random.default_rng(5)
    n, grades = 240, rng.integers(0, 3, 240)
    rows = []
    for g in grades:
        present = [k for k in range(4) if rng.random() < (0.15 + 0.5 * (k < 2 - g))]
        rows.append((np.array(present, int), np.ones(len(present))))
    penalty = 1e-3
    w, t = ordinal.fit(rows, grades, steps=3000, rate=0.05, penalty=penalty, least_rows=1, least_z=-1e9)
    x = np.zeros((n, 4))
    for k, (i, _) in enumerate(rows):
        x[k, i] = 1
    share = (1 / np.bincount(grades, minlength=3))[grades]
    share /= share.sum()

    def loss(p):
        cut = np.concatenate([[-np.inf], [p[4], p[4] + np.exp(p[5])], [np.inf]])
        s = x @ p[:4]
        up, low = 1 / (1 + np.exp(-(cut[grades + 1] - s))), 1 / (1 + np.exp(-(cut[grades] - s)))
        return -(share * np.log(up - low)).sum() + penalty / 2 * (p[:4] ** 2).sum()

    p = np.array([0, 0, 0, 0, -1.0, 0.0])
    for _ in range(4000):
        slope = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(6) * 1e-5])
        p -= 0.5 * slope
    assert t[0] < t[1]
    own = loss(np.concatenate([w[:4], [t[0], np.log(t[1] - t[0])]]))
    assert abs(own - loss(p)) < 1e-4
    assert np.allclose(w[:4], p[:4], atol=0.05)


def test_scores_by_hand(spark):
    """Expected grade and tail probability from weights and thresholds, over whole texts and whole tokens."""
    features = ordinal.Features()
    texts = ["good plain words here", None, "", "a" * 70 + "9", "a" * 70 + "Z", "x x x x\nx x x x"]
    rng = np.random.default_rng(1)
    w, t = rng.standard_normal(ordinal.SIZE), np.array([-0.5, 0.7])
    got = ordinal.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (w, t)).collect()
    for r in got:
        i, v = features(r.text or "")
        s = sum(np.float32(w[a]) * b for a, b in zip(i, v, strict=True))
        above = [1 - 1 / (1 + math.exp(-(x - s))) for x in t]
        assert r.expected_grade == pytest.approx(sum(above), abs=1e-5) and r.tail_probability == pytest.approx(above[1], abs=1e-5)
        assert r.kept == (r.tail_probability >= 0.5)
    shapes = [set(features(x)[0].tolist()) & set(range(ordinal.WORDS, ordinal.WORDS + ordinal.SHAPES)) for x in texts[3:5]]
    assert shapes[0] != shapes[1]  # the end of a long token counts


def test_fit_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "bad")] * 500 + [(1, "else")] * 500 + [(2, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    w, t = ordinal.train(docs, labels, least_rows=1)
    again, _ = ordinal.train(docs.repartition(7), labels, least_rows=1)
    assert np.array_equal(w, again) and t[0] < t[1]


def test_licences(spark, edge, empty):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n'
    mit = "MIT License\nPermission is hereby granted, free of charge, to any person"
    rows = [(1, f"x\n{apache}Released under the MIT License."), (2, mit), (3, "Neither."), (4, None), (5, "All rights reserved. Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Apache-2.0,MIT", 0), 2: ("MIT", 0), 3: ("", 0), 4: ("", 0), 5: ("CC-BY-NC-4.0", 0)}
    assert len(licences.scan(edge).collect()) == len(edge_rows()) and licences.scan(empty).count() == 0


def test_every_licence_rule_fires(spark):
    """Each sentence and each rule, plain, wrapped and commented, with notices and numbers between the sentences."""
    first = {}
    for sentence, ident in licences.SENTENCES.items():
        first.setdefault(ident, sentence)
    rows, want = [], {}
    for ids, name in licences.RULES:
        lines = [first[i] for i in ids]
        forms = [lines, ["\n * ".join(textwrap.wrap(s, 30, break_long_words=False, break_on_hyphens=False)) for s in lines], ["\n".join("// " + x for x in textwrap.wrap(s, 70, break_on_hyphens=False)) for s in lines], [x for k, s in enumerate(lines) for x in (f"{k + 1}. {s}", "Copyright (c) 2020 A. Name")]]
        for form in forms:
            rows.append((len(rows), "Some prose without a stop\n" + "\n".join(form) + "\n\nMore prose: it goes on"))
            want[len(want)] = (" ".join(ids), name, 0)
    for sentence, ident in licences.SENTENCES.items():
        rows.append((len(rows), f"x\n{sentence}\ny"))
        want[len(want)] = ident
    got = {r.doc_id: (r.licence_sentences, r.licences, r.n_unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    wrong = {k: (g, want[k], rows[k][1]) for k, g in got.items() if (g if isinstance(want[k], tuple) else g[0]) != want[k]}
    assert len(got) == len(want) and not wrong
    # a blank line, or words before or after in the same sentence, part a known sentence
    none = spark.createDataFrame([(1, "SPDX-License-Identifier:\n\nMIT"), (2, "It is MIT License"), (3, "MIT License|x"), (4, "SPDX-License-Identifier: MIT or so")], "doc_id long, text string")
    assert {r.licences for r in licences.scan(none).collect()} == {""}


def test_unknown_sentences_part_a_run(spark):
    perm, notice, asis = (next(s for s, i in licences.SENTENCES.items() if i == x) for x in ("BSDPre", "BSDSource", "BSDBinary"))
    rows = [(1, f"{perm} {notice} {asis}"), (2, f"{perm} Something else. {notice} {asis}"), (3, f"{perm}\n1. {notice}\n\n2. {asis} All rights reserved.")]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("BSD-2-Clause", 0), 2: ("", 3), 3: ("BSD-2-Clause", 0)}


def test_whole_licence_texts(spark):
    """Texts as they stand in files, wrapped by hand."""
    mit = """The MIT License (MIT)

Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    apache = """# Copyright 2021 The Authors. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
    gpl = """/* This program is free software; you can redistribute it and/or modify it
 * under the terms of the GNU General Public License as published by the Free
 * Software Foundation; either version 2 of the License, or (at your option)
 * any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT
 * ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
 * FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for
 * more details. */
"""
    rows = [(1, mit), (2, apache), (3, gpl), (4, mit + "\n" + gpl), (5, "SPDX-License-Identifier: MIT")]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("GPL-2.0-or-later", 0), 4: ("MIT,GPL-2.0-or-later", 0), 5: ("MIT", 0)}


def fill(words, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by dealing the excess again and again."""
    total = share * sum(words)
    w = [weights[i % 3] for i in range(len(words))]
    target, full = [0.0] * len(words), set()
    while True:
        left, open_ = total - sum(cap * words[i] for i in full), [i for i in range(len(words)) if i not in full]
        level = left / sum(w[i] for i in open_) if open_ else 0
        over = [i for i in open_ if level * w[i] > cap * words[i]]
        if not over:
            for i in range(len(words)):
                target[i] = cap * words[i] if i in full else level * w[i]
            return target
        full |= set(over)


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 9):
        words = [rng.choice([0, 3, 50, 1000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i}" if i < n - 1 else None, x) for i, x in enumerate(words)], "src string, words long")
        got = {r.src: r.target for r in mixing.source_targets(df).collect()}
        want = fill(words) if sum(words) else [0.0] * n
        assert [got[f"s{i}" if i < n - 1 else None] for i in range(n)] == pytest.approx([0.0 if not x else t for x, t in zip(words, want, strict=True)])


def test_mix_draws_by_row(spark):
    """A source whose rows share an id comes near its target; equal rows draw alike."""
    rows = [(None, f"some words number {k}", "a") for k in range(4000)] + [(1, "other words", "b")] * 3000
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(plan) == 7000
    a = [r for r in plan if r.source_size == 16000]
    assert abs(sum(r.taken for r in a) - a[0].target) < 0.03 * a[0].target
    assert len({r.copies for r in plan if r.source_size == 6000}) == 1


def test_mix(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.plan_mix(docs).collect()
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in plan)
    mixed = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert mixed == {r.doc_id: r.copies for r in plan if r.copies}
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()), key=str)
    assert len(mixing.plan_mix(edge).collect()) == len(edge_rows())
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(edge).count() >= 0
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_sharding(spark, sf, edge, empty, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    def run(d):
        return sharding.assign(d, bucket_bytes=4000)

    rows = run(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert sum(map(len, by.values())) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in run(docs.repartition(5)).collect()}
    assert len({r.bucket for r in rows}) > 1
    assert len(run(edge).collect()) == len(edge_rows()) and run(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), bucket_bytes=4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16


def slow_shard(ident, shards):
    def step(h, value, size):
        return xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)

    signed = lambda x: x - (x >> 63 << 64)
    best = []
    for s in range(shards):
        h = step(step(42, 11, 4), s, 4)
        best.append((signed(h if ident is None else step(h, ident, 8)), s))
    return max(best)[1]


def test_shards_by_hand(spark):
    """Shard and further shard from hashes computed apart; null ids, hot equal rows and hot shards stay in small buckets."""
    rows = [(k, "t" * (k % 50)) for k in range(600)] + [(None, f"n{k}") for k in range(2000)] + [(7, "same")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.assign(df, bucket_bytes=2000).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows)
    size, slots = Counter(), {}
    for r in got:
        assert (r.shard, r.grown_shard) == (slow_shard(r.doc_id, 16), slow_shard(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
        size[r.shard, r.bucket] += len(r.text) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size.values()) < 5000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_query_moves_whole_records(spark, sf, monkeypatch):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in queries.op4_sharding(spark, sf).collect()} == want
    assign, lost = sharding.assign, min(docs)
    monkeypatch.setattr(sharding, "assign", lambda df, **k: assign(df, **k).withColumn("text", F.when(F.col("doc_id") != lost, F.col("text"))))
    got = {r.doc_id: (r.size, r.text_crc32) for r in queries.op4_sharding(spark, sf).collect()}
    assert got == want | {lost: (1, 0)}  # a text lost in a shard shows


def test_queries_have_their_contract_columns(spark, sf):
    want = {
        "op1": {"doc_id", "expected_grade", "tail_probability", "kept"}, "op2": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op3": {"vec_id", "n_links", "component_id", "kept"},
        "op4": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op5": {"doc_id", "licences"}, "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7": {"doc_id", "size", "source_size", "target", "taken"}, "op8": {"doc_id", "fingerprint", "component_id"}, "op9": {"doc_id", "log_score"}, "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    assert {n.split("_")[0] for n in queries.QUERIES} == set(want)
    for name, f in queries.QUERIES.items():
        df = f(spark, sf)
        assert want[name.split("_")[0]] <= set(df.columns), name
        assert df.count() == spark.read.parquet(f"{sf}/{'embeddings' if name.startswith('op3') else 'documents'}.parquet").count()
