"""Quality rules by distribution divergence (operator 6).

A document's histogram of character classes and its histogram of common words are compared with those
of its language by Jensen-Shannon distance (base 2, in [0, 1]); short documents are spared by minimum lengths. The
references come from all documents of the language: a word is common if it makes up LEAST_SHARE of the
language's words or more.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lodestone.llm.common import BROADCAST_BYTES, arrow_map, map_texts, stash

#: Classes of characters: the six blanks, symbols, digits, lower and upper ASCII and other letters, stops, outcries, the rest.
BLANKS, SYMBOLS, STOPS, OUTCRIES = "\t\n\x0b\x0c\r ", "#*$%&|<>", ".,;:'\"()-", "!?"
CLASSES = 10
LEAST_SHARE = 0.004
#: Limits of the two distances, and the word characters and words from which each one is looked at.
MOST_CLASS, MOST_WORD, LEAST_CHARS, LEAST_WORDS = 0.25, 0.32, 200, 100
#: Base rules: fewest words, and the highest share of words in repeated three-word windows, in hundredths.
BASE_WORDS, BASE_REPEAT = 50, 50
#: Words of one language after which a task hands on what it has found so far.
FLUSH_WORDS = 2_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; those above the basic plane share the last entry."""
    out = np.full(65537, 9, np.uint8)
    for i in range(65536):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LM":
            out[i] = 5 if kind == "Lu" else 4
        elif kind == "Nd":
            out[i] = 1
    for chars, k in ((BLANKS, 0), (SYMBOLS, 6), (STOPS, 7), (OUTCRIES, 8)):
        out[[ord(c) for c in chars]] = k
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1] = 2, 3
    return out


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes()[np.minimum(points, 65536)], minlength=CLASSES)


def plain_words(raw: bytes) -> list[bytes]:
    """Words in lower case without stops and outcries around them; for comparison with common words only."""
    return [w.strip(b".,;:'\"()-!?") for w in raw.lower().split()]


def base_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, code points."""
    raw = text.encode()
    words = raw.split()
    blanks = sum(map(text.count, BLANKS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b"\t\x0b\x0c\r "):
            seen.add(line)
    repeat = 0
    if len(words) >= 3:
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        pairs = ids[:-1] * len(names) + ids[1:]
        if len(names) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, at, n = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
        hit = n[at] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(hit) + k] |= hit
        repeat = int(covered.sum())
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeat, len(text)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(min(1.0, max(0.0, (part(p) + part(q)) / 2))))


def _tongue(lang: str | None) -> str:
    """Key of a language; null is one of its own."""
    return "null" if lang is None else f"={lang}"


def _tally(df: DataFrame, text: str, lang: str, chosen: dict[str, list[bytes]] | None, least_share: float) -> DataFrame:
    """(lang, kind, key, n). Without `chosen`: class counts and, as candidates, words with least_share of some part of
    the texts (a word with that share of all has it in one part at least). With it: counts of these words."""
    schema = "lang string, kind string, key binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        total: Counter = Counter()
        classes: dict[str, np.ndarray] = {}
        wanted = {k: set(v) for k, v in (chosen or {}).items()}
        out: list[tuple[str, str, bytes, int]] = []

        def flush(tongue: str) -> None:
            c = words.pop(tongue, Counter())
            least = least_share * total[tongue]
            out.extend((tongue, "word", w, n) for w, n in c.items() if chosen is not None or n >= least)
            total[tongue] = 0

        for b in batches:
            for t, name in zip(b.column(0), b.column(1), strict=True):
                text_, tongue = t.as_py() or "", _tongue(name.as_py())
                if chosen is None:
                    got = class_counts(text_)
                    classes[tongue] = classes[tongue] + got if tongue in classes else got
                found = plain_words(text_.encode())
                total[tongue] += len(found)
                if chosen is not None:
                    w = wanted.get(tongue, set())
                    found = [x for x in found if x in w]
                words.setdefault(tongue, Counter()).update(found)
                if chosen is None and total[tongue] >= FLUSH_WORDS:
                    flush(tongue)
        everything = dict(total)
        for tongue in list(words):
            if chosen is not None:
                out.append((tongue, "total", b"", everything[tongue]))
            flush(tongue)
        out.extend((tongue, "class", str(k).encode(), int(n)) for tongue, v in classes.items() for k, n in enumerate(v))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 4, (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "kind", "key", "n"])

    return arrow_map(df.select(F.col(text), F.col(lang)), run, schema).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(df: DataFrame, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By key of the language: class counts, places of its common words, and counts of these and of all other words.

    What reaches the driver is 1 / least_share words a language and part at most; it is refused beyond BROADCAST_BYTES.
    """
    first = stash(_tally(df, text, lang, None, least_share))
    if first.count() * 64 > 8 * BROADCAST_BYTES:
        raise ValueError("too many languages for references held in one place; split the table by language")
    chosen: dict[str, list[bytes]] = {}
    classes: dict[str, np.ndarray] = {}
    for r in first.collect():
        if r.kind == "word":
            chosen.setdefault(r.lang, []).append(bytes(r.key))
        else:
            classes.setdefault(r.lang, np.zeros(CLASSES))[int(r.key)] = r.n
    counts: dict[str, dict[bytes, int]] = {}
    totals: dict[str, int] = {}
    for r in _tally(df, text, lang, chosen, least_share).collect():
        if r.kind == "word":
            counts.setdefault(r.lang, {})[bytes(r.key)] = r.n
        else:
            totals[r.lang] = r.n
    out = {}
    for tongue, c in classes.items():
        n = totals.get(tongue, 0)
        common = sorted(w for w, k in counts.get(tongue, {}).items() if w and k >= least_share * n)
        own = np.array([counts[tongue][w] for w in common] + [0.0])
        own[-1] = n - own.sum()
        out[tongue] = (c, {w: i for i, w in enumerate(common)}, own)
    return out


def judge(df: DataFrame, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE, most_class: float = MOST_CLASS, most_word: float = MOST_WORD, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, known: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    Null text counts as empty (base_failed, not kept); a null language has references of its own. A
    known: references() of a trusted corpus; by default those of df itself. A language that they lack has no distances. A
    distance is null below its minimum length and then decides nothing. Rows are judged one by one, so
    ties, repeated rows and very long texts need nothing special; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(references(df, text, lang, least_share) if known is None else known)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = StructType([StructField(n, LongType()) for n in names] + [StructField("base_failed", BooleanType()), StructField("class_distance", DoubleType()), StructField("word_distance", DoubleType()), StructField("kept", BooleanType())])
    both = next(c for c in ("_judged", "__judged", "___judged") if c not in df.columns)

    def make():
        known = shared.value

        def run(pairs: pa.Array) -> list[pa.Array]:
            rows = []
            for t, name in zip(pairs.field(0), pairs.field(1), strict=True):
                x = t.as_py() or ""
                classes, place, words = known.get(_tongue(name.as_py()), (np.zeros(CLASSES), {}, np.zeros(1)))
                n_words, chars, symbols, dup, repeat, _ = base_counts(x)
                failed = n_words < BASE_WORDS or 100 * repeat > BASE_REPEAT * n_words
                by_class = distance(class_counts(x), classes) if chars >= least_chars else None
                by_word = None
                if n_words >= least_words:
                    get, rest = place.get, len(place)
                    own = np.bincount([get(w, rest) for w in plain_words(x.encode())], minlength=rest + 1)
                    by_word = distance(own, words)
                rows.append((n_words, chars, symbols, dup, repeat, failed, by_class, by_word, not failed and (by_class or 0) <= most_class and (by_word or 0) <= most_word))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            return [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]

        return run

    kept = [c for c in df.columns if keep is None or c in keep]
    return map_texts(df.withColumn(both, F.struct(F.col(text).alias("t"), F.col(lang).alias("l"))), both, schema, make, keep=kept)
