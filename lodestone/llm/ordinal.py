"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 1).

P(grade <= k) = sigmoid(t_k - w.x): one weight vector over hashed text features, shared by all grades, and
ordered thresholds t_0 < t_1 < ... . Fitted by Adam on the mean log-likelihood with an L2 penalty, on a
bounded sample of the labelled rows; scores are computed over every row, whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lodestone.llm.common import arrow_map, map_texts, stash

#: Buckets of hashed words and word beginnings, of hashed token shapes, and the three document features after them.
WORDS, SHAPES, EXTRA = 1 << 17, 1 << 10, 3
#: Lengths of word beginnings that count beside whole words; stems carry over to forms that the sample lacks.
STEMS = (4, 5)
SIZE = WORDS + SHAPES + EXTRA
#: Labelled rows that a fit may use at most; those with the lowest hash of their id.
FIT_ROWS = 12_000
#: Bytes of their texts that a fit may use at most, in the same order.
FIT_BYTES = 128 << 20
GRADES, STEPS, RATE, PENALTY = 3, 400, 0.1, 1e-5
#: A feature takes a weight only if it is in so many rows of the sample, and their mean grade lies so many
#: standard errors below the mean of all: a good document is one without evidence against it, and rare
#: words aren't learnt by heart.
LEAST_ROWS, LEAST_Z = 5, 3.5
MEMO = 100_000


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


class Features:
    """Text -> (indices, values): each distinct word or word beginning counts alike; shapes and repetition count by their share."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def _token(self, t: str) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        word = t.strip(".,;:!?'\"()").lower()
        forms = 0
        for form in (word, *(f"{word[:n]}~" for n in STEMS)):
            forms = forms << 17 | zlib.crc32(form.encode()) % WORDS
        shape = zlib.crc32("".join(k for k, _ in groupby(map(_kind, t))).encode()) % SHAPES
        out = self.memo[t] = forms << 10 | shape
        return out

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        if not tokens:
            return np.array([SIZE - 1]), np.ones(1)
        get = self.memo.get
        packed = np.array([x if (x := get(t)) is not None else self._token(t) for t in tokens], np.int64)
        words = np.unique(np.unique(packed >> 10)[:, None] >> np.arange(0, 17 * (len(STEMS) + 1), 17) & (WORDS - 1))
        shapes, n = np.unique(packed & 1023, return_counts=True)
        repeated = float((packed[1:] == packed[:-1]).mean()) if len(packed) > 1 else 0.0
        lines = [x for x in text.split("\n") if x.strip()]
        index = np.concatenate([words, WORDS + shapes, [WORDS + SHAPES, WORDS + SHAPES + 1]])
        value = np.concatenate([np.full(len(words), 0.25), 4.0 * n / len(packed), [4 * repeated, 4 * (1 - len(set(lines)) / len(lines))]])
        return index, value


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from feature rows and integer grades 0 .. n_grades - 1. Without rows: zeros."""
    w, raw = np.zeros(SIZE), np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    if not rows:
        return w, _ordered(raw)
    y = np.asarray(grades)
    off, spread = y - y.mean(), y.std()
    seen, lower, squares = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    blocks = [(lo, min(lo + 256, len(rows))) for lo in range(0, len(rows), 256)]

    def block(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(lo, hi), [len(i) for i, _ in rows[lo:hi]]), np.concatenate([i for i, _ in rows[lo:hi]]), np.concatenate([v for _, v in rows[lo:hi]]).astype(float)

    for lo, hi in blocks:
        doc, index, value = block(lo, hi)
        seen += np.bincount(index, minlength=SIZE)
        lower += np.bincount(index, value * off[doc], SIZE)  # its variance is that of the grades times the sum of squares
        squares += np.bincount(index, value * value, SIZE)
    telling = (seen >= least_rows) & (lower <= -least_z * spread * np.sqrt(squares)) & (squares > 0)
    parts = [(doc[telling[index]], index[telling[index]], value[telling[index]]) for doc, index, value in (block(lo, hi) for lo, hi in blocks)]
    doc, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    used, at = np.unique(index, return_inverse=True)
    own = np.zeros(len(used))
    share = (1 / np.bincount(y, minlength=n_grades).clip(1))[y]  # grades weigh alike, however rare one is
    share /= share.sum()
    moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, steps + 1):
        score = np.bincount(doc, own[at] * value, len(rows))
        t = np.concatenate([[-np.inf], _ordered(raw), [np.inf]])
        upper, lower = _sigmoid(t[y + 1] - score), _sigmoid(t[y] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_w = np.bincount(at, (share * (du - dl))[doc] * value, len(used)) + penalty * own
        g_t = np.array([(share * dl)[y == k + 1].sum() - (share * du)[y == k].sum() for k in range(n_grades - 1)])
        # t_k = raw_0 + exp(raw_1) + ... + exp(raw_k)
        g_raw = np.concatenate([[g_t.sum()], [g_t[k:].sum() * np.exp(raw[k]) for k in range(1, n_grades - 1)]])
        for k, (x, g) in enumerate(((own, g_w), (raw, g_raw))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w[used] = own
    return w, _ordered(raw)


def _ordered(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def grade() -> Column:
    """Graded rating of a labels row: 0 poor, 1 readable but toxic, 2 good; null where a label is missing."""
    return F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", rating: Callable[[], Column] = grade, fit_rows: int = FIT_ROWS, **options) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most fit_rows labelled rows and FIT_BYTES of text (documented bounds; which rows, a hash of the id decides).

    Of documents that share a labelled id the one with the smallest text hash is taken.
    """
    chosen = labels.select(F.col(ident).alias("id"), rating().alias("grade")).where("grade is not null and id is not null")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "grade").limit(fit_rows)
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    so_far = Window.orderBy(F.xxhash64("id"), "id", "grade")  # fit_rows rows at most
    rows = stash(rows).withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far)).where(F.col("bytes") <= FIT_BYTES)

    def run(batches):
        features, seen = Features(), []
        for b in batches:
            for i, x, g in zip(b.column(0).cast(pa.int64()).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                index, value = features(x.as_py() or "")
                seen.append((i, g, index.astype(np.int32), value.astype(np.float32)))
        if seen:
            seen.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
            w, t = fit([r[2:] for r in seen], np.array([r[1] for r in seen], int), **options)
            used = np.flatnonzero(w).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (used, w[used], t)], names=["used", "w", "t"])

    # fitted in the one task that the order brings the rows to: the driver gets the weights, not the features
    got = arrow_map(rows.select("id", "text", "grade").coalesce(1), run, "used binary, w binary, t binary").collect()
    if not got:
        return fit([], np.zeros(0, int), **options)
    w = np.zeros(SIZE)
    w[np.frombuffer(got[0].used, np.int32)] = np.frombuffer(got[0].w)
    return w, np.frombuffer(got[0].t)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Append expected_grade, tail_probability (of the highest grade) and kept (tail_probability >= least).

    Null and wordless texts have one feature of their own and are scored like others. The model (2 MB at
    most, a fixed number of weights) is broadcast. Rows, however long or often repeated, are scored alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    schema = StructType([StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("kept", BooleanType())])

    def make():
        features, (w, t) = Features(), shared.value

        def run(texts: pa.Array) -> list[pa.Array]:
            s = np.zeros(len(texts))
            for k, x in enumerate(texts):
                i, v = features(x.as_py() or "")
                s[k] = w[i] @ v
            above = 1 - _sigmoid(t[None, :] - s[:, None])  # P(grade > k)
            return [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= least)]

        return run

    return map_texts(docs, text, schema, make, keep)


def rejected_removed(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the classifier keeps, columns unchanged."""
    model = train(docs, labels, text, ident)
    own = {c: f"_input_{k}_{c}" for k, c in enumerate(docs.columns) if c.lower() in ("expected_grade", "tail_probability", "kept")}
    kept = score(docs.withColumnsRenamed(own), model, own.get(text, text), **options).where("kept").drop("expected_grade", "tail_probability", "kept")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
