"""Language-model scores by stupid backoff, computed as joins over hash-partitioned count tables (operator 9).

Score of a word after up to ORDER - 1 words: count(n-gram) / count(its context) for the longest n-gram that is in
the table, times BACKOFF for each word of context given up; the word alone scores count(w) / (all words). The
tables of longer n-grams hold those that occur LEAST_COUNT times or more in the corpus; a document's score
is the sum of the logarithms. All counts come from the whole corpus.

Rows of the relations are packed, as single n-grams would be far larger than the texts: rows that follow
each other in the table form a chunk of CHUNK_BYTES; a chunk asks once for each distinct n-gram (with how often it
has it); requests go to buckets of the n-gram's hash, which add up the counts and answer each chunk; chunks
look the answers up. A frequent n-gram is one entry a chunk, so no bucket or chunk is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import Rolling, arrow_map, flat, mix, stash

ORDER, BACKOFF, LEAST_COUNT = 3, 0.4, 2
#: Bytes of text a chunk holds; a document that begins in it may go beyond.
CHUNK_BYTES = 16 << 20
#: Rows of texts that travel packed together.
PACK_BYTES = 4 << 20
#: Texts are hashed in slices of so many bytes; a document is never cut.
SLICE = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PAIR = np.uint64(0x9FB21C651E98DF25)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, documents one after another, and the words of each document."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # True where a document begins
    edge[off] = True
    inside = ~blank
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Rolling(data).of(first, last), np.diff(np.searchsorted(first, off))


def hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_hashes() of slices of the batch, in order."""
    data, off = flat(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        yield word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def grams(words: np.ndarray, n: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `order`: the hash of each n-gram, and the place of its last word; n-grams stay within a document."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    place = np.arange(len(words), dtype=np.int32) - np.repeat(starts.astype(np.int32), n)
    last = words
    yield words, np.arange(len(words))
    for k in range(1, order):
        at = np.flatnonzero(place >= k)
        now = mix(last[at - 1] * _PAIR + words[at] + np.uint64(k))
        yield now, at
        last = np.zeros(len(words), np.uint64)
        last[at] = now


def _planes(x: np.ndarray) -> bytes:
    """An integer array by byte planes, so that the high ones shrink to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes, as differences, and their counts."""
    d = h.copy()
    d[1:] -= h[:-1]
    return pa.compress(_planes(d) + _planes(n.astype(np.uint32)), codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(pa.decompress(raw, decompressed_size=12 * size, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(_from_planes(got[: 8 * size], np.uint64), dtype=np.uint64), _from_planes(got[8 * size :], np.uint32).astype(np.int64)


_REQUEST = "chunk long, bucket int, kind int, size int, body binary"


def _chunks(b: pa.RecordBatch, seen: int, chunk_bytes: int) -> tuple[list[tuple[int, int, int]], int]:
    """(chunk, from, to) of the batch's rows (partition, text, ..), and the bytes of the partition so far.

    A row's chunk follows from the bytes of the rows before it in its partition, however rows come in batches.
    """
    _, off = flat(b.column(1))
    if not b.num_rows:
        return [], seen
    chunk = (b.column(0).to_numpy() << 24) + (seen + off[:-1]) // chunk_bytes
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
    return [(int(chunk[lo]), lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], seen + int(off[-1])


def _digest(words: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(mix(words + np.arange(len(words), dtype=np.uint64))) if len(words) else np.uint64(0)


def _requests(n_buckets: int, order: int, chunk_bytes: int):
    """(partition, text) -> for each chunk packed distinct n-grams (kind: their length less one) for each bucket, and a digest of its words (kind: order)."""
    borders = np.array([-(-(k << 64) // n_buckets) for k in range(1, n_buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, seen = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = np.concatenate([w for w, _ in held])
            sizes = np.concatenate([n for _, n in held])
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([at % n_buckets], pa.int32()), pa.array([order], pa.int32()), pa.array([0], pa.int32()), pa.array([_digest(words).tobytes()], pa.binary())], names=["chunk", "bucket", "kind", "size", "body"])
            for kind, (h, _) in enumerate(grams(words, sizes, order)):
                h, n = np.unique(h, return_counts=True)
                cuts = [0, *np.searchsorted(h, borders).tolist(), len(h)]
                some = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                for k in range(0, len(some), 256):
                    part = some[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at] * len(part), pa.int64()), pa.array([b for b, _, _ in part], pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([hi - lo for _, lo, hi in part], pa.int32()), pa.array([_pack(h[lo:hi], n[lo:hi]) for _, lo, hi in part], pa.binary())],
                        names=["chunk", "bucket", "kind", "size", "body"],
                    )

        for b in batches:
            parts, seen = _chunks(b, seen, chunk_bytes)
            for chunk, lo, hi in parts:
                if at != chunk:
                    if held:
                        yield from flush()
                    at = chunk
                held.extend(hashes(b.column(1).slice(lo, hi - lo)))
        if held:
            yield from flush()

    return run


def _answers(least_count: int, order: int):
    """Requests in order of bucket and kind -> for each one the corpus counts of its n-grams, in its order. Digests pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row(chunk: int, kind: int, bucket: int, size: int, body: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([size], pa.int32()), pa.array([body], pa.binary())], names=["chunk", "bucket", "kind", "size", "body"])

        def flush() -> Iterator[pa.RecordBatch]:
            got = [_unpack(body, size) for _, size, body in held]
            total = np.concatenate([h for h, _ in got])
            by = np.argsort(total, kind="stable")
            total = total[by]
            first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
            sums = np.add.reduceat(np.concatenate([n for _, n in got])[by], first)
            if at[1]:
                sums[sums < least_count] = 0
            counts = np.empty(len(total), np.uint64)
            counts[by] = np.repeat(sums, np.diff(first, append=len(total)))
            lo = 0
            for chunk, size, _ in held:
                yield row(chunk, at[1], at[0], size, pa.compress(_planes(counts[lo : lo + size]), codec="zstd", asbytes=True))
                lo += size

        for b in batches:
            for chunk, bucket, kind, size, body in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == order:
                    yield row(chunk, kind, bucket, size, body)
                    continue
                if at != (bucket, kind):
                    if held:
                        yield from flush()
                    at, held = (bucket, kind), []
                held.append((chunk, size, body))
        if held:
            yield from flush()

    return run


def _texts(order: int, fields: list[str], chunk_bytes: int):
    """(partition, text, rest) -> rows of each chunk, packed with a kind that comes after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.ipc.IpcWriteOptions(compression="zstd")
        seen, k = 0, 0
        for b in batches:
            parts, seen = _chunks(b, seen, chunk_bytes)
            rows = pa.RecordBatch.from_arrays([b.column(1), *b.column(2).flatten()], names=["text", *(fields or ["none"])])
            for chunk, lo, hi in parts:
                while lo < hi:
                    most = lo + 1
                    while most < hi and rows.slice(lo, most - lo).nbytes < PACK_BYTES:
                        most = min(hi, 2 * most - lo)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=zstd) as out:
                        out.write_batch(rows.slice(lo, most - lo))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([k], pa.int32()), pa.array([order + 1], pa.int32()), pa.array([most - lo], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bucket", "kind", "size", "body"])
                    lo, k = most, k + 1

    return run


def _scores(backoff: float, order: int, fields: list[str], schema):
    """Answers, digest, then texts, of each chunk -> n_words, n_backoff (words scored alone), n_full (scored with their whole context) and the sum of logarithms but for the corpus size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answers, docs, digest = None, [[] for _ in range(order)], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [x for body in docs for x in pa.ipc.open_stream(body)]
            hashed = [x for b in rows for x in hashes(b.column(0))]
            words = np.concatenate([w for w, _ in hashed] or [np.zeros(0, np.uint64)])
            n = np.concatenate([k for _, k in hashed] or [np.zeros(0, np.int64)])
            hashed.clear()
            if digest is None or _digest(words) != digest:
                raise RuntimeError("rows met other chunks on the second read; write the table first")
            counts, length = [], np.zeros(len(words), np.int64)  # of the longest n-gram in the tables that ends at each word
            most = np.zeros(len(words), np.int64)
            for kind, (h, place) in enumerate(grams(words, n, order)):
                known, back = np.unique(h, return_inverse=True)
                told = np.concatenate([_from_planes(np.frombuffer(pa.decompress(body, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8), np.uint64) for size, body in answers[kind]] or [np.zeros(0, np.uint64)])
                if len(told) != len(known):
                    raise RuntimeError("a chunk lacks answers")
                answers[kind] = []
                full = np.zeros(len(words))
                full[place] = told[back]
                counts.append(full)
                most[place] = kind + 1
                length[np.flatnonzero(full)] = kind + 1  # parts of an n-gram in a table are in the tables
            with np.errstate(divide="ignore"):
                value = np.log(counts[0]) + (most - 1) * np.log(backoff)
                for k in range(2, order + 1):
                    hit = np.flatnonzero(length == k)
                    value[hit] = np.log(counts[k - 1][hit]) - np.log(counts[k - 2][hit - 1]) + (most[hit] - k) * np.log(backoff)
            doc = np.repeat(np.arange(len(n)), n)
            total = np.bincount(doc, value, len(n))
            single, whole = np.bincount(doc[length == 1], minlength=len(n)), np.bincount(doc[length == order], minlength=len(n))
            lo = 0
            for b in rows:
                hi = lo + b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(i + 1).cast(schema.field(i).type) for i in range(len(fields))), pa.array(n[lo:hi], pa.int64()), pa.array(single[lo:hi], pa.int64()), pa.array(whole[lo:hi], pa.int64()), pa.array(total[lo:hi])], schema=schema)
                lo = hi

        for b in batches:
            for chunk, kind, size, body in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if at != chunk:
                    if docs:
                        yield from flush()
                    at, answers, docs, digest = chunk, [[] for _ in range(order)], [], None
                if kind < order:
                    answers[kind].append((size, body))
                elif kind == order:
                    digest = np.frombuffer(body, np.uint64)[0]
                else:
                    docs.append(body)
        if docs:
            yield from flush()

    return run


def score(df: DataFrame, text: str = "text", keep: list[str] | None = None, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns `keep` (default: all but the text), n_words, n_backoff, n_full, log_score (natural, rounded to 6 places) and mean_log (by word).

    n_backoff: words scored by the word alone; n_full: words scored by an n-gram of `order` words. The first
    word of a document has no context and scores count / (all words). Null and wordless texts: 0
    words, score 0.0, mean null. Repeated rows count as often as they stand. Empty table: no rows.
    Kept columns named like a result are dropped. Words and documents of any length are hashed whole.
    """
    if order < 1 or least_count < 1:
        raise ValueError("order and least_count must be 1 at least")
    results = ["n_words", "n_backoff", "n_full", "log_score", "mean_log"]
    fields = [c for c in (df.columns if keep is None else keep) if (keep is not None or c != text) and c.lower() not in results]
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Python" in plan or "InArrow" in plan:
        df = stash(df.select(*dict.fromkeys([*fields, text])))  # the second read must meet the same rows in the same chunks
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-size // chunk_bytes))
    named = df.select(F.spark_partition_id().cast("long").alias("part"), F.col(text).alias("text"), (F.struct(*[F.col(c) for c in fields]) if fields else F.struct(F.lit(0).alias("none"))).alias("rest"))
    rest = named.schema["rest"].dataType
    asked = arrow_map(named.select("part", "text"), _requests(n, order, chunk_bytes), _REQUEST).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind", "chunk")
    told = arrow_map(asked, _answers(least_count, order), _REQUEST)
    both = told.unionByName(arrow_map(named, _texts(order, fields, chunk_bytes), _REQUEST))
    both = both.repartition(4 * n, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    inner = StructType([f for f in rest.fields if fields]).add("n_words", "long").add("n_backoff", "long").add("n_full", "long").add("raw_log", "double")
    out = stash(arrow_map(both, _scores(backoff, order, fields, to_arrow_schema(inner)), inner))
    words = out.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    total = F.when(F.col("n_words") == 0, 0.0).otherwise(F.col("raw_log") - F.col("n_backoff") * float(np.log(max(words, 1))))
    return out.withColumn("log_score", F.round(total, 6)).withColumn("mean_log", F.when(F.col("n_words") > 0, F.round(total / F.col("n_words"), 6))).drop("raw_log")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d
), p AS (SELECT r, i, w, lag(w) OVER x AS v, lag(w, 2) OVER x AS u FROM t WINDOW x AS (PARTITION BY r ORDER BY i)
), c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w
), c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {LEAST_COUNT}
), c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= {LEAST_COUNT}
), s AS (
  SELECT p.r, count(*) AS n_words, count(*) FILTER (c3.n IS NULL AND c2.n IS NULL) AS n_backoff, count(c3.n) AS n_full,
    sum(CASE WHEN c3.n IS NOT NULL THEN ln(c3.n) - ln(e.n) WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(b.n) + CASE WHEN p.i >= 2 THEN ln({BACKOFF}::DOUBLE) ELSE 0 END
      ELSE ln(a.n) - ln((SELECT count(*) FROM t)) + least(p.i, 2) * ln({BACKOFF}::DOUBLE) END) AS total
  FROM p JOIN c1 a ON p.w = a.w LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w LEFT JOIN c3 ON p.u = c3.u AND p.v = c3.v AND p.w = c3.w
    LEFT JOIN c1 b ON p.v = b.w LEFT JOIN c2 e ON p.u = e.v AND p.v = e.w GROUP BY p.r
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, CAST(coalesce(n_full, 0) AS BIGINT) AS n_full, round(coalesce(total, 0.0::DOUBLE), 6) AS log_score, round(total / n_words, 6) AS mean_log
FROM d LEFT JOIN s ON d.r = s.r
"""
