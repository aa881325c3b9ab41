"""Removal of repeated passages by column-wise collection BWT construction (operator 2).

The sorted order of all suffixes of a collection, with common prefixes, shows each string of `window` bytes that
occurs more than once. Building it for a corpus at once takes as many passes as the longest document has
bytes, so the collection is first parted exactly: each window belongs to the place of its smallest hashed
substring of SEED_BYTES (its minimiser), neighbouring windows with the same place form one string, and
equal windows have equal minimisers. Equal strings, told by two unrelated hashes (a polynomial of 64 bits, and 32 of XXH3), are entered once. Only
minimisers that hold several different strings need suffix order; their strings are short (two windows at most) and
go to buckets. The strings of a minimiser with very many are cut finer first, by more of what equal windows share.

In a bucket the Burrows-Wheeler transform and the common prefixes of all suffixes are built in rounds. Round
j inserts one symbol of each string, the j-th from its end: the places of the new suffixes follow from the
ranks of their first symbols in the transform, their common prefixes from range minima between neighbouring
occurrences of the symbol. Transform and prefixes lie in sequential files that each round reads and
writes once, front to back; these are unlinked scratch of one task, and nothing else ever reads them.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.llm.common import Rolling, arrow_map, flat, free_name, other_fields, stash, to_arrow_schema

WINDOW, SEED_BYTES = 100, 32
#: Bytes of text whose strings a task compares before it sends any; texts are hashed in slices.
CHUNK_BYTES, SLICE = 12 << 20, 1 << 20
#: Bytes of text per bucket of minimisers, and bytes of strings that enter one construction together.
BUCKET_BYTES, BATCH_BYTES = 16 << 20, 256 << 10
#: Bytes of a sequential file that stay in memory before it goes to disk.
SPOOL = 32 << 20
#: Different strings of a minimiser from which they are cut finer, and into how many ranges of its place in a window.
HOT_STRINGS, RANGES = 1024, 4
#: Marks that a string has no further symbol; UTF-8 never has this byte.
END = 255


def strings_of(data: np.ndarray, off: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Document, start in it, number of windows, hash of the minimiser and both hashes of the string, for each string."""
    if len(data) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32))
    roll = Rolling(data)
    h = roll.windows(k)
    low = np.uint64(0xFFFFFFFF)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left, in every copy of a window alike
    need, have = window - k + 1, 1
    while have * 2 <= need:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if need > have:
        best = np.minimum(best[: len(best) - (need - have)], best[need - have :])
    place = (best & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    valid = doc[: len(place)] == doc[window - 1 :]
    change = np.concatenate([[True], place[1:] != place[:-1]])
    before = np.concatenate([[False], valid[:-1]])
    after = np.concatenate([valid[1:], [False]])
    first = np.flatnonzero(valid & (change | ~before))
    last = np.flatnonzero(valid & (np.concatenate([change[1:], [True]]) | ~after))
    d = doc[first]
    raw = data.tobytes()
    other = np.array([xxhash.xxh3_64_intdigest(raw[lo:hi]) for lo, hi in zip(first.tolist(), (last + window).tolist(), strict=True)], np.uint64).astype(np.uint32)
    return d, first - off[d], last - first + 1, h[place[first]], roll.of(first, last + window), other


def finer(raw: bytes, seed: int, window: int, k: int) -> list[tuple[int, int, int]]:
    """(start, end, new seed) of the parts of a string in which the minimiser lies in one range of places in the window.

    All windows of a range share the bytes from its first place before the minimiser to its last one after it;
    their hash is the new seed, so equal windows stay together and much else does not.
    """
    data = np.frombuffer(raw, np.uint8)
    roll = Rolling(data)
    h = roll.windows(k)[: window - k + 1]
    place = int(np.argmin(h >> np.uint64(32)))  # ties go to the left, as in strings_of
    out = []
    width = -(-(window - k + 1) // RANGES)
    for low in range(0, window - k + 1, width):
        high = min(low + width, window - k + 1) - 1
        first, last = max(0, place - high), min(len(raw) - window, place - low)
        if first <= last:
            shared = roll.of(np.array([place - low]), np.array([place - high + window]))[0]
            new = (int(shared) ^ seed * (2 * low + 1)) & (1 << 64) - 1
            out.append((first, last + window, new - (new >> 63 << 64)))
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last counts least), and where in that order all keys but the last differ from the entry before."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys[:-1]:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def _ranks(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Dense rank of (id, mark) pairs."""
    order, _ = _groups(ids, marks)
    new = np.concatenate([[False], (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


_REQUEST = "bucket int, ids array<long>, marks array<long>, doc array<int>, start array<int>, n array<int>, seed array<long>, string array<long>, other array<int>"
_REPLY = "id long, mark long, kind int, seed array<long>, start array<int>, n array<int>"


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _reply(ids, marks, kind: int, seed, start, n) -> pa.RecordBatch | None:
    """One row per document, which the entries name by id and mark."""
    if not len(ids):
        return None
    order, _ = _groups(ids, marks, start)
    ids, marks, seed, start, n = (x[order] for x in (ids, marks, seed, start, n))
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1, [len(ids)]])
    head = cuts[:-1]
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(marks[head]), pa.array(np.full(len(head), kind, np.int32)), _lists(seed.view(np.int64), cuts, pa.int64()), _lists(start, cuts, pa.int32()), _lists(n, cuts, pa.int32())], names=["id", "mark", "kind", "seed", "start", "n"])


def _first_copies(seed, string, other, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct entries, in it the first of each string, and how many different strings its minimiser has.

    Strings of equal first and different second hash may count as new more than once: suffix order decides those.
    """
    order = np.lexsort((place, string, seed))
    s, t, o, p = seed[order], string[order], other[order], place[order]
    new_seed = np.concatenate([[True], s[1:] != s[:-1]])
    new = new_seed | np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])
    once = new | np.concatenate([[True], p[1:] != p[:-1]])  # a repeated row has the same places again
    order, new, new_seed = order[once], new[once], new_seed[once]
    group = np.cumsum(new_seed) - 1
    return order, new, np.bincount(group, new)[group] if len(group) else group


def _parts(window: int, k: int, n_buckets: int):
    """(id, mark, text) -> rows of _REQUEST, with bucket -1 for what is settled within the task (string: unused)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, marks, start, n, seed, string, other = (np.concatenate([h[i] for h in held]) for i in range(7))
            held.clear()
            if not len(ids):
                return
            rank = _ranks(ids, marks)
            order, new, _ = _first_copies(seed, string, other, rank << 32 | start)
            copies, firsts = order[~new], order[new]
            bucket = (seed[firsts] % np.uint64(n_buckets)).astype(np.int64)
            for which, b in ((copies, np.full(len(copies), -1)), (firsts, bucket)):
                by = np.lexsort((string[which], seed[which], b)) if which is firsts else np.lexsort((start[which], rank[which]))
                which, b = which[by], b[by]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi > lo:
                        w = which[lo:hi]
                        docs, at, doc = np.unique(rank[w], return_index=True, return_inverse=True)
                        one = lambda x, kind: _lists(x, np.array([0, len(x)]), kind)
                        settled = which is copies
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(b[lo])], pa.int32()), one(ids[w][at], pa.int64()), one(marks[w][at], pa.int64()), one(doc, pa.int32()), one(start[w], pa.int32()), one(n[w], pa.int32()), *(one(x[w][: 0 if settled else None].view(kind), pa.from_numpy_dtype(kind)) for x, kind in ((seed, np.int64), (string, np.int64), (other, np.int32)))],
                            names=["bucket", "ids", "marks", "doc", "start", "n", "seed", "string", "other"],
                        )

        for b in batches:
            all_ids, all_marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = flat(b.column(2))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
                d, start, n, *hashed = strings_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window, k)
                held.append((all_ids[lo:hi][d], all_marks[lo:hi][d], start, n, *hashed))
                size += off[hi] - off[lo]
                lo = hi
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of bucket -> replies: kind 0 are windows to remove, kind 1 strings whose suffixes must be sorted, kind 2 those of a minimiser with very many."""
    at, held = None, []

    def column(rows, i) -> np.ndarray:
        return np.concatenate([r[i] for r in rows])

    def flush() -> Iterator[pa.RecordBatch]:
        counts = [len(r[0]) for r in held]
        doc = np.concatenate([r[2] + lo for r, lo in zip(held, np.cumsum([0, *counts[:-1]]), strict=True)])
        ids, marks = column(held, 0), column(held, 1)
        start, n = column(held, 3).astype(np.int64), column(held, 4)
        seed, string, other = (column(held, i).view(kind) for i, kind in ((5, np.uint64), (6, np.uint64), (7, np.uint32)))
        order, new, kinds = _first_copies(seed, string, other, _ranks(ids, marks)[doc] << 32 | start)
        for kind, which in ((0, order[~new]), (1, order[new & (kinds > 1) & (kinds < HOT_STRINGS)]), (2, order[new & (kinds >= HOT_STRINGS)])):
            if (out := _reply(ids[doc[which]], marks[doc[which]], kind, seed[which] if kind else seed[which] * np.uint64(0), start[which], n[which])) is not None:
                for lo in range(0, out.num_rows, 4096):
                    yield out.slice(lo, 4096)

    for b in batches:
        for k, bucket in enumerate(b.column(0).to_pylist()):
            row = [b.column(i)[k].values.to_numpy() for i in range(1, 9)]
            if bucket < 0:
                if (out := _reply(row[0][row[2]], row[1][row[2]], 0, np.zeros(len(row[2]), np.int64), row[3], row[4])) is not None:
                    yield out
                continue
            if at != bucket:
                if held:
                    yield from flush()
                at, held = bucket, []
            held.append(row)
    if held:
        yield from flush()


def _cut(window: int, k: int, n_buckets: int):
    """(id, mark, text, wanted: array of (kind, seed, start, n) lists) -> strings of each batch by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, list] = {}
            for i, m, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), b.column(3), strict=True):
                raw = text.as_py()
                for part in wanted.values:
                    hot = part["kind"].as_py() == 2
                    for seed, start, n in zip(*(part[f].values.to_pylist() for f in ("seed", "start", "n")), strict=True):
                        string = raw[start : start + n + window - 1]
                        for lo, hi, new in finer(string, seed, window, k) if hot else [(0, len(string), seed)]:
                            out.setdefault(new % n_buckets, []).append((i, m, new, start + lo, string[lo:hi]))
            for bucket, rows in out.items():
                i, m, seed, start, raw = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([i], pa.list_(pa.int64())), pa.array([m], pa.list_(pa.int64())), pa.array([seed], pa.list_(pa.int64())), pa.array([start], pa.list_(pa.int32())), pa.array([raw], pa.list_(pa.binary()))], names=["bucket", "id", "mark", "seed", "start", "raw"])

    return run


class Sequential:
    """A byte file that is read whole and replaced whole, front to back."""

    def __init__(self, first: np.ndarray):
        self.file = None
        self.put(first)

    def put(self, x: np.ndarray) -> None:
        if self.file is not None:
            self.file.close()
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)  # noqa: SIM115
        self.file.write(x.data)

    def get(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), np.uint8)


def collection_order(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes (at most 255) of all suffixes of the strings data[end - size : end].

    The first rows are the empty suffixes, in order of the strings. Strings are 1 to 255 bytes long, without END.
    """
    m = len(ends)
    transform, prefixes = Sequential(data[ends - 1]), Sequential(np.zeros(m, np.uint8))
    at, who = np.arange(m), np.arange(m)  # row of each string's longest suffix so far, by row; and the string
    for j in range(1, int(sizes.max(initial=0)) + 1):
        b, common = transform.get(), prefixes.get()
        going = sizes[who] >= j
        at, who = at[going], who[going]
        order = np.argsort(b, kind="stable")  # row i of the suffixes with a first symbol comes from order[i]
        fresh = np.zeros(len(b), bool)
        fresh[at] = True
        k = np.flatnonzero(fresh[order])
        p = order[k]
        who = who[np.searchsorted(at, p)]
        symbol = b[p]
        padded = np.append(common, np.uint8(0))
        lows = []
        for step in (-1, 1):
            near = order[np.clip(k + step, 0, len(order) - 1)]
            same = (b[near] == symbol) & (k + step >= 0) & (k + step < len(order))
            left, right = (near[same], p[same]) if step < 0 else (p[same], near[same])
            low = np.zeros(len(k), np.uint8)
            if len(left):
                by = np.argsort(left, kind="stable")
                spans = np.stack([left[by] + 1, right[by] + 1], axis=1).ravel()
                least = np.empty(len(left), np.uint8)
                least[by] = np.minimum.reduceat(padded, spans)[::2]
                low[same] = np.minimum(least, 254) + 1
            lows.append(low)
        new = k + m
        old = np.ones(len(b) + len(new), bool)
        old[new] = False
        out = np.empty(len(old), np.uint8)
        out[old] = b
        out[new] = np.where(sizes[who] > j, data[np.maximum(ends[who] - j - 1, 0)], END)
        transform.put(out)
        out = np.empty(len(old) + 1, np.uint8)
        out[:-1][old] = common
        out[new + 1] = lows[1]
        out[new] = lows[0]
        prefixes.put(out[:-1])
        at = new
    return transform.get(), prefixes.get()


def repeated(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings and offsets of the windows that occur at an earlier (rank, start) too."""
    b, common = collection_order(data, ends, sizes)
    m = len(ends)
    step = np.empty(len(b), np.int64)
    step[np.argsort(b, kind="stable")] = np.arange(m, m + len(b))
    row, who = np.arange(m), np.arange(m)
    rows, strings, offsets = [], [], []
    for j in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[who] >= j
        row, who = step[row[going]], who[going]
        if j >= window:
            rows.append(row)
            strings.append(who)
            offsets.append(sizes[who] - j)
    row, who, offset = (np.concatenate(x) for x in (rows, strings, offsets))
    run = np.cumsum(common < window)[row]
    order, new = _groups(run, rank[who] << 32 | (start[who] + offset))
    # a repeated row gives the same place twice; it is not a repetition
    place = (rank[who] << 32 | (start[who] + offset))[order]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    hit = order[place != place[head]] if len(order) else order
    return who[hit], offset[hit]


def _may_repeat(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, seed: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which strings can share a window with another string of their minimiser.

    Equal windows have the minimiser at the same place, hence half of the other bytes, before it or after it, in common.
    Strings in which the minimiser isn't found (they were cut finer) may always.
    """
    half = (window - k) // 2
    if not half or not len(sizes):
        return np.ones(len(sizes), bool)
    roll, begin = Rolling(data), ends - sizes
    hit = np.flatnonzero(roll.windows(k) == np.repeat(seed.view(np.uint64), sizes)[: len(data) - k + 1])
    who = np.searchsorted(ends, hit, side="right")
    hit, who = (x[hit - begin[who] <= window - k] for x in (hit, who))
    who, at = np.unique(who, return_index=True)
    place = hit[at]
    out = np.ones(len(sizes), bool)
    out[who] = False
    for first in (place - half, place + k):
        fits = np.flatnonzero((first >= begin[who]) & (first + half <= ends[who]))
        if not len(fits):
            continue
        h = roll.of(first[fits], first[fits] + half)
        order = np.lexsort((h, seed[who[fits]]))
        s, h = seed[who[fits]][order], h[order]
        same = (s[1:] == s[:-1]) & (h[1:] == h[:-1])
        out[who[fits][order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]] = True
    return out


def _sort_suffixes(window: int, seed_bytes: int):
    """Strings in order of bucket -> replies of kind 0 from the sorted suffixes of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, marks, seed, start = (np.concatenate([r[i] for r in held]) for i in range(4))
            raw = [x for r in held for x in r[4]]
            by = np.argsort(seed, kind="stable")
            sizes = np.array([len(raw[i]) for i in by], np.int64)
            every = np.frombuffer(b"".join(raw[i] for i in by), np.uint8)
            by = by[_may_repeat(every, np.cumsum(sizes), sizes, seed[by], window, seed_bytes)]
            sizes = np.array([len(raw[i]) for i in by], np.int64)
            ids, marks, seed, start = ids[by], marks[by], seed[by], start[by].astype(np.int64)
            rank, total = _ranks(ids, marks), np.cumsum(sizes)
            cut = np.flatnonzero(np.diff(seed)) + 1  # only here may a bucket be parted
            lo = 0
            while lo < len(by):
                base = total[lo] - sizes[lo]
                far = cut[(cut > lo) & (total[np.maximum(cut - 1, 0)] - base <= BATCH_BYTES)]
                hi = len(by) if total[-1] - base <= BATCH_BYTES else int(far[-1]) if len(far) else int(next(iter(cut[cut > lo]), len(by)))
                data = np.frombuffer(b"".join(raw[i] for i in by[lo:hi]), np.uint8)
                who, offset = repeated(data, total[lo:hi] - base, sizes[lo:hi], rank[lo:hi], start[lo:hi], window)
                if len(who):
                    who = who + lo
                    order = np.lexsort((offset, who))
                    who, offset = who[order], offset[order]
                    head = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(offset) != 1)]))
                    w = who[head]
                    out = _reply(ids[w], marks[w], 0, np.zeros(len(w), np.int64), start[w] + offset[head], np.diff(head, append=len(who)))
                    for k in range(0, out.num_rows, 4096):
                        yield out.slice(k, 4096)
                lo = hi

        for b in batches:
            for k, bucket in enumerate(b.column(0).to_pylist()):
                if at != bucket:
                    if held:
                        yield from flush()
                    at, held = bucket, []
                held.append([b.column(i)[k].values.to_numpy() for i in range(1, 5)] + [b.column(5)[k].as_py()])
        if held:
            yield from flush()

    return run


def _spans(parts, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows to remove."""
    found = sorted((s, s + n + window - 1) for part in parts for s, n in zip(part["start"].values.to_pylist(), part["n"].values.to_pylist(), strict=True))
    out: list[tuple[int, int]] = []
    for lo, hi in found:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the bytes of characters that lie in them in part only."""
    out = []
    for lo, hi in runs:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _apply(window: int, fields: int, as_text: bool, schema):
    """(kept columns.., text, parts) -> kept columns.., results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, kept = [], [], [], []
            for text, parts in zip(b.column(fields).cast(pa.large_binary()), b.column(fields + 1), strict=True):
                raw = text.as_py()
                runs = _spans(parts.values, window) if parts.is_valid else []
                size.append(len(raw or b""))
                removed.append(sum(hi - lo for lo, hi in runs))
                spans.append(len(runs))
                if as_text:
                    runs = whole_characters(raw or b"", runs)
                if runs:
                    raw = b"".join(raw[lo:hi] for lo, hi in zip([0, *(hi for _, hi in runs)], [*(lo for lo, _ in runs), len(raw)], strict=True))
                kept.append((raw if raw is None else raw.decode()) if as_text else hashlib.sha256(raw or b"").hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(schema.field(i).type) for i in range(fields)), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def repeats(df: DataFrame, text: str = "text", ident: str = "doc_id", window: int = WINDOW, seed_bytes: int = SEED_BYTES, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts earlier: in a smaller id, or before in the same document.

    Columns `keep` (default: all but the text), n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes; with
    as_text=True instead of the digest kept_text, in which characters stay that are covered in part only.
    What repeats is judged on the input. Null text: 0 bytes, digest of nothing (kept_text: null). Null ids come
    last. Rows that share an id are documents of their own, ordered by a hash of the text; rows with the same id
    and text are one document and each get its result. Empty table: no rows. Kept columns named like a result go.
    """
    if not 8 <= seed_bytes <= window <= 128:
        raise ValueError("8 <= seed_bytes <= window <= 128 is needed: strings of two windows are sorted by one byte of prefix")
    results = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_text" if as_text else "kept_sha256", StringType())]
    fields = [f for f in other_fields(df, [r.name for r in results]) if (f.name in keep if keep is not None else f.name != text)]
    n, ids, total = df.agg(F.count("*"), F.countDistinct(ident), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_BYTES))
    # where ids tell rows apart the hash isn't needed to
    mark = F.lit(0).cast("long") if n == ids else F.xxhash64(text)
    key, tag, body, parts = (free_name(df, x) for x in ("key_", "tag_", "text_", "parts_"))
    docs = df.select(F.coalesce(F.col(ident).cast("long"), F.lit((1 << 63) - 1)).alias(key), mark.alias(tag), *[F.col(f.name) for f in fields], F.col(text).alias(body))
    asked = arrow_map(docs.select(key, tag, body), _parts(window, seed_bytes, buckets), _REQUEST)
    # what is settled already goes anywhere; a bucket goes to one task
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    replies = stash(arrow_map(asked.repartitionById(buckets, spread).sortWithinPartitions("bucket"), _compare, _REPLY))
    gathered = lambda d: d.groupBy(F.col("id").alias(key), F.col("mark").alias(tag)).agg(F.collect_list(F.struct("kind", "seed", "start", "n")).alias(parts))
    wanted = docs.join(gathered(replies.where("kind > 0")), [key, tag]).select(key, tag, body, parts)
    if n != ids:
        wanted = wanted.where(F.col(body).isNotNull()).dropDuplicates([key, tag])
    cut = arrow_map(wanted, _cut(window, seed_bytes, 4 * buckets), "bucket int, id array<long>, mark array<long>, seed array<long>, start array<int>, raw array<binary>")
    more = arrow_map(cut.repartitionById(4 * buckets, F.col("bucket")).sortWithinPartitions("bucket"), _sort_suffixes(window, seed_bytes), _REPLY)
    settled = gathered(replies.where("kind = 0").unionByName(more))
    joined = docs.join(settled, [key, tag], "left").select(*[F.col(f.name) for f in fields], body, parts)
    schema = StructType([*fields, *results])
    return arrow_map(joined, _apply(window, len(fields), as_text, to_arrow_schema(schema)), schema)


def removed(df: DataFrame, text: str = "text", ident: str = "doc_id", length: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """Rows of df without their repeated passages, all columns as they were; `length`, if df has it, follows a text that changed.

    Characters that a repeated string covers in part only stay. Null texts stay null, texts may become empty.
    """
    results = ("n_bytes", "n_removed", "n_spans", "kept_text")
    own = {c: free_name(df, f"input_{k}_{c}") for k, c in enumerate(df.columns) if c.lower() in results and c != text}
    out = repeats(df.withColumnsRenamed(own), text, ident, window, keep=[own.get(c, c) for c in df.columns], as_text=True)
    changed = {text: F.col("kept_text"), length: F.when(F.col("kept_text") != F.col(text), F.char_length("kept_text").cast(dict(df.dtypes).get(length, "long"))).otherwise(F.col(own.get(length, length))) if length in df.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(own.get(c, c))).alias(c) for c in df.columns])
