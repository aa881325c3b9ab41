"""SimHash near-duplicates by segment popcounts (operator 8).

A 64-bit fingerprint maps to the counts of set bits in its segments. One differing bit moves one count by one, so
the Manhattan distance of two count vectors is a lower bound of the Hamming distance. Fingerprints
therefore meet by a range join on a grid of the counts of three segments: each is resident in its own
cell and asks at the cells within Manhattan distance 3 (half of them, as pairs are symmetric). In
a cell, nine finer segments are joined in the same way by sorted keys, and what is left is verified exactly.

near_copies_removed() is for stages that remove copies by real similarity of their shingle sets. Sets of similarity 0.8
differ in about 15 % of a fingerprint's bits and up to 40 %, random ones in half, so their fingerprints have four words. They meet
in the same way, by ranges of the counts of segments under WIDE_BITS. As counts part little at that distance, the size of
the set, the popcount of its own bitmap, is one more coordinate of the grid. Whole sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.common import arrow_map, encoded, free_name, map_texts, mix, small, stash
from lodestone.llm.components import components, forest

#: Bits of the three coarse segments, each cut into three finer ones.
FINE = ((7, 7, 7), (7, 7, 7), (7, 7, 8))
MOST_BITS, WORDS, SEED = 3, 3, 42
#: Residents of a cell that a task holds at once; larger cells are dealt into blocks.
BLOCK = 50_000

#: Stages on word shingles: words, least similarity, and the most bits that the fingerprints of similar sets differ in: in the first two words, and in all.
#: By the binomial law, a pair of similarity 0.8 is missed with probability 5e-8 (four shingles and the same with a fifth, the worst case), 1e-10 from ten shingles on.
COPY_WORDS, SIMILARITY, WIDE_BITS = 5, 0.8, (50, 84)
#: Words of such a fingerprint, segments that each of the first two is cut into in a task, residents of a cell that a task holds at once.
WIDE, CUTS, WIDE_BLOCK = 4, 4, 32_768
#: Sets whose hashes a task compares with each other at once.
COPY_BLOCK = 2048

_PRINT = [f"p{k}" for k in range(WIDE)]


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hash of each word shingle, repeats included; bytes.lower() and split() touch ASCII letters and blanks only."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: len(w) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", words: int = WORDS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Append the 64-bit fingerprint as a signed long. Null or wordless text: 0."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            got = [fingerprint((x.as_py() or "").encode(), words, seed) for x in texts]
            return [pa.array(np.array(got, np.uint64).view(np.int64))]

        return run

    return map_texts(df, text, StructType([StructField(out, LongType())]), make, keep)


@lru_cache(maxsize=1)
def _offsets(most: int) -> tuple[list[tuple[int, ...]], list[np.ndarray]]:
    """Half of the coarse offsets within `most`, the zero first, and for each one the fine offsets that sum to it."""
    coarse = [o for o in product(range(-most, most + 1), repeat=3) if sum(map(abs, o)) <= most and o >= (0, 0, 0)]
    coarse.sort(key=lambda o: (sum(map(abs, o)), o))
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for p in product(range(-most, most + 1), repeat=3):
        if sum(map(abs, p)) <= most:
            parts.setdefault(sum(p), []).append(p)
    fine = [np.array([a + b + c for a, b, c in product(*(parts[x] for x in o)) if sum(map(abs, a + b + c)) <= most], np.int64) for o in coarse]
    return coarse, fine


def _counts(fp: np.ndarray) -> np.ndarray:
    out, shift = [], 0
    for bits in (b for group in FINE for b in group):
        out.append(np.bitwise_count((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    return np.stack(out, axis=1)


#: Each fine count, moved by `most` so that no neighbour is negative, takes five bits of a key.
_SCALE = np.array([1 << (5 * k) for k in range(9)], np.int64)


def _near(residents: np.ndarray, probes: np.ndarray, offset: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (resident, probe) within `most` bits; the probes' cell plus the offset is the residents' cell."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    keys = (_counts(residents) + most) @ _SCALE
    order = np.argsort(keys, kind="stable")
    keys, residents = keys[order], residents[order]
    own = (_counts(probes) + most) @ _SCALE
    for move in _offsets(most)[1][offset]:
        want = own + int(move @ _SCALE)
        low, high = np.searchsorted(keys, want), np.searchsorted(keys, want, side="right")
        some = np.flatnonzero(high > low)
        for part in np.array_split(some, max(1, int((high - low)[some].sum()) >> 20)):
            n = (high - low)[part]
            p = np.repeat(part, n)
            r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
            x, y = residents[r], probes[p]
            ok = np.bitwise_count(x ^ y) <= most
            if offset == 0:
                ok &= x < y
            found.append((x[ok], y[ok]))
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.zeros(0, np.uint64),) * 2


def links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fp) distinct longs -> (u, v): links that join the same fingerprints as all pairs within `most` bits do.

    Each cell and offset yields a spanning forest of its pairs rather than the pairs, so the result grows with the
    fingerprints even where thousands of them lie close together.
    """
    coarse, _ = _offsets(most)
    bits = [sum(g) for g in FINE]
    shifts = [0, bits[0], bits[0] + bits[1]]
    side = max(bits) + 2 * most + 1
    fp = F.col("fp")
    count = [F.bit_count(F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << b) - 1))) + most for s, b in zip(shifts, bits, strict=True)]
    cell = (count[0] * side + count[1]) * side + count[2]
    prints = prints.select("fp", cell.cast("int").alias("cell"))
    # cells: at most side ** 3, so this table's size has a bound
    sizes = small(stash(prints.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))), 16)
    moves = F.array(*[F.struct(F.lit(k).alias("move"), F.lit((a * side + b) * side + c).alias("by")) for k, (a, b, c) in enumerate(coarse)])
    asks = prints.select("fp", "cell", F.explode(moves).alias("m")).select("fp", (F.col("cell") + F.col("m.by")).alias("cell"), F.col("m.move").alias("move"))
    asks = asks.join(sizes, "cell").select("fp", "cell", "move", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    homes = prints.join(sizes, "cell").select("fp", "cell", F.lit(-1).alias("move"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, residents, held, n_held = None, [], {}, 0

        def flush():
            nonlocal held, n_held
            for offset, probes in held.items():
                a, b = _near(np.concatenate(residents), np.concatenate(probes), offset, most)
                if len(a):
                    u, v = forest(a.view(np.int64), b.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held, n_held = {}, 0

        # A fine key tells its cell, so many small cells are searched together. Rows come by cell and
        # block, residents first; what a task holds is bounded by BLOCK and a batch.
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            c = b.column(1).to_numpy().astype(np.int64) << 32 | b.column(3).to_numpy()
            move = b.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(move) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(c)], strict=True):
                if at != c[lo]:
                    at = c[lo]
                    if n_held + sum(map(len, residents)) > 8 * BLOCK:
                        yield from flush()
                        residents = []
                if move[lo] < 0:
                    residents.append(f[lo:hi])
                elif residents:
                    held.setdefault(int(move[lo]), []).append(f[lo:hi])
                    n_held += hi - lo
                    if n_held > 16 * BLOCK:
                        yield from flush()
        yield from flush()

    met = homes.unionByName(asks.select("fp", "cell", "move", "block")).repartition("cell", "block").sortWithinPartitions("cell", "block", "move")
    return arrow_map(met.select("fp", "cell", "move", "block"), run, "u long, v long")


def classes(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = WORDS, most: int = MOST_BITS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Append fingerprint (16 hex digits) and component_id, the smallest id linked directly or over others.

    Equal fingerprints form one class before anything is compared, so copies cost one row. Null and wordless
    texts have fingerprint zero and link like any other. Null ids take part; they are never the smallest
    (component_id is null only if all ids of a component are null). Repeated ids and rows keep a row each.
    """
    fp, low = free_name(df, "fp_bits"), free_name(df, "fp_low")
    rows = stash(fingerprints(df.select(*dict.fromkeys([*(keep if keep is not None else df.columns), ident, text])), text, fp, words, seed, keep=[*(keep if keep is not None else df.columns), ident]))
    return labelled(rows, fp, ident, low, most)


def labelled(rows: DataFrame, fp: str, ident: str, low: str, most: int) -> DataFrame:
    """Rows with fingerprints -> fingerprint and component_id appended, the bits dropped."""
    own = stash(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(ident).alias("low")))
    roots = components(links(own.select("fp"), most)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = stash(own.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = stash(named.groupBy("root").agg(F.min("low").alias("component_id")))  # a plain table again, so that a large component can be split
    named = named.join(least, "root").select(F.col("fp").alias(low), F.col("component_id"))
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("fingerprint", "component_id")])
    hexed = F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
    return rows.join(named, F.col(fp) == F.col(low)).withColumn("fingerprint", hexed).select(*[c for c in rows.columns if c != fp], "fingerprint", "component_id")


# ---- near copies by real similarity ----


def wide_print(h: np.ndarray) -> list[int]:
    """The words of the fingerprint of a set of hashes, each a SimHash of the hashes mixed anew."""
    return [majority(mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h) for k in range(WIDE)]


def _spread(df: DataFrame, key: str, item: str, n: str) -> DataFrame:
    """Rows with n, the number of rows of their key, dealt into blocks of COPY_BLOCK: home, the block of the row itself,
    and block, each block from its own on, in which it is compared. So any two rows of a key meet in one block."""
    blocks = F.ceil(F.col(n) / COPY_BLOCK).cast("int")
    home = F.pmod(F.xxhash64(item), blocks).cast("int")
    dealt = df.withColumn("home", home).withColumn("block", F.explode(F.sequence("home", blocks - 1)))
    return dealt.repartition(key, "block").sortWithinPartitions(key, "block", item)


def _by_group(columns: int, flush):
    """An Arrow map over rows that come by their first two columns: flush gets the others of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            u, v = flush(at[1], [pa.chunked_array([p.column(i) for p in held]) for i in range(2, columns)])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            key, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1 if len(key) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if hi == lo:
                    continue
                if at != (key[lo], block[lo]):
                    if held:
                        yield from done()
                    at, held = (key[lo], block[lo]), []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def _joined(n: int, home: np.ndarray, block: int, near) -> tuple[list[int], list[int]]:
    """Pairs of places that join what all near pairs of a block join: two rows that live in it, or one with a row of an earlier one.
    near(a, others) tells which of the others are near to a; what is joined already isn't asked again."""
    root, own = np.arange(n), home == block
    u: list[int] = []
    v: list[int] = []
    for a in np.flatnonzero(own).tolist():
        able = root != root[a]
        able[:a] &= ~own[:a]
        others = np.flatnonzero(able)
        if not len(others):
            if (root == root[0]).all():
                break
            continue
        for b in others[near(a, others)].tolist():
            if root[b] != root[a]:
                root[root == root[b]] = root[a]
                u.append(a)
                v.append(b)
    return u, v


class _Residents:
    """Sets of a cell's block, in order of size. What meet() has joined isn't joined again."""

    def __init__(self, cls: np.ndarray, size: np.ndarray, prints: np.ndarray, least: float, most: tuple[int, int]):
        order = np.argsort(size, kind="stable")
        self.cls, self.size, self.prints = cls[order], size[order], np.ascontiguousarray(prints[:, order])
        self.counts = self._segments(self.prints)
        self.root = np.arange(len(cls))
        self.least, self.most = least, most

    @staticmethod
    def _segments(prints: np.ndarray) -> np.ndarray:
        width = 64 // CUTS
        mask = np.uint64((1 << width) - 1)
        return np.stack([np.bitwise_count((p >> np.uint64(width * k)) & mask) for p in prints[:2] for k in range(CUTS)])

    def meet(self, cls: np.ndarray | None = None, size: np.ndarray | None = None, prints: np.ndarray | None = None, tile: int = 16, run: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(u, v) that join what all pairs of a resident and one of the sets join, without sets those of two residents.

        A tile of sets meets the residents in reach of its sizes whose counts of segments lie within the Manhattan
        distance of its own; for these the bits are counted.
        """
        own = cls is None
        if own:
            cls, size, prints, counts = self.cls, self.size, self.prints, self.counts
        else:
            order = np.argsort(size, kind="stable")
            cls, size, prints = cls[order], size[order], np.ascontiguousarray(prints[:, order])
            counts = self._segments(prints)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(cls), tile):
            b = min(a + tile, len(cls))
            low = max(np.searchsorted(self.size, self.least * size[a] - 1e-6), a if own else 0)
            high = np.searchsorted(self.size, size[b - 1] / self.least + 1e-6, side="right")
            box = counts[:, a:b].min(axis=1)[:, None], counts[:, a:b].max(axis=1)[:, None]
            c = self.counts[:, low:high]
            far = (np.maximum(box[0], c) - c + np.maximum(c, box[1]) - box[1]).sum(axis=0, dtype=np.uint8)  # 128 at most
            reach = np.flatnonzero(far <= self.most[0]) + low
            joined = np.full(b - a, -1)
            while len(reach):
                out += self._tile(cls, size, prints, a, b, reach[:run], joined, own)
                label, reach = self.root[a:b] if own else joined, reach[run:]
                if label[0] >= 0 and (label == label[0]).all():
                    reach = reach[self.root[reach] != label[0]]
        return (np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])) if out else (np.zeros(0, np.int64),) * 2

    def _tile(self, cls: np.ndarray, size: np.ndarray, prints: np.ndarray, a: int, b: int, reach: np.ndarray, joined: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = reach[-1] - reach[0] == len(reach) - 1  # then a view does
        p, q = prints[:, a:b], self.prints[:, reach[0] : reach[-1] + 1] if whole else self.prints[:, reach]
        d = np.bitwise_count(p[0][:, None] ^ q[0]) + np.bitwise_count(p[1][:, None] ^ q[1])
        i, j = np.divmod(np.flatnonzero(d <= self.most[0]), len(reach))
        label = self.root[a:b] if own else joined
        some = label[i] != self.root[reach[j]]
        if own:
            some &= reach[j] > i + a
        i, j = i[some], j[some]
        d = d[i, j].astype(np.int16)
        for k in range(2, WIDE):
            d += np.bitwise_count(p[k][i] ^ q[k][j])
        n, m = size[a:b][i], self.size[reach][j]
        ok = (d <= self.most[1]) & (np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-6)
        i, r = i[ok], reach[j[ok]]
        if not own:
            first = np.flatnonzero(np.diff(i, prepend=-1))
            first = first[joined[i[first]] < 0]
            joined[i[first]] = self.root[r[first]]
            if len(first):
                yield cls[a + i[first]], self.cls[r[first]]
        open_ = label[i] != self.root[r]
        x, y = label[i][open_], self.root[r][open_]
        if len(x):
            x, y = forest(x, y)
            to = np.arange(len(self.root))
            to[x] = y
            self.root = to[self.root]
            joined[joined >= 0] = to[joined[joined >= 0]]
            yield self.cls[x], self.cls[y]


def wide_links(sets: DataFrame, least: float = SIMILARITY, most: tuple[int, int] = WIDE_BITS) -> DataFrame:
    """(cls, n, p0 .. p3): sets, their sizes and fingerprints -> (u, v): links that join the same sets as all pairs
    whose sizes allow a similarity of `least` and whose fingerprints differ in at most `most` bits.

    A range join on a grid of the sizes, by classes in which neighbours alone can be similar, and of the counts of set bits in the first two words,
    by steps wider than most[0]: each set is resident in its cell and asks there and at half of the neighbours. Sets
    too small to be similar to any other take no part.
    """
    step, side = most[0] + 1, 64 // (most[0] + 1) + 3
    size_class = F.floor(F.log(F.col("n").cast("double")) / (-np.log(least) * (1 + 1e-9))).cast("long")
    first, second = (F.floor(F.bit_count(p) / step) + 1 for p in _PRINT[:2])
    cell = (size_class * side + first) * side + second
    prints = sets.where(F.col("n") >= least / (1 - least) - 1e-6).select("cls", "n", *_PRINT, cell.alias("cell"))
    # cells: a few for each class of sizes, and these grow with the logarithm of the largest size
    sizes = small(stash(prints.groupBy("cell").agg(F.ceil(F.count("*") / WIDE_BLOCK).cast("int").alias("blocks"))), 16)
    homes = prints.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    at_home = homes.withColumn("asks", F.lit(0)).drop("blocks")
    same = homes.where("block + 1 < blocks").withColumn("block", F.explode(F.expr("sequence(block + 1, blocks - 1)"))).withColumn("asks", F.lit(1)).drop("blocks")
    moves = [(s * side + x) * side + y for s, x, y in product((0, 1), (-1, 0, 1), (-1, 0, 1)) if (s, x, y) > (0, 0, 0)]
    asks = prints.withColumn("cell", F.explode(F.array(*[F.col("cell") + m for m in moves]))).join(sizes, "cell")
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(1)).drop("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n_held, residents = None, [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            """Residents meet each other once all of them are there, then those who ask, as many at once as a block has."""
            nonlocal held, n_held, residents
            if held:
                cls, size, *prints = (np.concatenate(x) for x in zip(*held, strict=True))
                prints = np.stack(prints).view(np.uint64)
                u = v = np.zeros(0, np.int64)
                if not at[2]:
                    residents = _Residents(cls, size, prints, least, most)
                    u, v = residents.meet()
                elif residents is not None:
                    u, v = residents.meet(cls, size, prints)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held, n_held = [], 0

        for b in batches:
            cell, block, asks, *rest = (c.to_numpy() for c in b.columns)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1 if len(cell) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if hi == lo:
                    continue
                if at != (cell[lo], block[lo], asks[lo]):
                    yield from flush()
                    if at is None or at[:2] != (cell[lo], block[lo]):
                        residents = None
                    at = (cell[lo], block[lo], asks[lo])
                held.append([x[lo:hi] for x in rest])
                n_held += hi - lo
                if asks[lo] and n_held >= WIDE_BLOCK:
                    yield from flush()
        yield from flush()

    met = at_home.unionByName(same).unionByName(asks).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return arrow_map(met.select("cell", "block", "asks", "cls", "n", *_PRINT), run, "u long, v long")


def _alike(most: tuple[int, int], least: float):
    """Blocks of candidates -> (u, v): sets that real similarities of `least` or more join."""

    def flush(block: int, columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
        home, cls, *prints = (c.to_numpy() for c in columns[: 2 + WIDE])
        first = np.concatenate([[True], cls[1:] != cls[:-1]])  # equal rows give their set again
        home, cls, prints = home[first], cls[first], np.stack(prints)[:, first].view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x, keep in zip(columns[2 + WIDE], first, strict=True) if keep]
        size = np.array(list(map(len, sets)))

        def near(a: int, others: np.ndarray) -> np.ndarray:
            ok = (size[others] >= least * size[a] - 1e-9) & (size[a] >= least * size[others] - 1e-9)
            ok &= np.bitwise_count(prints[:, others] ^ prints[:, a, None]).sum(axis=0, dtype=np.int64) <= most[1]
            some = np.flatnonzero(ok)
            if len(some):
                who = others[some]
                x = np.concatenate([sets[b] for b in who])
                place = np.minimum(np.searchsorted(sets[a], x), size[a] - 1)
                both = np.bincount(np.repeat(np.arange(len(who)), size[who])[sets[a][place] == x], minlength=len(who))
                ok[some] = both >= least * (size[who] + size[a] - both) - 1e-9
            return ok

        u, v = _joined(len(cls), home, block, near)
        return cls[u], cls[v]

    return _by_group(5 + WIDE, flush)


def _copy_links(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, least: float, most: tuple[int, int], seed: int) -> DataFrame:
    """(u, v) that join the classes which similarities of `least` or more join. sets: (cls, n, p0 .. p3); texts: wanted classes -> (cls, .., text)."""
    roots = components(wide_links(sets, least, most))
    # candidates: whole connected sets of them, each with the number of its members
    member = roots.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    member = stash(member.union(member.select(F.col("root").alias("cls"), "root").distinct()))
    counts = stash(member.groupBy("root").agg(F.count("*").alias("n")))  # a plain table, so that a large one can be split
    wanted = stash(member.join(counts, "root").join(sets.select("cls", *_PRINT), "cls"))
    columns = ["cls", "root", "n", *_PRINT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(shingle_hashes(t, words, seed)).tobytes() for t in encoded(b.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.binary())], names=[*columns, "hashes"])

    cut = arrow_map(texts(wanted).select(*columns, "text"), run, ", ".join(f"{c} long" for c in columns) + ", hashes binary")
    met = _spread(cut, "root", "cls", "n").select("root", "block", "home", "cls", *_PRINT, "hashes")
    return arrow_map(met, _alike(most, least), "u long, v long")


def near_copies_removed(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = COPY_WORDS, least: float = SIMILARITY, most: tuple[int, int] = WIDE_BITS, seed: int = SEED) -> DataFrame:
    """One row stays of those that Jaccard similarities of `least` or more between shingle sets join, directly or
    over others: the one with the smallest id (nulls last), then the smallest text hash.

    Fingerprints are those of the distinct shingles. Null and wordless texts have the same, empty, set and are one
    class. Equal rows of the winning id and text count as one. Empty table: no rows. All columns pass unchanged.
    """
    cls, key, n, *prints = (free_name(df, f"copy_{x}") for x in ("class", "key", "n", *_PRINT))
    own_key = F.struct(F.xxhash64(ident, text).alias("h"), F.col(ident).alias("i"))

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            sets = [np.unique(shingle_hashes(t, words, seed)) for t in encoded(texts)]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64)
            words_of = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            return [pa.array(ids.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words_of.T)]

        return run

    result = StructType([StructField(x, LongType()) for x in (cls, n, *prints)])
    rows = stash(map_texts(df.select(F.col(text), own_key.alias(key)), text, result, make, keep=[key]))
    order = F.struct(F.col(f"{key}.i").isNull().alias("none"), F.col(f"{key}.i").alias("i"), F.col(f"{key}.h").alias("h"))
    sets = rows.groupBy(F.col(cls).alias("cls")).agg(F.min(order).alias("w"), *(F.first(x).alias(y) for x, y in zip((n, *prints), ("n", *_PRINT), strict=True)))
    sets = stash(sets.select("cls", F.struct(F.col("w.h").alias("h"), F.col("w.i").alias("i")).alias("w"), "n", *_PRINT))

    def texts(wanted: DataFrame) -> DataFrame:
        """The text of a row of each wanted class, from the table itself."""
        asked = stash(wanted.join(sets.select("cls", "w"), "cls"))
        return df.select(own_key.alias(key), F.col(text).alias("text")).join(small(asked, 96), F.col(key) == F.col("w"))

    roots = components(_copy_links(sets, texts, words, least, most, seed)).select(F.col("u").alias("cls"), F.col("v").alias("root"))
    order = F.struct(F.col("w.i").isNull().alias("none"), F.col("w.i").alias("i"), F.col("w.h").alias("h"))
    win = sets.select("cls", "w").join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min(order).alias("o"))
    again = rows.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1")
    win = win.select(F.struct(F.col("o.h").alias("h"), F.col("o.i").alias("i")).alias("w"))
    win = stash(win.join(again, F.col("w") == F.col("again"), "left").select("w", F.col("again").isNotNull().alias("often")))
    marked = df.withColumn(key, own_key)
    # only rows that stand in the table more than once are dealt for it
    once = marked.join(small(win.where("not often"), 48), F.col(key) == F.col("w"), "left_semi")
    one = marked.join(small(win.where("often"), 48), F.col(key) == F.col("w"), "left_semi").dropDuplicates([key])
    return once.unionByName(one).select(*df.columns)
