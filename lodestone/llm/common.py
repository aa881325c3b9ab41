"""Pieces that the training-data operators share: row-wise Arrow maps, written tables, sizes.

Column rule of every operator here: result columns replace input columns of the same name
(names compare without case), all other input columns pass through untouched.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: What the engine counts as a word, as a Java and Python pattern: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one under the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


_shipped: set[str] = set()


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, once executors can import this package: Spark ships it where PYTHONPATH doesn't name it."""
    context = df.sparkSession.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    if context.applicationId not in _shipped and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = os.path.join(tempfile.mkdtemp(), os.path.basename(package) + ".zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(trimmed, schema)


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and an executor's limit holds for all of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's folder under the shared one; Hadoop deletes it when the application ends."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        _folders[context.applicationId] = f"{checkpoint_root(spark)}/lodestone-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(_folders[context.applicationId])
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[context.applicationId]


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound, else df as it is. df must be a stashed table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def other_fields(df: DataFrame, replaced: Iterable[str]) -> list[StructField]:
    gone = {x.lower() for x in replaced}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def map_texts(df: DataFrame, text: str, result: StructType, make: Callable[[], Callable[[pa.Array], list]], keep: list[str] | None = None) -> DataFrame:
    """Append the columns of `result`, computed batch by batch in Arrow from the text column.

    make() runs once a task and returns the function from an Arrow string array to a list of Arrow
    arrays. keep: input columns to pass on (None: all). Batches are bounded by Spark's
    spark.sql.execution.arrow.maxBytesPerBatch, so long texts don't pile up in a worker.
    """
    fields = [f for f in other_fields(df, result.names) if keep is None or f.name in keep]
    schema = StructType(fields + result.fields)
    names = [f.name for f in fields]
    at = {c: i for i, c in enumerate(df.columns)}
    to, text_at, keep_at = to_arrow_schema(schema), at[text], [at[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            if b.num_rows:
                cols = [b.column(i) for i in keep_at] + compute(b.column(text_at))
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, to, strict=True)], schema=to)

    return arrow_map(df, run, schema)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; b'' for null."""
    return [b or b"" for b in texts.cast(pa.large_binary()).to_pylist()]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one uint8 array and the n + 1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    a = texts.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


# ---- rolling hashes: H(i, n) = sum of v[b] * B**(k - i), taken from prefix sums modulo 2**64 ----

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_V = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (three multiply-xor-shift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in ((0, _B), (1, _B_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """64-bit hashes of any substrings of one byte array, vectorised; equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_V[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of each substring of length k."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + np.uint64(k))
