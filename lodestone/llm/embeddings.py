"""Embedding near-duplicates by int8 tile products with error bounds (operator 3).

Vectors meet only within a label. Equal vectors form one class first. Classes are dealt into tiles; a tile pair is
multiplied in int8 (each unit vector has its own scale), and since x.y differs from the product of the
quantised vectors by at most |x^| |e_y| + |e_x| |y|, with e the quantisation error of each vector, only
pairs whose product plus that bound reaches the threshold are computed again in double precision.
Tiles follow cells of two fixed projections: unit vectors at cosine t are sqrt(2 - 2t) apart, and so are their
projections at most; cells further apart than one cell never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, free_name, small, stash
from lodestone.llm.components import components, forest

#: Vectors of a tile, and bytes of it if they are long; a cell of n tiles sends each of them n times.
THRESHOLD, TILE, TILE_BYTES = 0.98, 8192, 32 << 20
#: Entries of a product that a task holds at once.
BLOCK = 512


def _directions(dim: int) -> np.ndarray:
    d = np.random.default_rng(dim).standard_normal((dim, 2))
    return d / np.linalg.norm(d, axis=0)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cells(width: float):
    """(cid, embedding) -> (cid, c1, c2): cell of the unit vector's two projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array(b.column(1).value_lengths())
            out = np.zeros((b.num_rows, 2), np.int32)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = _matrix(b.column(1).take(pa.array(at)), int(dim))
                out[at] = np.floor(x @ _directions(int(dim)) / np.linalg.norm(x, axis=1, keepdims=True) / width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["cid", "c1", "c2"])

    return run


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 rows, scales, norms of the quantised vectors and of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b with cosine >= threshold in double precision."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, na, ea = quantised(a / norm_a[:, None])
    qb, sb, _, eb = quantised(b / norm_b[:, None])
    # a float product of int8 is exact while dim * 127 ** 2 stays below the mantissa
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = qb.astype(kind).T
    out = []
    for lo in range(0, len(a), BLOCK):
        hi = min(len(a), lo + BLOCK)
        top = (qa[lo:hi].astype(kind) @ right) * sa[lo:hi, None] * sb[None, :] + na[lo:hi, None] * eb[None, :] + ea[lo:hi, None]
        i, j = np.nonzero(top >= threshold - 1e-9)
        for k in range(0, len(i), 1 << 17):
            x, y = i[k : k + (1 << 17)] + lo, j[k : k + (1 << 17)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold
            out.append((x[ok], y[ok]))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (np.zeros(0, np.int64),) * 2


def _products(threshold: float):
    """Tile pairs -> (kind, u, v): 0 adds v links to class u, 1 is an edge of a spanning forest of the pair's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for at in (0, 1):
                    rows = batch.column(at)[k].values
                    ids, n, vectors = rows.field("cid").to_numpy(), rows.field("n").to_numpy(), rows.field("embedding")
                    sides.append((ids, n, _matrix(vectors, len(vectors[0]))))
                (ids_a, n_a, a), (ids_b, n_b, b) = sides
                i, j = near_pairs(a, b, threshold)
                if batch.column(2)[k].as_py():
                    i, j = i[ids_a[i] < ids_b[j]], j[ids_a[i] < ids_b[j]]
                if len(i):
                    more = np.concatenate([ids_a[i], ids_b[j]])
                    ids, at = np.unique(more, return_inverse=True)
                    links = np.bincount(at, np.concatenate([n_b[j], n_a[i]])).astype(np.int64)
                    u, v = forest(ids_a[i], ids_b[j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(ids), len(u)])), pa.array(np.concatenate([ids, u])), pa.array(np.concatenate([links, v]))], names=["kind", "u", "v"])

    return run


def link(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Append n_links, component_id and kept to each row; columns of these names are replaced.

    Rows with a null label, or a vector that is null, empty, zero or holds null or non-finite components,
    link with nothing: 0 links, their own id. Vectors of different length never link. Equal vectors are
    linked to each other. Null ids take part and are never the smallest. Empty table: no rows.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("n_links", "component_id", "kept")])
    mark, val = free_name(rows, "near_class"), free_name(rows, "near_valid")
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn(val, F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite, F.lit(False)))
    rows = rows.withColumn(mark, F.when(F.col(val), F.struct(*[F.xxhash64(F.lit(k), F.col(label), v.cast("array<double>")).alias(f"h{k}") for k in (0, 1)])))
    classes = rows.where(val).groupBy(F.col(label).alias("label"), v.cast("array<double>").alias("embedding")).agg(F.min(ident).alias("low"), F.count("*").alias("n"), F.first(mark).alias("mark"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()))
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    cells = stash(arrow_map(classes.select("cid", "embedding"), _cells(width), "cid long, c1 int, c2 int"))
    where = ["label", "dim", "c1", "c2"]
    placed = classes.join(cells, "cid").withColumn("dim", F.size("embedding"))
    counts = stash(placed.groupBy(where).agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(tile), F.lit(TILE_BYTES) / (8 * F.first("dim"))))).cast("int").alias("parts")))
    placed = placed.join(small(counts, 64), where).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # dealt by tile, since the join's dealing by cell would bring all tiles of a hot cell into one task
    tiles = stash(placed.repartition(*where, "sub").groupBy(*where, "sub").agg(F.collect_list(F.struct("cid", "n", "embedding")).alias("rows")))
    keys = tiles.select(*where, "sub")
    # half of the neighbouring cells; within a cell each pair of tiles once
    moves = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    asks = keys.select("label", "dim", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("sub").alias("a_sub"), F.explode(moves).alias("m"))
    asks = asks.select("*", (F.col("a1") + F.col("m.x")).alias("c1"), (F.col("a2") + F.col("m.y")).alias("c2"))
    same = (F.col("m.x") == 0) & (F.col("m.y") == 0)
    pairs = asks.join(keys, where).where(~same | (F.col("a_sub") <= F.col("sub"))).withColumn("same", same & (F.col("a_sub") == F.col("sub")))
    left = tiles.select("label", "dim", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("sub").alias("a_sub"), F.col("rows").alias("a"))
    met = pairs.join(left, ["label", "dim", "a1", "a2", "a_sub"]).join(tiles.withColumnRenamed("rows", "b"), [*where, "sub"]).select("a", "b", "same")
    found = stash(arrow_map(met, _products(threshold), "kind int, u long, v long"))
    sums = found.where("kind = 0").groupBy(F.col("u").alias("cid")).agg(F.sum("v").alias("more"))
    roots = components(found.where("kind = 1").select("u", "v")).select(F.col("u").alias("cid"), F.col("v").alias("root"))
    named = stash(classes.select("cid", "mark", "low", "n").join(sums, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = stash(named.groupBy("root").agg(F.min("low").alias("component")))  # a plain table, so that a large component can be split
    # vectors stay where they are: rows meet their class by 128 bits of hashes
    named = stash(named.join(least, "root").select("mark", "component", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links")))
    named = named.toDF(*[free_name(rows, x) for x in ("m_", "c_", "n_")])
    marks, comp, links = named.columns
    out = rows.join(named, F.col(mark) == F.col(marks), "left")
    own = F.when(F.col(val), F.col(comp)).otherwise(F.col(ident))
    return out.select(*[c for c in rows.columns if c not in (val, mark)], F.coalesce(F.col(links), F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col(ident).eqNullSafe(own).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (a.norm * b.norm) >= {THRESHOLD}
), r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u
), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.u LEFT JOIN n ON e.vec_id = n.u
"""
