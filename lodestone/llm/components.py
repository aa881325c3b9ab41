"""Connected components over edge tables, without gathering edges or nodes anywhere.

Each task first shrinks its edges to a spanning forest with union-find; then large-star and small-star
rounds run until nothing changes. After a round edges are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, stash


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) for all nodes of the edges a-b but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        root = new[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_a, held_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        held_a, held_b = forest(np.concatenate([held_a, b.column(0).to_numpy()]), np.concatenate([held_b, b.column(1).to_numpy()]))
    if len(held_a):
        yield pa.RecordBatch.from_arrays([pa.array(held_a), pa.array(held_b)], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: between a plain table and a table Spark can split the rows of a node with very many neighbours
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long edges -> (u, v): v the smallest node reachable from u, one row for each node that has one below it.

    Edges may repeat, point either way or be loops. Nodes without a smaller one in reach have no row.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    e = stash(arrow_map(e, _shrink, "u long, v long"))
    mark = None
    for _ in range(rounds):
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return e
        mark = seen
        e = stash(_small_star(stash(_large_star(e))))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
