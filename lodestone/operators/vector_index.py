"""A stored vector index: rows in cells round centres, so that a search reads the cells near its query.

Two Parquet tables under one path: `cells` (cell, centre, radius, n) and `rows` (key, v; partitioned by cell). Centres
are fitted on at most FIT_ROWS rows, picked by the hash of their key; every usable row is in a cell.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import vectors

FIT_ROWS, MOST_CELLS, CELL_ROWS, SALTS, ROUNDS = 65_536, 4096, 1024, 8, 12
EF, EF_ROWS = 64, 128


def _unit(v: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(size == 0, 1.0).otherwise(size))


def build(df: DataFrame, path: str, vector: str, dim: int, metric: str = "cosine", key: str = "key", cells: int | None = None, seed: int = 7) -> None:
    """Write the index; again whenever the table has changed (REBUILD). cells: by default the square root of the
    rows, one for every CELL_ROWS at least, MOST_CELLS at most. Rows that are not usable() are left out."""
    if metric not in ("cosine", "l2", "ip"):
        raise Refused(f"DISTANCE {metric}")
    rows = df.where(vectors.usable(F.col(vector), dim)).select(F.col(key).cast("string").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    place = _unit if metric == "cosine" else lambda v: v
    n = rows.count()
    k = max(1, min(cells or max(math.isqrt(n), n // CELL_ROWS), MOST_CELLS, FIT_ROWS // 4))
    points = rows.withColumn("p", array_to_vector(place(F.col("v"))))
    if n:
        fit = points.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n * 2 // FIT_ROWS))) == 0).limit(FIT_ROWS)
        model = KMeans(k=k, seed=seed, maxIter=ROUNDS, featuresCol="p", predictionCol="cell").fit(fit if n > FIT_ROWS else points)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        placed = model.transform(points).drop("p")
    else:
        centres, placed = [], points.withColumn("cell", F.lit(0)).drop("p")
    # a frequent cell fills several files
    placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(SALTS))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = df.sparkSession
    middle = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    far = F.sqrt(vectors.distance("l2", place(F.col("v")), F.col("centre")))
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    facts = stored.join(F.broadcast(middle), "cell").groupBy("cell").agg(F.max(far).alias("radius"), F.count("*").alias("n"))
    head = {"metric": F.lit(metric), "dim": F.lit(dim), "cells": F.lit(len(centres))}
    middle.join(facts, "cell").withColumns(head).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _least(metric: str, q: list[float], centre: list[float], radius: float) -> float:
    """No row of the cell is closer than this, less a little for rounding."""
    if metric == "l2":
        return max(0.0, math.dist(q, centre) - radius) ** 2 * (1 - 1e-9) - 1e-12
    near = sum(a * b for a, b in zip(q, centre, strict=True)) + math.sqrt(sum(a * a for a in q)) * radius
    return (1 - near if metric == "cosine" else -near) - 1e-9 * (1 + abs(near))


def knn(spark: SparkSession, path: str, query: list[float], k: int = vectors.LIMIT, ef: int = EF, exact: bool = False) -> DataFrame:
    """The k closest rows (key, dist), ties by key, of the cells nearest to the query that hold EF_ROWS * ef rows or more.

    exact: the cells that could still hold a closer row are read as well, by the distance to their centre less
    their radius; the answer is then that of vectors.knn().
    """
    if not 16 <= ef <= 4096:
        raise Refused("EF is 16..4096")
    k = max(1, min(k, vectors.MOST_LIMIT))
    cells = spark.read.parquet(f"{path}/cells").collect()  # MOST_CELLS at most
    rows = spark.read.schema("key string, v array<double>, cell int").parquet(f"{path}/rows") if cells else None
    if rows is None:
        return spark.createDataFrame([], "key string, dist double")
    metric, dim = cells[0].metric, cells[0].dim
    if len(query) != dim:
        raise Refused(f"DIM is {dim}")
    q = [float(x) for x in query]
    score = vectors.distance(metric, F.col("v"), F.array(*map(F.lit, q)))
    if metric == "cosine":
        size = math.sqrt(sum(x * x for x in q)) or 1.0
        q = [x / size for x in q]
    mid = (lambda c: math.dist(q, c.centre)) if metric != "ip" else (lambda c: -sum(a * b for a, b in zip(q, c.centre, strict=True)))
    first, held = [], 0
    by_distance = sorted(cells, key=lambda c: (mid(c), c.cell))
    for c in by_distance:
        if held >= max(k, EF_ROWS * ef):
            break
        first.append(c.cell)
        held += c.n

    def best(of: list[int]) -> DataFrame:
        return rows.where(F.col("cell").isin(*of)).select("key", score.alias("dist")).orderBy("dist", "key").limit(k)

    if exact and len(first) < len(cells):
        last = best(first).agg(F.max("dist").alias("d"), F.count("*").alias("n")).first()
        more = [c.cell for c in by_distance[len(first) :] if last.n < k or _least(metric, q, c.centre, c.radius) <= last.d]
        first += more
    return best(first)
