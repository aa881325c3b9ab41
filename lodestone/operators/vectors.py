"""Exact nearest neighbours by cosine, squared L2 and inner product, and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import Refused

LIMIT, MOST_LIMIT, RRF_K = 10, 1000, 60


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is closer: 1 - cosine, squared L2, or minus the inner product. A zero vector stays unnormalised."""
    if metric == "ip":
        return -_dot(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        norm = lambda v: F.when(_dot(v, v) == 0, 1.0).otherwise(F.sqrt(_dot(v, v)))
        return 1 - _dot(a, b) / (norm(a) * norm(b))
    raise Refused(f"DISTANCE {metric}")


def usable(v: Column, dim: int) -> Column:
    """Vectors of another length or with a non-finite component are not in the index."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def knn(df: DataFrame, vector: str, query: list[float], k: int = LIMIT, metric: str = "cosine", key: str = "key", ef: int | None = None) -> DataFrame:
    """The k closest rows with `dist`, ties by key: one scan and a distributed top-k. ef is taken and changes nothing."""
    if ef is not None and not 16 <= ef <= 4096:
        raise Refused("EF is 16..4096")
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.where(usable(F.col(vector), len(query))).withColumn("dist", distance(metric, F.col(vector), q))
    return rows.orderBy("dist", key).limit(max(1, min(k, MOST_LIMIT)))


def rrf(lists: list[DataFrame], limit: int = LIMIT, k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (key, rank from 1): score = sum of 1 / (k + rank), ties by key. Lists are pages, hence small."""
    each = [x.select("key", F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)]
    both = each[0]
    for x in each[1:]:
        both = both.unionByName(x)
    parts = F.sort_array(F.collect_list(F.struct("list", (F.lit(1.0) / (k + F.col("rank"))).alias("s"))))
    return both.groupBy("key").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def ranked(page: DataFrame, *order) -> DataFrame:
    """Number a page (at most a few thousand rows) from 1."""
    return page.select("key", F.row_number().over(Window.orderBy(*order)).alias("rank"))
