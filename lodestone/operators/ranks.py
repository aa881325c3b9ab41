"""Places of rows in an order, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may sort; a larger table is ranked in pieces, MOST_PIECES at most.
PIECE_ROWS, MOST_PIECES = 1 << 20, 1024
#: Up to so many rows of a group Spark limits a window in each task first (spark.sql.optimizer.windowGroupLimitThreshold).
TOP_ROWS = 1000


def numbered(df: DataFrame, by: str, order: tuple[str, ...], name: str = "_r", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """df with each row's place `name` (from 1) among the rows of its `by`, by ascending `order`, nulls first.

    A table of more than `piece_rows` rows is cut at borders, rows picked by their hash: a piece is ranked by
    itself, and the rows in the pieces before it are added. Borders only deal the work, so places are those of one
    sort; rows with equal `by` and `order` stay in one piece. Of all borders and offsets there are about as many as
    pieces, whatever the number of groups, so both are broadcast. df must give the same rows each time it is read.
    """
    place = lambda *more: F.row_number().over(Window.partitionBy(by, *more).orderBy(*order)).cast("long")
    n = df.count()
    if n <= piece_rows:
        return df.withColumn(name, place())
    step = max(piece_rows, -(-n // MOST_PIECES))
    picked = df.where(F.pmod(F.xxhash64(by, *order), F.lit(step)) == 0).select(F.col(by).alias("_by"), F.struct(*order).alias("b"))
    borders = picked.groupBy("_by").agg(F.collect_set("b").alias("_borders"))
    own = F.struct(*order)
    piece = F.coalesce(F.size(F.filter("_borders", lambda b: b < own)), F.lit(0))
    rows = df.join(F.broadcast(borders), F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_piece", piece).drop("_by", "_borders")
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_piece").alias("_p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).where("_p > 0").drop("n")
    out = rows.withColumn(name, place("_piece")).join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_piece") == F.col("_p")), "left")
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).drop("_piece", "_by", "_p", "_before")


def first(df: DataFrame, by: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The first n rows of each `by`. Of few rows tasks keep their own first ones before a group meets."""
    if n > TOP_ROWS:
        return numbered(df, by, order).where(F.col("_r") <= n).drop("_r")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def last(df: DataFrame, by: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The last n rows of each `by`."""
    if n > TOP_ROWS:
        return sizes(numbered(df, by, order), by).where(F.col("_r") > F.col("_n") - n).drop("_r", "_n")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*map(F.desc, order)))).where(F.col("_r") <= n).drop("_r")


def sizes(df: DataFrame, by: str, name: str = "_n") -> DataFrame:
    """df with the number of rows of its `by`, counted before the rows meet it."""
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias(name))
    return df.join(n, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
