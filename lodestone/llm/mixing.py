"""Mixing sources to target weights (operator 7), DataFrame functions only.

Words are summed by source, a target is dealt to each source, and its rate is target / words. Each document
comes floor(rate) times and once more if a uniform number drawn from a hash of seed, id and text is below the
fraction. Nothing but one row per source is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, free_name, small, stash

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 7


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """MD5 of the text in hexadecimal; 'null' for null."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))


def uniform(seed: int, ident: Column, digest: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5(seed:id:digest); the same on every run and in any engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, words) -> (src, words, target). One row per source comes in.

    Sources in code-point order, null last, weigh `weights` in turn. All get share * (all words) by weight;
    no target exceeds cap * words, and what that cuts off is dealt again by weight to the others. That is
    the level L at which sum(min(cap * words, L * weight)) is the whole: with sources in order of
    cap * words / weight the full ones come first, so running sums give L without a loop.
    """
    if not 0 < share <= cap:
        raise ValueError("share must be above 0 and at most cap")
    order = Window.orderBy(F.col("src").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double"))
    by_fill = Window.orderBy((F.col("words") / F.col("weight")), F.col("src").asc_nulls_last())
    before, after, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    ranked = ranked.withColumns({"whole": share * F.sum("words").over(every), "full": cap * F.coalesce(F.sum("words").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    ranked = ranked.withColumn("level", (F.col("whole") - F.col("full")) / F.col("open"))
    ranked = ranked.withColumn("chosen", F.min_by("level", F.when(F.col("level") <= cap * F.col("words") / F.col("weight"), F.struct(F.col("words") / F.col("weight"), "src"))).over(every))
    target = F.least(cap * F.col("words"), F.coalesce("chosen", F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("src", "words", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def _deals(words: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(src, size) of all documents -> (src, words, target, rate) of each source, as a written table."""
    deals = source_targets(words.groupBy("src").agg(F.sum("size").alias("words")), weights, share, cap)
    return stash(deals.withColumn("rate", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)))


def _emit(df: DataFrame, deals: DataFrame, text: str, source: str, ident: str, seed: int) -> DataFrame:
    rate, key, n = (free_name(df, x) for x in ("mix_rate", "mix_src", "mix_n"))
    joined = df.join(small(deals, 256).select(F.col("src").alias(key), F.col("rate").alias(rate)), df[source].eqNullSafe(F.col(key)), "left")
    copies = F.floor(F.col(rate)) + (uniform(seed, df[ident], digest(df[text])) < F.col(rate) - F.floor(F.col(rate))).cast("long")
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*df.columns)


def mix(df: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of df as often as its source's rate and its draw say, all its columns unchanged.

    Rows are emitted by a map and a join with the table of sources, so that no group of documents, however hot,
    meets in one task. Null text: no words. Null source: a source of its own, last in order. Rows of one id draw
    each for its own text; rows with the same id and text draw alike. A source without words has rate 0. Empty table: no rows.
    """
    return _emit(df, _deals(df.select(F.col(source).alias("src"), word_count(F.col(text)).alias("size")), weights, share, cap), text, source, ident, seed)


def plan_mix(df: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), copies and taken, the rows and words of it that mix() emits.

    Nulls, repeats and empty tables as in mix(). Further columns are not passed on.
    """
    key = F.struct(F.col("id"), F.col("digest"))
    read = df.select(F.col(ident).alias("id"), F.col(source).alias("src"), F.col(text).alias("text"))
    docs = stash(read.select("id", "src", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("digest")))
    deals = _deals(docs, weights, share, cap)
    emitted = _emit(read, deals, "text", "src", "id", seed).select("id", "src", digest(F.col("text")).alias("digest"), word_count(F.col("text")).alias("size"))
    # equal rows draw alike, so what is emitted for them is the same for each
    taken = emitted.groupBy(key.alias("k"), F.col("src").alias("s")).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    rows = docs.groupBy(key.alias("k"), F.col("src").alias("s")).agg(F.count("*").alias("m"))
    each = stash(taken.alias("t").join(rows.alias("r"), (F.col("t.k") == F.col("r.k")) & F.col("t.s").eqNullSafe(F.col("r.s"))).select("t.k", "t.s", (F.col("n") / F.col("m")).cast("long").alias("copies"), (F.col("w") / F.col("m")).cast("long").alias("taken")))
    joined = docs.withColumn("k", key).alias("d").join(each.alias("e"), (F.col("d.k") == F.col("e.k")) & F.col("d.src").eqNullSafe(F.col("e.s")), "left")
    joined = joined.join(small(deals, 256).alias("s"), F.col("d.src").eqNullSafe(F.col("s.src")), "left")
    none = F.lit(0).cast("long")
    return joined.select(F.col("d.id").alias(ident), F.col("d.size"), F.col("s.words").alias("source_size"), "s.target", F.coalesce("e.copies", none).alias("copies"), F.coalesce("e.taken", none).alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source
), r AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(words) OVER () AS BIGINT) AS whole,
    2.0::DOUBLE * CAST(coalesce(sum(words) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
    sum(weight) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over
  FROM r
), l AS (SELECT *, (whole - filled) / left_over AS level FROM f
), c AS (SELECT level FROM l WHERE level <= 2.0::DOUBLE * words / weight ORDER BY words / weight, source NULLS LAST LIMIT 1
), t AS (SELECT source, words, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * words, coalesce((SELECT level FROM c), 'inf'::DOUBLE) * weight) END AS target FROM r
), x AS (
  SELECT d.doc_id, d.size, t.words, t.target, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.digest), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM x
"""
