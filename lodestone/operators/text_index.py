"""A stored full-text index: postings in buckets of terms, so that a search reads the terms it asks for.

Three Parquet tables under one path: `postings` (term, key, field, pos, dls; partitioned by bucket, sorted by term),
`lengths` (key, dls) and `totals` (a row for each field and one for all). dls: tokens of each field of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import Refused
from lodestone.operators import text

BUCKETS, SALTS = 64, 8


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(df: DataFrame, path: str, fields: tuple[str, ...], key: str = "key", buckets: int = BUCKETS, cut: text.Tokenizer = text.WORDS) -> None:
    """Write the index of some text fields; again whenever the table has changed (REBUILD). Postings are dealt by bucket and key, so that a frequent term fills several tasks."""
    terms = F.explode(F.array(F.struct(*[cut.column(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)]))).alias("x")
    rows = df.select(F.col(key).alias("key"), terms).select("key", F.array(*[F.size(f"x.t{i}") for i in range(len(fields))]).alias("dls"), "x")
    rows.select("key", "dls").write.mode("overwrite").parquet(f"{path}/lengths")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.t{i}").alias("t")) for i, f in enumerate(fields)]))
    tokens = rows.select("key", "dls", each.alias("f")).select("key", "dls", F.col("f.field").alias("field"), F.posexplode("f.t").alias("pos", "term"))
    tokens = tokens.withColumns({"bucket": _bucket(F.col("term"), buckets), "salt": F.pmod(F.hash("key"), F.lit(SALTS))}).repartition("bucket", "salt")
    found = tokens.groupBy("bucket", "salt", "term", "key", "field", "dls").agg(F.sort_array(F.collect_list("pos")).alias("pos")).drop("salt")
    found.sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = df.sparkSession.read.parquet(f"{path}/lengths")
    every = F.aggregate("dls", F.lit(0), lambda a, x: a + x)
    parts = [F.struct(F.lit(f).alias("field"), F.get("dls", F.lit(i)).alias("dl")) for i, f in enumerate(fields)]
    totals = lengths.select(F.explode(F.array(F.struct(F.lit(None).cast("string").alias("field"), every.alias("dl")), *parts)).alias("p")).where("p.dl > 0")
    totals = totals.groupBy("p.field").agg(F.count("*").alias("docs"), F.sum("p.dl").alias("tokens"))
    totals.withColumns({"fields": F.array(*map(F.lit, fields)), "buckets": F.lit(buckets)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def match(spark: SparkSession, path: str, query: str, within: tuple[str, ...] = (), weights: dict[str, float] | None = None, typo: int = 0, cut: text.Tokenizer = text.WORDS) -> DataFrame:
    """(key, score) of every match, as text.match_texts() finds them from the texts. An index without a token has no match.

    Bare terms and phrases read their buckets only; prefixes and typos read the terms of all.
    """
    if not 0 <= typo <= 2:
        raise Refused("TYPO is 0, 1 or 2")
    q = text.parse(query, cut=cut)
    totals = spark.read.parquet(f"{path}/totals").collect()  # a row for each field
    kind = dict(spark.read.parquet(f"{path}/lengths").dtypes)["key"]
    post = spark.read.schema(f"term string, key {kind}, dls array<int>, field string, pos array<int>, bucket int").parquet(f"{path}/postings")
    if not totals:
        return post.select("key", F.lit(0.0).alias("score"))
    fields, buckets = totals[0].fields, totals[0].buckets
    if wrong := set(within) - set(fields):
        raise Refused(f"IN {', '.join(sorted(wrong))}: not in this index")
    scope = [i for i, f in enumerate(fields) if not within or f in within]
    n = next((t.docs for t in totals if t.field is None), 0)
    known = {t.field: (t.docs, t.tokens) for t in totals}
    one = None if len(scope) == len(fields) else fields[scope[0]] if len(scope) == 1 else ""
    if one == "":
        dl = sum((F.get("dls", F.lit(i)) for i in scope), F.lit(0))
        found = spark.read.parquet(f"{path}/lengths").select(dl.alias("dl")).where("dl > 0").agg(F.count("*").alias("d"), F.sum("dl").alias("t")).first()
        docs, size = found.d, found.t
    else:
        docs, size = known.get(one, (0, 0))
    exact = sorted({*q.terms, *(t for p in q.phrases for t in p)})
    test = F.col("term").isin(*exact) if exact else F.lit(False)
    if exact and not q.prefixes and not typo:
        test &= F.col("bucket").isin(*[r[0] for r in spark.createDataFrame([(t,) for t in exact], "t string").select(_bucket(F.col("t"), buckets)).collect()])
    for p in q.prefixes:
        test |= F.col("term").startswith(p)
    if typo:
        for t in q.terms:
            test |= text.near(F.col("term"), t, typo)
    hits = post.where(test)
    if within:
        hits = hits.where(F.col("field").isin(*within))
    weight = F.lit(1.0)
    for f, w in (weights or {}).items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    length = sum((F.get("dls", F.lit(i)) for i in scope), F.lit(0))
    tf = hits.groupBy("key", "term", length.alias("dl")).agg(F.sum(F.greatest(F.ceil(F.size("pos") * weight), F.lit(1))).alias("tf"))
    scored = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
    score = text.bm25(F.col("tf"), F.col("df"), F.lit(n), F.col("dl"), F.lit(size / docs if docs else 1.0))
    out = scored.groupBy("key").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("term", score.alias("s")))), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))
    for phrase in q.phrases:
        places = hits.where(F.col("term").isin(*set(phrase))).select("key", "field", "term", F.explode("pos").alias("pos"))
        out = out.join(text.with_phrase(places, phrase), "key", "left_semi")
    return out
