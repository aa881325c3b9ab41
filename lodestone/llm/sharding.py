"""Sharding by a two-pass external shuffle (operator 4), DataFrame functions only.

Pass 1 scatters records into memory-sized buckets by a seeded hash; pass 2 shuffles each bucket by Fisher and
Yates (Spark's `shuffle`, which is that) and numbers its records. The law kept is `key`: the shard
follows from id and shard count alone, by the highest of one hash per shard (rendezvous), so a
further shard takes records only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, small, stash

SHARDS, SEED, BUCKET_BYTES = 16, 11, 16 << 20


def rendezvous(ident: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, from 0, whose hash with the id is highest."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), ident).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def record_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(df: DataFrame, ident: str = "doc_id", size: str | None = None, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Append shard, bucket, slot and grown_shard (with one more shard) to each row of df.

    slot: the record's place in its shard, gapless from 0: buckets in order, each in shuffled order. A bucket holds
    about bucket_bytes by `size` (default: bytes of `text` plus 1), which bounds what a task gathers: a shard has as
    many buckets as its own bytes ask for, and the bucket comes from a hash of the whole row, so rows that
    share an id spread over all buckets of their shard. Same rows, seed and bucket size: same slots, in whatever
    order rows are read. Equal rows share a bucket, any order among them, unless they would fill one: then they are dealt by
    place, and only shards are the same on every order of reading. Null id: hashed as such, one shard. Empty
    table: no rows. Columns named shard, bucket, slot or grown_shard are replaced.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("shard", "bucket", "slot", "grown_shard")])
    weight = F.col(size) if size else record_size(F.col(text))
    rec, n, first, own, part = (free_name(rows, x) for x in ("rec", "n_rec", "first_rec", "own_hash", "part"))
    shard, whole = rendezvous(F.col(ident), shards, seed), F.xxhash64(F.lit(seed + 1), *rows.columns)
    sums = {r[0]: r[1] for r in rows.groupBy(shard.alias("shard")).agg(F.sum(weight)).collect()}  # a row for each shard
    parts = [max(1, -(-(sums.get(s) or 0) // bucket_bytes)) for s in range(shards)]
    heavy = stash(rows.groupBy(whole.alias(own)).agg(F.sum(weight).alias("w"), F.count("*").alias("m")).where((F.col("w") > bucket_bytes) & (F.col("m") > 1)).select(own))
    per_shard = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("shard") + 1)
    placed = rows.select(F.struct(*rows.columns).alias(rec), shard.alias("shard"), whole.alias(own))
    if heavy.count():  # no more of them than buckets
        place = placed.withColumn(n, F.monotonically_increasing_id()).join(small(heavy.withColumn(part, F.lit(1)), 16), own, "left")
        placed = place.select(rec, "shard", F.when(F.col(part).isNotNull(), F.xxhash64(own, n)).otherwise(F.col(own)).alias(own))
    # pass 1: twice as many partitions as buckets, so that few share one; the count is given, so Spark keeps it and reruns agree
    scattered = placed.select(rec, "shard", F.pmod(F.col(own), per_shard).cast("int").alias("bucket")).repartition(2 * sum(parts), "shard", "bucket")
    # pass 2: arrays and buckets are sorted first, as the shuffle draws from one sequence a partition; so arrival decides nothing
    buckets = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(rec)).alias(rec)).sortWithinPartitions("shard", "bucket")
    buckets = stash(buckets.select("shard", "bucket", F.shuffle(rec, seed).alias(rec)).withColumn(n, F.size(rec)))
    heads = stash(buckets.select("shard", "bucket", (F.sum(n).over(Window.partitionBy("shard").orderBy("bucket")) - F.col(n)).alias(first)))
    placed = buckets.drop(n).join(small(heads, 32), ["shard", "bucket"]).select("shard", "bucket", first, F.posexplode(rec).alias("pos", rec))
    out = placed.select(f"{rec}.*", "shard", "bucket", (F.col(first) + F.col("pos")).cast("long").alias("slot"))
    return out.withColumn("grown_shard", rendezvous(F.col(ident), shards + 1, seed))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Assign and write Parquet under path/shard=k/bucket=b, each bucket one file in slot order."""
    placed = assign(df, **options).drop("grown_shard")
    placed.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)
