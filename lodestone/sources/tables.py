"""Sources and sinks: Parquet, CSV and JSON tables, declared coercion, windowed layouts, command dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import Table
from lodestone.errors import Refused
from lodestone.operators import paths


def read(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    if form not in ("parquet", "csv", "json", "orc", "text"):
        raise Refused(f"source format {form}")
    return spark.read.options(**options).format(form).load(path)


def typed(df: DataFrame, table: Table) -> DataFrame:
    """The declared columns in their declared types (null where a value does not coerce), and the key."""
    return paths.keyed(df, table).select("key", *[(F.col(c) if kind == "vector" else paths.value(df, table, c)).alias(c) for c, kind in table.columns])


def save(df: DataFrame, path: str, table: Table | None = None, mode: str = "error") -> None:
    """Snapshot as Parquet; a table with a WINDOW is partitioned by bucket, so old buckets are pruned."""
    if table is not None and table.window:
        bucket = F.floor(paths.value(df, table, table.window.column) / table.window.bucket)
        df.withColumn("window_bucket", bucket).write.mode(mode).partitionBy("window_bucket").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, n: int) -> None:
    """A catalog table bucketed by a column: joins and groups by it need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, by).sortBy(by).saveAsTable(name)


def dump(df: DataFrame) -> DataFrame:
    """(key, type, fields map[, expire_at]) -> one line `HSET key field value ..` or `PEXPIREAT key ms` per command.

    Arguments are JSON strings, so blanks and line feeds survive. Fields come in order of name.
    """
    quoted = lambda c: F.to_json(F.array(c))
    one = lambda c: F.substring(quoted(c), F.lit(2), F.char_length(quoted(c)) - 2)
    args = F.array_join(F.flatten(F.transform(F.sort_array(F.map_entries("fields")), lambda e: F.array(one(e["key"]), one(e["value"])))), " ")
    line = F.concat(F.lit("HSET "), one(F.col("key")), F.lit(" "), args)
    ttl = F.when(F.col("expire_at").isNotNull(), F.concat(F.lit("PEXPIREAT "), one(F.col("key")), F.lit(" "), F.col("expire_at").cast("string"))) if "expire_at" in df.columns else F.lit(None).cast("string")
    return df.select(F.explode(F.filter(F.array(line, ttl), lambda x: x.isNotNull())).alias("value"))


def _arg(c) -> Column:
    """An argument as a JSON string."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)


def dump_strings(df: DataFrame) -> DataFrame:
    """(key, value[, expire_at]) -> `SET key value` and deadlines."""
    late = F.concat(F.lit("PEXPIREAT "), _arg("key"), F.lit(" "), F.col("expire_at").cast("string")) if "expire_at" in df.columns else F.lit(None).cast("string")
    return df.select(F.explode(F.filter(F.array(F.concat(F.lit("SET "), _arg("key"), F.lit(" "), _arg("value")), late), lambda x: x.isNotNull())).alias("value"))


def dump_lists(df: DataFrame) -> DataFrame:
    """(key, items array) -> `RPUSH key item ..`; an empty list has no line."""
    return df.where(F.size("items") > 0).select(F.concat(F.lit("RPUSH "), _arg("key"), F.lit(" "), F.array_join(F.transform("items", _arg), " ")).alias("value"))


def dump_sets(df: DataFrame) -> DataFrame:
    """(key, member) -> `SADD key member`, a line each, so that no set meets in one place."""
    return df.select(F.concat(F.lit("SADD "), _arg("key"), F.lit(" "), _arg("member")).alias("value"))


def dump_zsets(df: DataFrame) -> DataFrame:
    """(key, member, score) -> `ZADD key score member`, a line each."""
    return df.select(F.concat(F.lit("ZADD "), _arg("key"), F.lit(" "), _arg(F.col("score").cast("string")), F.lit(" "), _arg("member")).alias("value"))


def _commands(lines: DataFrame) -> DataFrame:
    """(line, verb, key, args): arguments after the key. Lines are in order of their column `line`, else as they are read."""
    at = F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()
    words = F.regexp_extract_all(F.regexp_extract("value", r"(?s)^\S+ (.*)$", 1), F.lit(r'"(?:[^"\\]|\\.)*"|[0-9]+'), F.lit(0))
    args = F.from_json(F.concat(F.lit("["), F.array_join(words, ","), F.lit("]")), "array<string>")
    rows = lines.select(at.alias("line"), F.upper(F.split_part("value", F.lit(" "), F.lit(1))).alias("verb"), args.alias("a"))
    return rows.select("line", "verb", F.get("a", F.lit(0)).alias("key"), F.slice("a", 2, 2147483647).alias("args"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(key, line, pos, one, two) of arguments that come in pairs."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("args") - 2, F.lit(2)), lambda i: F.struct(F.get("args", i).alias("one"), F.get("args", i + 1).alias("two")))
    return rows.where(F.size("args") >= 2).select("key", "line", F.posexplode(pairs).alias("pos", "p")).select("key", "line", "pos", "p.one", "p.two")


def load(lines: DataFrame) -> DataFrame:
    """dump() lines -> (key, fields, expire_at); of a field set more than once, in a line or over lines, the last counts."""
    rows = _commands(lines)
    last = _pairs(rows.where("verb = 'HSET'")).groupBy("key", "one").agg(F.max_by("two", F.struct("line", "pos")).alias("two"))
    fields = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("one", "two"))).alias("fields"))
    late = rows.where("verb = 'PEXPIREAT'").groupBy("key").agg(F.max_by(F.get("args", F.lit(0)).cast("long"), "line").alias("expire_at"))
    return fields.join(late, "key", "left")


def load_all(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines of all dumps -> frames by type: hash, string (key, value, expire_at), list (key, items), set (key, member), zset (key, member, score)."""
    rows = _commands(lines)
    late = rows.where("verb = 'PEXPIREAT'").groupBy("key").agg(F.max_by(F.get("args", F.lit(0)).cast("long"), "line").alias("expire_at"))
    strings = rows.where("verb = 'SET'").groupBy("key").agg(F.max_by(F.get("args", F.lit(0)), "line").alias("value")).join(late, "key", "left")
    pushed = rows.where("verb = 'RPUSH'").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("line", "args"))).alias("x")).select("key", F.flatten(F.transform("x", lambda y: y["args"])).alias("items"))
    members = rows.where("verb = 'SADD'").select("key", F.explode("args").alias("member")).distinct()
    scores = _pairs(rows.where("verb = 'ZADD'")).groupBy("key", F.col("two").alias("member")).agg(F.max_by(F.col("one").cast("double"), F.struct("line", "pos")).alias("score"))
    return {"hash": load(lines), "string": strings, "list": pushed, "set": members, "zset": scores}
