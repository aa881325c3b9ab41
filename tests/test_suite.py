"""Every registered query of the engine against its SQL in DuckDB, and at another number of partitions."""

import glob
import os

import duckdb
import pytest

from lodestone.plans import suite


def rows(got, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in at) for r in got), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, sf, duck, name):
    df = suite.QUERIES[name](spark, sf)
    got = rows(df.collect(), df.columns)
    if name in suite.ORACLES:
        cursor = duck.execute(suite.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", ["facet_counts", "bm25_or", "agg_groups_sum", "zunion_weighted", "distinct_best", "group_pending"])
def test_partitions_change_nothing(spark, sf, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = suite.QUERIES[name](spark, sf)
        return rows(df.collect(), df.columns)

    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("name", ["bm25_phrase", "bm25_prefix", "bm25_indexed_phrase", "bm25_indexed_prefix"])
def test_pages_as_long_as_in_sql(spark, tmp_path, name):
    """More matches than a page holds, which sf0.001 lacks."""
    docs = [(k, " ".join(["apache license"] * (k % 3 + 1) + ["word"] * k), "en", "src1") for k in range(45)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(suite.ORACLES[name]).fetchall()
    assert len(want) == (30 if name.endswith("phrase") else 20)
    assert [tuple(r) for r in suite.QUERIES[name](spark, str(tmp_path)).select("key", "score").collect()] == want


@pytest.mark.parametrize("name", ["scalar_mysql_dates", "scalar_to_char"])
def test_years_of_any_length(spark, tmp_path, name):
    """Keys are days since 1970: years before 1, below 1000 and from 10000 on."""
    days = [0, -1, 2932896, 2932897, 8999999, 106751990, -700000, -719162, -719163, -719528, -719529, -800000, -10000000, -106000000]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE TABLE orders AS SELECT unnest({days})::BIGINT AS o_orderkey, make_timestamp(o_orderkey * 86400000000 + 3723000000) AS o_orderdate UNION ALL SELECT 7, NULL")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df = suite.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(suite.ORACLES[name])
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), [c[0] for c in cursor.description])
