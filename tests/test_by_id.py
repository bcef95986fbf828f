"""A table laid out by order id: plans, pruning, hot ids, other sessions."""

import glob
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import filters as Fl
from ledgerlens.sources import by_id as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scan returned."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(0, 40_000, 1, 5).select(
        F.when(n % 3 == 0, F.lit(None).cast("string")).otherwise(F.format_string("O%06d", F.pmod(F.hash(n), F.lit(20_000)))).alias("order_id"),
        F.concat(F.lit("M"), n % 50).alias("merchant"), F.lit("2025-07-01 10:00:00").alias("order_time"), n.alias("n"))


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by_id") / "table")
    B.write_by_id(rows, path, buckets=4, options={"parquet.block.size": "65536", "parquet.page.size": "8192", "parquet.page.row.count.limit": "500"})
    return path


def test_rows_are_all_there(spark, rows, table):
    got = B.read_by_id(spark, table)
    assert got.columns == rows.columns and got.exceptAll(rows).count() == 0 and got.count() == 40_000
    assert glob.glob(f"{table}/rows/*.parquet")


def test_distinct_ids_and_duplicates_exchange_no_ids(spark, rows, table):
    got = B.read_by_id(spark, table)
    for df in (A.duplicate_orders(got), A.summary_stats(got)):
        p = plan(df)
        exchanged = [x for x in p.splitlines() if "Exchange hashpartitioning" in x]
        assert not [x for x in exchanged if "order_id" in x], p
    assert Counter(map(tuple, A.duplicate_orders(got).collect())) == Counter(map(tuple, A.duplicate_orders(rows).collect()))
    assert A.summary_stats(got).first() == A.summary_stats(rows).first()
    assert "Exchange" not in plan(A.duplicate_orders(got))


def test_lookups_skip_buckets_and_row_groups(spark, rows, table):
    got = B.read_by_id(spark, table)
    known = [r.order_id for r in rows.where("order_id is not null").limit(1).collect()]
    one = Fl.order_lookup(got, known)
    assert 0 < scanned(one) < 3000 and one.count() == rows.where(F.col("order_id") == known[0]).count()
    assert scanned(Fl.order_lookup(got, ["O000000x"])) == 0          # within the ranges, but in no bloom filter
    rnd = random.Random(1)
    ids = spark.createDataFrame([(f" O{rnd.randrange(25_000):06d} ",) for _ in range(300)] + [("",), (None,)], "line string")
    found = B.lookup(got, ids)
    expected = Fl.order_lookup(rows, ids)
    assert found.count() == expected.count() > 100 and found.exceptAll(expected).count() == 0


def test_another_session_opens_the_table_by_its_path(spark, table):
    spark.sql(f"DROP TABLE {B._name(table)}")
    got = B.read_by_id(spark.newSession(), table)
    assert got.count() == 40_000 and "Exchange" not in plan(A.duplicate_orders(got))


def test_a_hot_id_is_written_by_several_tasks(spark, rows, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k",
            "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        B.write_by_id(rows.withColumn("pad", F.sha2(F.col("n").cast("string"), 256)), str(tmp_path / "hot"), buckets=4)
        files = Counter(f.rsplit("_", 1)[1].split(".")[0] for f in glob.glob(f"{tmp_path}/hot/rows/*.parquet"))
        assert max(files.values()) > 2
        got = B.read_by_id(spark, str(tmp_path / "hot"))
        assert got.where("order_id is null").count() == rows.where("order_id is null").count() and got.count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
