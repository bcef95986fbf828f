"""A key holding a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import filters as Fl


def _skewed(spark, n=30_000):
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(n).select(
        F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("O"), i.cast("string"))).alias("order_id"),
        F.when(hot, F.lit("BIG")).otherwise(F.concat(F.lit("M"), (i % 500).cast("string"))).alias("merchant"),
        (i % 7).cast("decimal(18,2)").alias("amount"),
        F.lit("2025-07-01 10:00:00").alias("order_time"),
        F.when(i % 5 == 0, "not_found_in_m").otherwise("match").alias("reconcile_status"),
        F.lit("normal").alias("service_type"),
    )


def test_hot_key_results(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = _skewed(spark).repartition(6)
        dup = {r.order_id: r["count"] for r in A.duplicate_orders(df).collect()}
        assert dup == {"HOT": 10_000}
        big = A.merchant_patterns(df).where("merchant = 'BIG'").first()
        assert big.total_transactions == 10_000 and big.discrepancy_count == 2_000
        ids = spark.createDataFrame([("HOT",), (" O1 ",), ("",)], "line string")
        assert Fl.order_lookup(df, ids).count() == 10_001          # semi join, hot key on the big side
        merchants = spark.createDataFrame([("BIG",)], "m string")
        assert Fl.drilldown_filtered(df, merchants=merchants).count() == 10_000
        s = A.summary_stats(df).first()
        assert (s.total_records, s.unique_orders) == (30_000, 20_001)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
