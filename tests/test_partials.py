"""Daily partials against the full scan, by generation, and trends on a calendar without gaps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import partials as P
from ledgerlens.plans import fixtures as X
from ledgerlens.sources import silver as V
from tests.conftest import SF_SMALL
from tests.test_silver import HDR, line, name

AMOUNTS = ["gsm_amount", "merchant_amount", "amount"]
#: (analysis of the partials, the same of the rows)
BOTH = {
    "status": (lambda p: p.reconcile_status_distribution(), A.reconcile_status_distribution),
    "status by day": (lambda p: p.reconcile_status_distribution(["biz_date"]), lambda d: A.reconcile_status_distribution(d, by=["biz_date"])),
    "summary": (lambda p: p.reconcile_status_summary(), A.reconcile_status_summary),
    "insurance": (lambda p: p.insurance_distribution(), A.insurance_distribution),
    "business": (lambda p: p.business_distribution(), A.business_distribution),
    "rate": (lambda p: p.business_rate(), A.business_rate),
    "service": (lambda p: p.service_type_distribution(), A.service_type_distribution),
    "amounts": (lambda p: p.amount_by_service(AMOUNTS), lambda d: A.amount_by_service(d, amount_cols=AMOUNTS)),
    "overall": (lambda p: p.amount_overall(AMOUNTS), lambda d: A.amount_overall(d, amount_cols=AMOUNTS)),
    "matrix": (lambda p: p.amount_comparison_matrix(AMOUNTS), lambda d: A.amount_comparison_matrix(d, amount_cols=AMOUNTS)),
    "merchants": (lambda p: p.merchant_patterns(), A.merchant_patterns),
    "hours": (lambda p: p.hourly_patterns(), A.hourly_patterns),
    "vehicles": (lambda p: p.vehicle_distribution(), A.vehicle_distribution),
    "vehicle amounts": (lambda p: p.vehicle_amount_comparison(), A.vehicle_amount_comparison),
    "merchant status": (lambda p: p.merchant_status_distribution(), A.merchant_status_distribution),
    "failed": (lambda p: p.failed_rollup(), A.failed_rollup),
}


@pytest.fixture(scope="module")
def recon(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("recon"))
    k = F.substring("order_id", 2, 20).cast("long")
    flat = (k % 5 < 2, F.lit(100).cast(X.MONEY)), (k % 5 < 4, F.lit(200).cast(X.MONEY))
    rows = X.recon(spark, SF_SMALL).withColumns({
        "merchant_status": F.when(k % 4 == 0, "FAILED").when(k % 4 == 1, "net error").when(k % 4 == 2, "SUCCESS"),
        "gsm_amount": F.when(*flat[0]).when(*flat[1]).otherwise(F.col("gsm_amount")),
        "merchant_amount": F.when(k % 3 == 0, F.lit(200).cast(X.MONEY)).otherwise(F.col("merchant_amount"))})
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def daily(spark, recon, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("daily"))
    P.daily_partials(recon).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ranges():
    rnd = random.Random(4)
    day = lambda: dt.date(1992, 1, 1) + dt.timedelta(days=rnd.randrange(2400))
    return [(None, None), *(tuple(sorted((day(), day()))) for _ in range(2)), (dt.date(2030, 1, 1), dt.date(2030, 1, 2))]


@pytest.mark.parametrize("which", BOTH)
def test_any_range_equals_the_full_scan(recon, daily, which):
    of_partials, of_rows = BOTH[which]
    for low, high in ranges() if which in ("summary", "amounts", "merchants", "failed") else ranges()[1::2]:
        rows = recon if low is None else recon.where(F.col("biz_date").between(low, high))
        got, expected = of_partials(P.Partials(daily, low, high)), of_rows(rows)
        assert got.columns == expected.columns
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in expected.collect()], (which, low, high)


def test_partials_scan_once_and_combine_early(recon):
    plan = P.daily_partials(recon)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_partials_follow_the_table(spark, tree, tmp_path):
    out = str(tmp_path / "silver")
    assert P.read_partials(spark, out).reconcile_status_distribution().count() == 0
    base = tree({name(d): HDR + "\n" + line("A", "5") + line("B", "7") for d in (1, 2, 3)})
    V.refresh_silver(spark, base, out)
    assert P.refresh_partials(spark, out) == [1] and P.refresh_partials(spark, out) == []
    tree({name(2): HDR + "\n" + line("C", "100"), name(3): HDR + "\n"})
    V.refresh_silver(spark, base, out)
    assert P.refresh_partials(spark, out) == [2]                   # the touched days alone
    days = spark.read.parquet(f"{out}/partials/generation=2").select("biz_date").distinct().collect()
    assert [r.biz_date.day for r in days] == [2]
    for low in (None, "2025-07-02"):
        got = P.read_partials(spark, out, date_from=low).reconcile_status_summary().collect()
        assert got == A.reconcile_status_summary(V.read_silver(spark, out, date_from=low)).collect()
    V.refresh_silver(spark, tree({name(1): HDR + "\n" + line("Z")}), out)
    P.refresh_partials(spark, out)
    V.vacuum(spark, out, keep=1)
    assert P.read_partials(spark, out).reconcile_status_summary().first().total_amount == 101.0


def test_trend_has_every_day(spark):
    rows = [("2025-07-01", "match"), ("2025-07-01", None), ("2025-07-04", "match"), ("2025-07-04", "match"), ("2025-07-05", "lost")]
    df = spark.createDataFrame(rows, "d string, reconcile_status string").select(F.to_date("d").alias("biz_date"), "reconcile_status")
    got = {(r.biz_date.day, r["value"]): (r["rows"], r.has_day, r.previous, r.change, r.change_percent) for r in P.day_over_day(P.daily_partials(df)).collect()}
    assert len(got) == 15
    assert got[1, "match"] == (1, True, None, None, None) and got[2, "match"] == (0, False, 1, -1, -100.0)
    assert got[4, "match"] == (2, True, 0, 2, None) and got[5, "match"] == (0, True, 2, -2, -100.0)
    assert got[2, None] == (0, False, 1, -1, -100.0) and got[5, "lost"] == (1, True, 0, 1, None)
    assert P.day_over_day(P.daily_partials(df.limit(0))).count() == 0
