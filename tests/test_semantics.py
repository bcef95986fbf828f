"""Semantics kept from the source (and defects dropped), plus properties."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import filters as Fl
from ledgerlens.operators import report as R
from ledgerlens.plans import fixtures as X
from tests.conftest import SF_MID, SF_SMALL

COLS = ("order_id string, merchant string, amount decimal(18,2), order_time string, reconcile_status string, "
        "insurance_status string, is_business_order string, service_type string, gsm_amount decimal(18,2), "
        "merchant_amount decimal(18,2)")


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def row(oid, status="match", service="normal", business="true", time="2025-07-01 10:00:00", amount="1",
        gsm=None, mer=None, merchant="M"):
    d = lambda x: None if x is None else Decimal(x)
    return (oid, merchant, d(amount), time, status, "completed", business, service, d(gsm), d(mer))


def test_service_labels_add_up_and_null_is_unknown(spark):  # D1, D10
    df = table(spark, [row("1", service="normal"), row("2", service="Normal"), row("3", service=None),
                       row("4", service=""), row("5", service="EXPRESS"), row("6", service="cargo")])
    got = {r.service_label: r.order_count for r in A.service_type_distribution(df).collect()}
    assert got == {"Ride (Normal)": 2, "unknown": 2, "Express": 1, "cargo": 1}
    s = A.service_type_summary(df).first()
    assert (s.ride_orders, s.express_orders, s.unknown_orders, s.total_orders) == (2, 1, 2, 6)


def test_business_labels_add_up(spark):  # D2
    df = table(spark, [row("1", business="true"), row("2", business="1"), row("3", business="False"),
                       row("4", business="no"), row("5", business=None), row("6", business="maybe")])
    got = {r.business_label: r.order_count for r in A.business_distribution(df).collect()}
    assert got == {"Business": 2, "Non-Business": 2, "Unknown (null)": 1, "Unknown (maybe)": 1}
    assert A.business_rate(df).first().business_orders == 2


def test_null_status_is_its_own_class(spark):  # D7
    df = table(spark, [row("1", status=None), row("2", status="match"), row("3", status="x_not_found_in_m"),
                       row("4", status="not_found_in_external"), row("5", status="weird")])
    got = {r.reconcile_status: r.reconcile_class for r in A.reconcile_status_distribution(df).collect()}
    assert got == {None: "unknown", "match": "match", "x_not_found_in_m": "only_m",
                   "not_found_in_external": "only_external", "weird": "other"}
    summary = {r.reconcile_status: r for r in A.reconcile_status_summary(df).collect()}
    assert summary["match"].description.startswith("matched")
    assert summary["weird"].description == "weird"
    assert summary[None].description is None


def test_bad_time_does_not_void_hourly(spark):  # D9
    df = table(spark, [row("1", time="2025-07-01 10:00:00"), row("2", time="bad"),
                       row("3", time="2025-07-01 10:59:59", status="not_found_in_m")])
    got = {r.hour: (r.transaction_count, r.match_count) for r in A.hourly_patterns(df).collect()}
    assert got == {10: (2, 1), None: (1, 1)}
    assert A.peak_hour(A.hourly_patterns(df)).first().hour == 10


def test_high_discrepancy_borders_and_no_cap(spark):  # F6, F7, D12
    rows = [row("a", gsm="110", mer="100"),      # exactly 10 %: not high
            row("b", gsm="110.01", mer="100"),   # 10.01 %: high
            row("c", gsm="5", mer="0"),          # right amount 0: mismatch, not high, pct null
            row("d", gsm=None, mer="1"),         # null: neither
            row("e", gsm="7", mer="7")]          # equal: neither
    rows += [row(f"h{i:03d}", gsm="300", mer="100") for i in range(60)]
    df = table(spark, rows)
    high = Fl.high_amount_discrepancy(df)
    assert high.count() == 61                                     # every row, not 50
    assert "a" not in {r.order_id for r in high.collect()}
    mm = {r.order_id: r for r in Fl.amount_mismatch(df).collect()}
    assert set(mm) == {"a", "b", "c"} | {f"h{i:03d}" for i in range(60)}
    assert mm["c"].diff_percentage is None and mm["a"].amount_diff == 10.0
    rec = {r.rule: r.value for r in R.recommendations(df).collect()}
    assert rec["high_amount_discrepancy"] == 61.0


def test_vehicle_other_includes_null(spark):  # F12 / trap 7
    df = table(spark, [row("1", gsm="100"), row("2", gsm="200"), row("3", gsm=None), row("4", gsm="150")])
    got = {r.vehicle: r.order_count for r in A.vehicle_distribution(df).collect()}
    assert got == {"Bike": 1, "Car": 1, "other": 2}


def test_recommendations_stable_when_nothing_fires(spark):
    df = table(spark, [row(str(i), gsm="1", mer="1") for i in range(10)])
    assert [r.rule for r in R.recommendations(df).collect()] == ["stable"]


def test_shares_and_counts_add_up(spark):
    recon = X.recon(spark, SF_SMALL).cache()
    n = recon.count()
    for op in (A.reconcile_status_distribution, A.insurance_distribution, A.business_distribution,
               A.service_type_distribution):
        out = op(recon).agg(F.sum("order_count").alias("n"), F.sum("percent").alias("p")).first()
        assert out.n == n and out.p == pytest.approx(100.0)
    classes = A.reconcile_status_distribution(recon).groupBy().sum("order_count").first()[0]
    assert classes == n
    recon.unpersist()


def test_pages_partition_the_table(spark):
    recon = X.recon(spark, SF_SMALL)
    n = recon.count()
    size = 1000
    pages = Fl.page_count(recon, size).first().page_count
    seen = []
    for p in range(pages):
        seen += [r.order_id for r in Fl.page_rows(recon, p, size).select("order_id").collect()]
    assert len(seen) == n and len(set(seen)) == n and seen == sorted(seen)
    # keyset paging gives the same sequence
    keyset, last = [], None
    while True:
        chunk = [r.order_id for r in Fl.page_after(recon, last, size).select("order_id").collect()]
        if not chunk:
            break
        keyset += chunk
        last = chunk[-1]
    assert keyset == seen


def test_vehicle_totals_add_up(spark):
    drv = X.driver(spark, SF_SMALL)
    rows = {r.vehicle: r for r in A.vehicle_amount_comparison(drv).collect()}
    assert rows["Total"].gsm_amount_total == rows["Bike"].gsm_amount_total + rows["Car"].gsm_amount_total
    assert rows["Total"].merchant_amount_count == rows["Bike"].merchant_amount_count + rows["Car"].merchant_amount_count


def test_known_facts_at_sf001(spark):
    """Expectations stated for the ``recon`` / ``driver`` fixtures at sf 0.01."""
    recon = X.recon(spark, SF_MID)
    got = {r.reconcile_status: r.order_count for r in A.reconcile_status_distribution(recon).collect()}
    assert got == {"match": 11669, "not_found_in_external": 1691, "not_found_in_m": 1463, None: 155}
    assert Fl.amount_mismatch(recon).count() == 8164
    assert Fl.high_amount_discrepancy(recon).count() == 7383
    assert A.unusual_merchants(A.merchant_patterns(recon, sort=False)).count() == 715
    assert A.duplicate_orders(X.driver(spark, SF_MID)).count() == 11785


def test_result_independent_of_partitioning(spark):
    recon = X.recon(spark, SF_SMALL)
    a = sorted(map(tuple, A.merchant_patterns(recon, sort=False).collect()))
    b = sorted(map(tuple, A.merchant_patterns(recon.repartition(3), sort=False).collect()))
    assert a == b


def test_per_day_shares(spark):
    recon = X.recon(spark, SF_SMALL)
    per_day = A.reconcile_status_distribution(recon, by=["biz_date"])
    sums = per_day.groupBy("biz_date").agg(F.sum("percent").alias("p")).collect()
    assert all(r.p == pytest.approx(100.0) for r in sums)


def test_report_parts(spark):
    recon = X.recon(spark, SF_SMALL)
    rep = R.reconciliation_report(recon)
    assert set(rep) >= {"summary", "insurer_only", "platform_only", "amount_mismatch", "merchant_analysis",
                        "hourly", "peak_hour", "suspicious", "recommendations"}
    assert rep["summary"].count() >= 1 and rep["recommendations"].count() >= 1
    rep["base"].unpersist()


def test_order_time_parse_ignores_session_zone(spark):
    from ledgerlens.functions import labels as L
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2000-04-02 02:30:00",), ("bad",)], "t string")
        got = [r.h for r in df.select(F.hour(L.parse_order_time("t")).alias("h")).collect()]
        assert got == [2, None]          # a DST-gap wall-clock time keeps its hour
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
