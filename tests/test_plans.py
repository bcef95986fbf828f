"""Physical-plan checks: the operators stay JVM-side and scan what they need once."""

import contextlib
import io

import pytest

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import filters as Fl
from ledgerlens.plans.queries import OPERATORS, SilverTables
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "FlatMapCoGroupsInPandas")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    return SilverTables.build(spark, SF_SMALL, str(tmp_path_factory.mktemp("silver")))


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_no_python_no_cartesian(silver, key):
    p = plan(OPERATORS[key](silver))
    for node in PYTHON_NODES + ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in p, f"{key} plans {node}"


def _scans(p: str, table: str) -> int:
    return sum(1 for line in p.splitlines() if line.startswith("Location:") and f"/{table}]" in line)


def test_multi_measure_aggregates_scan_once(silver):
    recon = silver.recon()
    for df in (A.column_profile(recon), A.amount_overall(recon), A.vehicle_amount_comparison(silver.driver()),
               A.merchant_patterns(recon, sort=False), A.amount_comparison_matrix(recon)):
        p = plan(df)
        assert _scans(p, "recon") + _scans(p, "driver") == 1, p


def test_shares_scan_the_base_once(silver):
    """The total of a share comes from the grouped rows: one exchange, one scan at run time."""
    recon = silver.recon()
    for df in (A.reconcile_status_distribution(recon), A.reconcile_status_summary(recon), A.insurance_distribution(recon),
               A.business_distribution(recon), A.service_type_distribution(recon), A.amount_by_service(recon)):
        df.collect()
        p = plan(df)
        assert "Reuses operator id" in p, p


def test_gate_without_a_join(silver):
    p = plan(Fl.status_drilldown(silver.recon(), max_rows=500))
    assert "Join" not in p
    recon = silver.recon()
    counts = {r.reconcile_status: r.order_count for r in A.reconcile_status_distribution(recon).collect()}
    want = sum(n for s, n in counts.items() if s != "match" and n < 500)
    assert Fl.status_drilldown(recon, max_rows=500).count() == want
    assert Fl.status_drilldown(recon).count() == sum(n for s, n in counts.items() if s != "match")


def test_projection_is_pruned(silver):
    p = plan(A.hourly_patterns(silver.recon()))
    assert "ReadSchema: struct<order_time:timestamp_ntz,reconcile_status:string>" in p


def test_lookup_list_is_pushed_to_scan(silver):
    p = plan(Fl.order_lookup(silver.recon(), ["O1", " O2 ", ""]))
    assert "PushedFilters: [In(order_id, [O1,O2])]" in p


def test_partial_aggregation_before_shuffle(silver):
    p = plan(A.duplicate_orders(silver.driver()))
    assert "partial_count" in p


def test_header_table_is_broadcast(silver):
    p = plan(OPERATORS["alias_resolve"](silver))
    assert "BroadcastHashJoin" in p


def test_latest_version_without_window(silver):
    p = plan(OPERATORS["latest_version_per_key"](silver))
    assert "Window" not in p


def test_silver_day_filter_prunes_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerlens.plans import fixtures as X
    from ledgerlens.sources.csv_ingest import write_silver

    recon = X.recon(spark, SF_SMALL).where(F.year("biz_date") == 1995)
    out = str(tmp_path / "silver")
    write_silver(recon, out)
    silver = spark.read.parquet(out)
    month = silver.where(F.col("biz_date").between("1995-03-01", "1995-03-31"))
    p = plan(A.reconcile_status_summary(month))
    assert "PartitionFilters: [isnotnull(biz_date" in p and "1995-03-01" in p
    assert "ReadSchema: struct<reconcile_status:string,amount:decimal(18,2)>" in p
    got = {r.reconcile_status: r.order_count for r in A.reconcile_status_summary(month).collect()}
    want = {r.reconcile_status: r.order_count
            for r in A.reconcile_status_summary(recon.where(F.month("biz_date") == 3)).collect()}
    assert got == want
