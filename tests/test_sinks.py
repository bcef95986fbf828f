"""Sinks: CSV export partitioned by day; the four-part report with empty sections kept."""

from ledgerlens.plans import fixtures as X
from ledgerlens.sources.sinks import export_csv, export_drilldown, write_report
from tests.conftest import SF_SMALL


def test_export_csv_round_trip(spark, tmp_path):
    recon = X.recon(spark, SF_SMALL).where("merchant like '%1'")
    out = export_csv(recon, str(tmp_path / "export"), partition_by=["biz_date"])
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.count() == recon.count()
    assert "biz_date" in back.columns


def test_exports_are_named_by_status_and_date(spark, tmp_path):
    rows = [("A", "match", "2025-07-01"), ("B", None, "2025-07-02"), ("C", "match", "2025-07-01")]
    df = spark.createDataFrame(rows, "order_id string, reconcile_status string, biz_date string")
    out = export_drilldown(df, str(tmp_path / "export"))
    names = sorted(p.name for p in (tmp_path / "export").iterdir() if p.is_dir())
    assert names == ["export=match_details_2025-07-01", "export=null_details_2025-07-02"]
    assert spark.read.option("header", True).csv(out).count() == 3


def test_write_report_sections(spark, tmp_path):
    recon = X.recon(spark, SF_SMALL)
    paths = write_report(recon, str(tmp_path / "report"))
    assert set(paths) == {"insurer_only", "platform_only", "amount_mismatch", "summary"}
    assert spark.read.parquet(paths["summary"]).count() == 4
    empty = write_report(recon.where("false"), str(tmp_path / "empty"))
    df = spark.read.parquet(empty["insurer_only"])
    assert df.count() == 0 and "order_id" in df.columns


def test_write_report_as_csv(spark, tmp_path):
    recon = X.recon(spark, SF_SMALL)
    paths = write_report(recon, str(tmp_path / "report_csv"), fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').csv(paths["insurer_only"])
    assert back.count() == recon.where("reconcile_status like '%not_found_in_m%'").count()
    assert back.columns == ["order_id", "merchant", "amount", "order_time", "reconcile_status"]
