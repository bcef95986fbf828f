"""CSV trees: catalogue, version resolution, header drift, null tokens, tolerant casts."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.sources import catalog as C
from ledgerlens.sources import csv_ingest as I
from ledgerlens.sources import silver

T = "pvi_transaction_reconciled_"
D = "pvi_transaction_reconciled_taixe_"

HDR = "ORDER_ID,MERCHANT,TOTAL_AMOUNT,ORDER_TIME,RECONCILE_STATUS,INSURANCE_STATUS,IS_BUSINESS_ORDER,SERVICE_TYPE"


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_catalogue_versions_and_prefixes(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\nA,M,1,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/07/02/{T}20250702.csv": HDR + "\nB,M,1,2025-07-02 10:00:00,match,completed,true,normal\n",
        f"2025/07/02/{T}20250702_2.csv": HDR + "\nC,M,2,2025-07-02 11:00:00,match,completed,true,normal\n",
        f"2025/07/03/{T}20250703_2.csv": HDR + "\nD,M,3,2025-07-03 11:00:00,match,completed,true,normal\n",
        f"2025/7/5/{T}20250705.csv": HDR + "\nE,M,5,2025-07-05 11:00:00,match,completed,true,normal\n",
        f"2025/07/05/{D}20250705.csv": "ORDER_ID,GSM_AMOUNT\nX,100\n",
        f"2025/07/06/{T}20250799.csv": HDR + "\n",           # name date differs from folder
        "2025/abc/01/notes.csv": "x\n",
    })
    parsed = C.parse_paths(C.list_files(spark, base))
    latest = C.latest_versions(parsed)
    got = {(r.biz_date, r.dataset): (r.version, r.path.rsplit("/", 1)[1]) for r in latest.collect()}
    assert got[(dt.date(2025, 7, 1), "reconciled")] == (1, f"{T}20250701.csv")
    assert got[(dt.date(2025, 7, 2), "reconciled")] == (2, f"{T}20250702_2.csv")   # _2 replaces
    assert got[(dt.date(2025, 7, 3), "reconciled")] == (2, f"{T}20250703_2.csv")   # only _2
    assert got[(dt.date(2025, 7, 5), "reconciled")][0] == 1                       # one-digit month
    assert got[(dt.date(2025, 7, 5), "taixe")] == (1, f"{D}20250705.csv")         # anchored prefix
    assert len(got) == 5
    odd = parsed.where(F.col("path").contains("notes")).first()
    assert odd.dataset is None and odd.biz_date is None

    cal = {r.biz_date: r for r in C.availability_calendar(parsed, require="either").collect()}
    assert cal[dt.date(2025, 7, 2)].reconciled_has_version_2 is True
    assert cal[dt.date(2025, 7, 1)].reconciled_has_version_2 is False
    assert cal[dt.date(2025, 7, 5)].taixe_version == 1
    only_driver = C.availability_calendar(parsed, require="taixe").collect()
    assert [r.biz_date for r in only_driver] == [dt.date(2025, 7, 5)]
    inv = C.inventory(parsed).first()
    assert inv.file_count == 8


def test_folder_date_rules(spark):
    df = spark.createDataFrame([("F:\\data\\out\\2025\\7\\1\\x.csv",), ("a/2025/12/31/x.csv",), ("x.csv",),
                                ("b/2025/13/01/x.csv",)], "path string")
    got = [r.d for r in df.select(C.folder_date("path").alias("d")).collect()]
    assert got == [dt.date(2025, 7, 1), dt.date(2025, 12, 31), None, None]


def test_header_drift_aliases_and_null_tokens(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\nA1,\"M, \"\"quoted\"\" name\",100,2025-07-01 10:00:00,match,"
                                             "completed,true,normal\nA2,M2,NULL,bad,null,,1,Normal\n",
        # same columns, reordered
        f"2025/07/02/{T}20250702.csv": "SERVICE_TYPE,ORDER_ID,RECONCILE_STATUS,TOTAL_AMOUNT,MERCHANT\n"
                                       "express,B1,not_found_in_m,xx,M3\n",
        # alias spellings and a blank + duplicate header name
        f"2025/07/03/{T}20250703.csv": "ORDER_ID,Reconcile Status,,AMOUNT,GSM Amount,ORDER_ID\n"
                                       "C1,not_found_in_external,zz,12.5,100,C1-dup\n",
    })
    df = I.load(spark, base, "reconciled")
    rows = {r.order_id: r for r in df.collect()}
    assert set(rows) == {"A1", "A2", "B1", "C1"}
    assert rows["A1"].merchant == 'M, "quoted" name'
    assert rows["A1"].amount == Decimal("100.00")
    assert rows["A2"].amount is None and rows["A2"].reconcile_status is None        # NULL / null tokens
    assert rows["A2"].insurance_status is None                                      # empty cell
    assert rows["A2"].order_time is None                                            # times are typed
    assert rows["A1"].order_time == dt.datetime(2025, 7, 1, 10)
    assert rows["B1"].service_type == "express" and rows["B1"].merchant == "M3"     # no silent shift
    assert rows["B1"].amount is None                                                # bad number -> null, row kept
    assert rows["C1"].reconcile_status == "not_found_in_external"                   # alias
    assert rows["C1"].amount == Decimal("12.50") and rows["C1"].gsm_amount == Decimal("100.00")
    assert rows["C1"].biz_date == dt.date(2025, 7, 3) and rows["C1"].version == 1
    assert "source_file" in df.columns and "dataset" in df.columns


def test_driver_file_alias_priority(spark, tree):
    base = tree({
        f"2025/07/01/{D}20250701.csv": "ORDER_ID,RECONCILE_STATUS,Reconcile Status,GSM_AMO,MERCH_STATUS\n"
                                       "X1,from_upper,from_spaced,200,FAILED\n",
    })
    df = I.load(spark, base, "taixe")
    r = df.first()
    # the driver file lists the spaced spelling first
    assert r.reconcile_status == "from_spaced"
    assert r.gsm_amount == Decimal("200.00") and r.merchant_status == "FAILED"


def test_empty_and_rejected_files(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\n",
        f"2025/07/02/{T}20250702.csv": b"",
        f"2025/07/03/{T}20250703.csv": "FOO,BAR\n1,2\n",
    })
    df = I.load(spark, base, "reconciled")
    assert [(r.order_id, r.FOO, r.BAR) for r in df.collect()] == [(None, 1, 2)]         # no anchor: a null id
    assert set(I.transaction_spec().columns) <= set(df.columns)
    files = [r.path for r in I.chosen_files(spark, base, "reconciled").collect()]
    rejected = [r.listed.rsplit("/", 1)[1] for r in I.rejected_files(spark, files).collect()]
    assert f"{T}20250703.csv" in rejected and f"{T}20250701.csv" not in rejected


def test_date_range_pruning_and_silver_write(spark, tree, tmp_path):
    base = tree({
        f"2025/07/0{d}/{T}2025070{d}.csv": HDR + f"\nO{d},M,{d},2025-07-0{d} 0{d}:00:00,match,completed,true,normal\n"
        for d in range(1, 5)
    })
    df = I.load(spark, base, "reconciled", date_from="2025-07-02", date_to="2025-07-03")
    assert _rows(df, "order_id") == [("O2",), ("O3",)]
    out = str(tmp_path / "silver")
    I.write_silver(I.load(spark, base, "reconciled"), out)
    # a re-issue of one day replaces only that day
    reissue = tree({f"2025/07/02/{T}20250702_2.csv": HDR + "\nO2b,M,9,2025-07-02 09:00:00,match,completed,true,normal\n"})
    I.write_silver(I.load(spark, reissue, "reconciled", date_from="2025-07-02", date_to="2025-07-02"), out)
    silver = spark.read.parquet(out)
    assert _rows(silver, "order_id") == [("O1",), ("O2b",), ("O3",), ("O4",)]


def test_daily_drops_round_trip(spark, tmp_path):
    """The recon fixture written as daily CSV drops (two header layouts) loads back unchanged."""
    from ledgerlens.plans import fixtures as X
    from ledgerlens.plans.drops import write_daily_drops
    from tests.conftest import SF_SMALL

    from ledgerlens.functions.labels import parse_order_time

    recon = X.recon(spark, SF_SMALL).withColumn("order_time", parse_order_time("order_time"))
    base = str(tmp_path / "drops")
    n_files = write_daily_drops(recon, base, str(tmp_path / "staging"))
    assert n_files == recon.select("biz_date").distinct().count()
    loaded = I.load(spark, base, "reconciled")
    cols = recon.columns
    assert loaded.count() == recon.count()
    assert loaded.select(*cols).exceptAll(recon).count() == 0
    assert recon.exceptAll(loaded.select(*cols)).count() == 0


def test_header_sources_agree(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": "﻿" + HDR + "\nA1,M1,100,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/07/02/{T}20250702.csv": "SERVICE_TYPE,ORDER_ID,Reconcile Status,,AMOUNT\nexpress,B1,not_found_in_m,x,7\n",
        f"2025/07/03/{T}20250703.csv": "FOO,BAR\n1,2\n",
    })
    paths = [r.path for r in I.chosen_files(spark, base, "reconciled").collect()]
    first = I.load_paths(spark, paths, "reconciled", header_source="first_line")
    scan = I.load_paths(spark, paths, "reconciled", header_source="scan", root=base)
    for df in (first, scan):
        got = sorted((str(r.order_id), str(r.reconcile_status), str(r.amount)) for r in df.collect())
        # a byte-order mark is no part of the first header cell
        assert got == [("A1", "match", "100.00"), ("B1", "not_found_in_m", "7.00"), ("None", "None", "None")]
    assert first.columns == scan.columns and {"FOO", "BAR"} <= set(first.columns)


def test_wide_long_blank_and_untidy_headers(spark, tree):
    wide = ["ORDER_ID"] + [f"{'LONG_' * 200}{k}" for k in range(80)] + ["RECONCILE_STATUS"]       # 80 KB of header
    base = tree({
        f"2025/07/01/{T}20250701.csv": ",".join(wide) + "\n" + ",".join(["W"] + [str(k) for k in range(80)] + ["match"]) + "\n",
        f"2025/07/02/{T}20250702.csv": "\n  \n" + HDR + "\nB,M,1,2025-07-02 10:00:00,match,completed,true,normal\n",
        f"2025/07/03/{T}20250703.csv": " ORDER_ID, MERCHANT ,Extra,merchant\nC,M3,x,low\n",
    })
    for source in ("first_line", "scan"):
        rows = {r.order_id: r for r in I.load(spark, base, "reconciled", header_source=source).collect()}
        assert set(rows) == {"W", "B", "C"}
        assert rows["W"].reconcile_status == "match" and rows["W"][wide[80]] == 79
        assert rows["B"].merchant == "M" and rows["C"].merchant == "M3"
        assert rows["C"].Extra == "x" and rows["B"].Extra is None
        assert rows["C"].merchant_2 == "low"              # a name that clashes in another case gets a number


def test_odd_file_names_do_not_stop_a_load(spark, tree):
    line = HDR + "\n{0},M,1,2025-07-02 10:00:00,match,completed,true,normal\n"
    base = tree({f"2025/07/02/{T}20250702{v}.csv": line.format(f"V{v}") for v in ("", "_1", "_2", "_3", "_20250702101112")})
    assert _rows(I.load(spark, base, "reconciled"), "order_id") == [("V_2",)]
    assert _rows(I.load(spark, base, "reconciled", versions=None), "order_id") == [("V_3",)]
    parsed = C.parse_paths(C.list_files(spark, base))
    assert C.availability_calendar(parsed).first().reconciled_version == 2


def test_driver_columns_and_operators_on_a_driver_load(spark, tree):
    from ledgerlens.operators import aggregates as A
    from ledgerlens.operators import filters as Fl
    from ledgerlens.operators import report as R

    base = tree({f"2025/07/01/{D}20250701.csv": "ORDER_ID,MERCHANT,AMOUNT,ORDER_TIME,Merchant Status,GSM Amount\n"
                                                "X1,M,7,2025-07-01 09:00:00,FAILED,100\nX2,M,8,bad,SUCCESS,200\n"})
    full = I.load(spark, base, "taixe")
    r = full.where("order_id = 'X1'").first()
    assert (r.merchant, r.amount, r.order_time) == ("M", Decimal("7.00"), dt.datetime(2025, 7, 1, 9))
    s = A.summary_stats(full).first()
    assert (s.total_records, s.unique_orders, s.unique_merchants, s.min_order_time) == (2, 2, 1, dt.datetime(2025, 7, 1, 9))
    only_id = full.select("order_id", "biz_date")        # every other column is absent
    for op in (A.reconcile_status_distribution, A.reconcile_status_summary, A.insurance_distribution, A.business_distribution, A.business_rate,
               A.service_type_distribution, A.service_type_summary, A.merchant_patterns, A.hourly_patterns, A.summary_stats, A.drilldown_kpis,
               A.vehicle_distribution, A.vehicle_amount_comparison, A.merchant_status_distribution, A.failed_rollup, A.duplicate_orders,
               A.column_profile, A.amount_comparison_matrix, A.amount_by_service, A.amount_overall, Fl.status_drilldown, Fl.failed_orders, Fl.amount_mismatch, Fl.high_amount_discrepancy,
               lambda d: Fl.one_sided(d, "m"), lambda d: Fl.drilldown_filtered(d, merchants=["M"]), R.suspicious_summary, R.recommendations):
        op(only_id).collect()
    assert A.summary_stats(only_id).first().unique_merchants == 1 and A.merchant_patterns(only_id).first().total_transactions == 2
    empty = A.summary_stats(full.where("false")).first()
    assert (empty.total_records, empty.unique_orders, empty.unique_merchants) == (0, 0, 0)


def test_refresh_clears_a_day_whose_reissue_is_empty(spark, tree, tmp_path):
    line = "\n{0},M,1,2025-07-01 10:00:00,match,completed,true,normal\n"
    base, out = tree({f"2025/07/0{d}/{T}2025070{d}.csv": HDR + line.format(f"O{d}") for d in (1, 2)}), str(tmp_path / "silver")
    silver.refresh_silver(spark, base, out)
    tree({f"2025/07/01/{T}20250701_2.csv": HDR + "\n"})
    silver.refresh_silver(spark, base, out)
    assert _rows(silver.read_silver(spark, out), "order_id") == [("O2",)]


def test_load_works_outside_the_source_folder(tree, tmp_path):
    """Python workers get the package also where it is neither installed nor on their path."""
    import os
    import subprocess
    import sys

    base = tree({f"2025/07/01/{T}20250701.csv": HDR + "\nA,M,1,2025-07-01 10:00:00,match,completed,true,normal\n"})
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\nfrom ledgerlens.session import local_session\n"
            f"from ledgerlens.sources.csv_ingest import load\nprint('ROWS', load(local_session(1), {base!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_superseded_files_are_excluded(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\nOLD,M,1,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/07/01/{T}20250701_2.csv": HDR + "\nNEW,M,2,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/07/02/{T}20250702.csv": HDR + "\nD2,M,3,2025-07-02 10:00:00,match,completed,true,normal\n",
    })
    paths = [r.path for r in I.chosen_files(spark, base, "reconciled").collect()]
    for source in ("first_line", "scan"):
        got = sorted(r.order_id for r in I.load_paths(spark, paths, "reconciled", root=base,
                                                       header_source=source).collect())
        assert got == ["D2", "NEW"], source


def test_load_both_datasets(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\nA,M,1,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/07/01/{D}20250701.csv": "ORDER_ID,GSM Amount,Merchant Status\nX,100,FAILED\nY,200,SUCCESS\n",
    })
    both = I.load_datasets(spark, base, date_from="2025-07-01", date_to="2025-07-01")
    assert [r.order_id for r in both["reconciled"].collect()] == ["A"]
    assert sorted((r.order_id, r.merchant_status) for r in both["taixe"].collect()) == [("X", "FAILED"),
                                                                                        ("Y", "SUCCESS")]


def test_date_range_lists_month_folders_only(spark, tree):
    assert I.month_root("/b", "2025-07-05", "2025-08-01") == "/b/{2025/07,2025/7,2025/08,2025/8}"
    assert I.month_root("/b", None, "2025-08-01") == "/b"
    assert I.month_root("/b", "2001-07-05", "2005-08-01") == "/b/{2001,2002,2003,2004,2005}"
    base = tree({
        f"2025/07/01/{T}20250701.csv": HDR + "\nJ1,M,1,2025-07-01 10:00:00,match,completed,true,normal\n",
        f"2025/7/5/{T}20250705.csv": HDR + "\nJ5,M,1,2025-07-05 10:00:00,match,completed,true,normal\n",
        f"2025/08/01/{T}20250801.csv": HDR + "\nA1,M,1,2025-08-01 10:00:00,match,completed,true,normal\n",
    })
    july = I.load(spark, base, "reconciled", date_from="2025-07-01", date_to="2025-07-31")
    assert _rows(july, "order_id") == [("J1",), ("J5",)]
    listed = C.list_files(spark, I.month_root(base, "2025-07-01", "2025-07-31"))
    assert all("/2025/08/" not in r.path for r in listed.collect())
    none = I.load(spark, base, "reconciled", date_from="2024-01-01", date_to="2024-01-31")
    assert none.count() == 0 and "order_id" in none.columns


def test_ragged_rows_and_quoted_line_breaks(spark, tree):
    base = tree({
        f"2025/07/01/{T}20250701.csv": "ORDER_ID,MERCHANT,TOTAL_AMOUNT\nS1,M\nL1,M,5,extra,fields\n",
        f"2025/07/02/{T}20250702.csv": 'ORDER_ID,MERCHANT,TOTAL_AMOUNT\nQ1,"two\nlines",7\nQ2,M,8\n',
    })
    short_long = {r.order_id: r for r in I.load(spark, base, "reconciled", date_from="2025-07-01",
                                                 date_to="2025-07-01").collect()}
    assert short_long["S1"].amount is None and short_long["L1"].amount == Decimal("5.00")
    quoted = {r.order_id: r for r in I.load(spark, base, "reconciled", date_from="2025-07-02",
                                            date_to="2025-07-02", multi_line=True).collect()}
    assert set(quoted) == {"Q1", "Q2"}
    assert quoted["Q1"].merchant == "two\nlines" and quoted["Q1"].amount == Decimal("7.00")
