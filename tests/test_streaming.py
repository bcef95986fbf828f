"""Incremental landing: a re-issued day replaces its rows, new days are added."""

from ledgerlens.sources.silver import read_silver
from ledgerlens.streaming.landing import start_landing

T = "pvi_transaction_reconciled_"
HDR = "ORDER_ID,MERCHANT,TOTAL_AMOUNT,ORDER_TIME,RECONCILE_STATUS,INSURANCE_STATUS,IS_BUSINESS_ORDER,SERVICE_TYPE"


def _ids(spark, path):
    return sorted((r.order_id, str(r.biz_date)) for r in read_silver(spark, path).collect())


def test_landing_replaces_reissued_days(spark, tree, tmp_path):
    base = tree({f"2025/07/01/{T}20250701.csv": HDR + "\nA,M,1,2025-07-01 10:00:00,match,completed,true,normal\n"
                                                      "B,M,2,2025-07-01 11:00:00,match,completed,true,normal\n"})
    silver, ckpt = str(tmp_path / "silver"), str(tmp_path / "ckpt")
    q = start_landing(spark, base, silver, checkpoint=ckpt)
    q.awaitTermination(120)
    assert _ids(spark, f"{silver}/reconciled") == [("A", "2025-07-01"), ("B", "2025-07-01")]

    # day 1 is re-issued with fewer rows, day 2 arrives; the driver data set is ignored here
    tree({f"2025/07/01/{T}20250701_2.csv": "SERVICE_TYPE,ORDER_ID,MERCHANT\nexpress,A2,M\n",
          f"2025/07/02/{T}20250702.csv": HDR + "\nC,M,3,2025-07-02 09:00:00,match,completed,true,normal\n",
          f"2025/07/02/{T}taixe_20250702.csv": "ORDER_ID,GSM_AMOUNT\nX,100\n"})
    q = start_landing(spark, base, silver, checkpoint=ckpt)
    q.awaitTermination(120)
    assert _ids(spark, f"{silver}/reconciled") == [("A2", "2025-07-01"), ("C", "2025-07-02")]


def test_empty_reissue_clears_its_day_and_restarts_remember(spark, tree, tmp_path, monkeypatch):
    wide = HDR + "," + ",".join(f"X{k}" for k in range(90)) + ",GSM_AMOUNT"
    base = tree({f"2025/07/05/{T}20250705.csv": wide + "\nA,M,1,2025-07-05 10:00:00,match,completed,true,normal" + ",1" * 90 + ",77\n",
                 f"2025/07/06/{T}20250706.csv": HDR + "\nB,M,1,2025-07-06 10:00:00,match,completed,true,normal\n"})
    silver = str(tmp_path / "silver")
    start_landing(spark, base, silver).awaitTermination(120)
    rows = {r.order_id: r for r in read_silver(spark, f"{silver}/reconciled").collect()}
    assert set(rows) == {"A", "B"} and str(rows["A"].gsm_amount) == "77.00" and rows["A"].X89 == 1
    tree({f"2025/07/05/{T}20250705_2.csv": HDR + "\n"})

    from ledgerlens.streaming import landing
    batches = []
    land = landing.land_batch
    monkeypatch.setattr(landing, "land_batch", lambda batch, *a: (batches.append(batch.count()), land(batch, *a)))
    # the default checkpoint belongs to the table: another application goes on where this one stopped
    start_landing(spark.newSession(), base, silver).awaitTermination(120)
    assert batches == [1]
    assert _ids(spark, f"{silver}/reconciled") == [("B", "2025-07-06")]


def test_late_base_file_does_not_replace_reissue(spark, tree, tmp_path):
    base = tree({f"2025/07/04/{T}20250704_2.csv": HDR + "\nV2,M,2,2025-07-04 10:00:00,match,completed,true,normal\n"})
    silver, ckpt = str(tmp_path / "silver"), str(tmp_path / "ckpt")
    start_landing(spark, base, silver, checkpoint=ckpt).awaitTermination(120)
    assert _ids(spark, f"{silver}/reconciled") == [("V2", "2025-07-04")]
    # the base version shows up later: the day keeps its re-issued rows
    tree({f"2025/07/04/{T}20250704.csv": HDR + "\nV1,M,1,2025-07-04 09:00:00,match,completed,true,normal\n"})
    start_landing(spark, base, silver, checkpoint=ckpt).awaitTermination(120)
    assert _ids(spark, f"{silver}/reconciled") == [("V2", "2025-07-04")]
    # a run with no new file changes nothing
    start_landing(spark, base, silver, checkpoint=ckpt).awaitTermination(120)
    assert _ids(spark, f"{silver}/reconciled") == [("V2", "2025-07-04")]
