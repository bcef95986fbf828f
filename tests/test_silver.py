"""The silver table: change detection, atomic generations, types over days, accounting."""

import csv
import datetime as dt
import io
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.sources import csv_ingest as I
from ledgerlens.sources import inference, silver

T = "pvi_transaction_reconciled_"
HDR = "ORDER_ID,MERCHANT,TOTAL_AMOUNT,ORDER_TIME,RECONCILE_STATUS"


def name(day, version=""):
    return f"2025/07/{day:02d}/{T}202507{day:02d}{version}.csv"


def line(order, amount="1"):
    return f"{order},M,{amount},2025-07-01 10:00:00,match\n"


def ids(df):
    return sorted((r.order_id, r.biz_date.day) for r in df.select("order_id", "biz_date").collect())


def metric(spark, out, generation, key, column=None):
    found = silver.metrics(spark, out).where((F.col("generation") == generation) & (F.col("metric") == key) & F.col("column").eqNullSafe(F.lit(column)))
    return found.first().value


@pytest.fixture()
def out(tmp_path):
    return str(tmp_path / "silver")


def test_only_changed_days_are_read(spark, tree, out):
    base = tree({name(d): HDR + "\n" + line(f"O{d}") for d in (1, 2, 3, 4)})
    assert silver.refresh_silver(spark, base, out) == 1
    assert silver.refresh_silver(spark, base, out) is None                       # nothing changed, nothing written
    tree({name(1): HDR + "\n" + line("R1") + line("R2"),                         # rewritten in place
          name(2, "_2"): HDR + "\n" + line("V2"),                                # re-issued
          name(5): HDR + "\n" + line("N5")})                                     # new
    os.remove(os.path.join(base, name(3)))                                       # gone
    listed = I.chosen_files(spark, base, "reconciled")
    kinds = {r.biz_date.day: r.change for r in silver.changed_days(listed, silver.days(spark, out)).collect()}
    assert kinds == {1: "rewritten", 2: "rewritten", 3: "removed", 5: "added"}
    assert silver.refresh_silver(spark, base, out) == 2
    assert ids(silver.read_silver(spark, out)) == [("N5", 5), ("O4", 4), ("R1", 1), ("R2", 1), ("V2", 2)]
    assert [metric(spark, out, 2, k) for k in ("files", "rows", "days_added", "days_rewritten", "days_removed")] == [3, 4, 1, 2, 1]
    assert ids(silver.read_silver(spark, out, date_from="2025-07-02", date_to="2025-07-04")) == [("O4", 4), ("V2", 2)]


def test_a_header_only_rewrite_clears_its_day(spark, tree, out):
    base = tree({name(d): HDR + "\n" + line(f"O{d}") + line(f"P{d}") for d in (1, 2)})
    silver.refresh_silver(spark, base, out)
    tree({name(1): HDR + "\n"})
    silver.refresh_silver(spark, base, out)
    assert ids(silver.read_silver(spark, out)) == ids(I.load(spark, base)) == [("O2", 2), ("P2", 2)]
    state = {r.biz_date.day: (r.generation, r.rows) for r in silver.days(spark, out).collect()}
    assert state == {1: (2, 0), 2: (1, 2)}


def test_a_rewrite_of_the_same_length_is_seen(spark, tree, out):
    base = tree({name(1): HDR + "\n" + line("A")})
    silver.refresh_silver(spark, base, out)
    tree({name(1): HDR + "\n" + line("B")})
    later = dt.datetime(2030, 1, 1).timestamp()
    os.utime(os.path.join(base, name(1)), (later, later))
    assert silver.refresh_silver(spark, base, out, days=[dt.date(2025, 7, 1)]) == 2
    assert ids(silver.read_silver(spark, out)) == [("B", 1)]


def test_readers_see_whole_refreshes(spark, tree, out, monkeypatch):
    base = tree({name(d): HDR + "\n" + line(f"O{d}") for d in (1, 2, 3)})
    silver.refresh_silver(spark, base, out)
    before = silver.read_silver(spark, out)
    old = [("O1", 1), ("O2", 2), ("O3", 3)]
    tree({name(d, "_2"): HDR + "\n" + (line(f"V{d}") if d < 3 else "") for d in (1, 2, 3)})
    with monkeypatch.context() as m:             # the rows of the new generation are written, its state is not
        def stop(*a):
            raise RuntimeError("lost")
        m.setattr(silver, "commit", stop)
        with pytest.raises(RuntimeError, match="lost"):
            silver.refresh_silver(spark, base, out)
    assert os.path.isdir(f"{out}/data/generation=2")
    assert ids(silver.read_silver(spark, out)) == old and silver.generations(spark, out) == [1]
    assert silver.refresh_silver(spark, base, out) == 3                          # the half-way generation is passed over
    assert ids(silver.read_silver(spark, out)) == [("V1", 1), ("V2", 2)]
    assert ids(before) == old and ids(silver.read_silver(spark, out, as_of=1)) == old
    with pytest.raises(RuntimeError, match="another refresh"):
        silver.commit(spark, out, 3, silver.days(spark, out))
    assert silver.vacuum(spark, out, keep=1) == 5                                # three old days, two of the one half-way
    assert ids(silver.read_silver(spark, out)) == [("V1", 1), ("V2", 2)]
    assert silver.vacuum(spark, out, keep=1) == 0


def test_columns_and_types_over_days(spark, tree, out):
    extra = "ORDER_ID,Count,Rate,Flag,Odd.Name;x,Empty,Late"
    base = tree({name(1): "ORDER_ID\nA\n", name(2): f"{extra}\nB,7,7,true,x,,1\n"})
    silver.refresh_silver(spark, base, out)
    tree({name(3): f"{extra}\nC,-8,2.5,FALSE,NULL,null,z\n"})
    silver.refresh_silver(spark, base, out)
    whole = silver.read_silver(spark, out)
    types = dict(whole.dtypes)
    assert [types[c] for c in ("Count", "Rate", "Flag", "Odd.Name;x", "Empty", "Late")] == ["bigint", "double", "boolean", "string", "string", "string"]
    rows = {r.order_id: r for r in whole.collect()}
    assert (rows["A"].Count, rows["B"].Count, rows["C"].Count, rows["C"].Rate, rows["C"].Flag) == (None, 7, -8, 2.5, False)
    assert rows["B"]["Odd.Name;x"] == "x" and rows["B"].Late == "1"
    narrow = dict(silver.read_silver(spark, out, date_to="2025-07-02").dtypes)     # types follow from the days read
    assert (narrow["Rate"], narrow["Late"]) == ("bigint", "bigint")
    loaded = I.load(spark, base)
    assert dict(loaded.dtypes) == types and loaded.exceptAll(whole.select(*map(inference.quoted, loaded.columns))).count() == 0
    profile = {r.column_name: (r.data_type, r.null_count) for r in A.column_profile(whole).collect()}
    assert profile["Rate"] == ("double", 1) and profile["Odd.Name;x"] == ("string", 2) and profile["Empty"] == ("string", 3)


def test_missing_folders(spark, tree, tmp_path, out):
    base = tree({name(1): HDR + "\n" + line("A")})
    assert I.load(spark, base, date_from="2024-01-01", date_to="2024-01-31").count() == 0
    with pytest.raises(FileNotFoundError):
        I.load(spark, str(tmp_path / "nope"))
    with pytest.raises(FileNotFoundError):
        silver.refresh_silver(spark, str(tmp_path / "nope"), out, date_from="2025-07-01", date_to="2025-07-02")
    assert silver.read_silver(spark, out).count() == 0 and silver.metrics(spark, out).count() == 0
    silver.refresh_silver(spark, base, out)
    shutil.rmtree(os.path.join(base, "2025"))
    silver.refresh_silver(spark, base, out, date_from="2025-07-01", date_to="2025-07-31")
    assert silver.read_silver(spark, out).count() == 0


def plain_accounting(files):
    """Counts of a refresh, with Python's csv module."""
    columns = [c for c, t in I.transaction_spec().types.items() if t.typeName() != "string"]
    headers = {"amount": "TOTAL_AMOUNT", "order_time": "ORDER_TIME"}
    got = {"files": len(files), "headerless_files": 0, "rows": 0, "ragged_rows": 0, **{c: 0 for c in columns}}
    for content in files.values():
        if not content:                          # Spark lists no file of zero bytes
            got["files"] -= 1
            continue
        rows = [r for r in csv.reader(io.StringIO(content)) if r]
        head = rows[0] if rows else []
        got["headerless_files"] += "ORDER_ID" not in head
        for r in rows[1:]:
            got["rows"] += 1
            got["ragged_rows"] += len(r) != len(head)
            for c, h in headers.items():
                v = r[head.index(h)] if h in head and head.index(h) < len(r) else ""
                if v in ("", "NULL", "null"):
                    continue
                try:
                    float(v) if c == "amount" else dt.datetime.strptime(v, "%Y-%m-%d %H:%M:%S")
                except ValueError:
                    got[c] += 1
    return got


@pytest.mark.parametrize("header_source", ["first_line", "scan"])
def test_accounting_of_untidy_files(spark, tree, out, header_source):
    rnd = random.Random(5)
    files = {}
    for d in range(1, 9):
        header = rnd.choice(["ORDER_ID,TOTAL_AMOUNT,ORDER_TIME", "ORDER_TIME,MERCHANT,ORDER_ID,TOTAL_AMOUNT", "FOO,BAR"])
        body = []
        for k in range(rnd.randrange(0, 30)):
            cells = [rnd.choice(["7", "7.25", "x", "NULL", "", '"1,5"', "2025-07-01 10:00:00", "2025-13-01 10:00:00", '"a ""q"", b"'])
                     for _ in range(len(header.split(",")) + rnd.choice([0, 0, 0, 1, -1, 2]))]
            body.append(",".join(cells) if any(cells) and len(cells) > 1 else "z,z")
        files[name(d)] = header + "\n" + "".join(b + "\n" for b in body)
    files[name(20)] = ""
    base = tree(files)
    silver.refresh_silver(spark, base, out, header_source=header_source)
    expected = plain_accounting(files)
    assert expected["ragged_rows"] > 10 and expected["amount"] > 5 and expected["headerless_files"] >= 2 and expected["files"] == 8
    got = {r["column"] or r["metric"]: r["value"] for r in silver.metrics(spark, out).collect()}
    assert {k: got[k] for k in expected} == expected
    assert silver.read_silver(spark, out).count() == expected["rows"]


def test_reader_prunes_generations_and_days(spark, tree, out):
    base = tree({name(d): HDR + "\n" + line(f"O{d}") for d in (1, 2, 3)})
    silver.refresh_silver(spark, base, out)
    plan = silver.read_silver(spark, out, date_from="2025-07-02")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "biz_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def plain_type(cells):
    def whole(x):
        return x.lstrip("+-").isascii() and x.lstrip("+-").isdigit() and len(x) - len(x.lstrip("+-")) <= 1 and -2 ** 63 <= int(x) < 2 ** 63

    def number(x):
        try:
            float(x)
        except ValueError:
            return False
        return x.isascii() and not any(c in x for c in " _\t\n") and any(c.isdigit() for c in x) and "n" not in x.lower()
    for kind, fits in (("bigint", whole), ("double", number), ("boolean", lambda x: x.lower() in ("true", "false"))):
        if cells and all(map(fits, cells)):
            return kind
    return "string"


def test_type_lattice(spark):
    rnd = random.Random(9)
    pool = ["1", "-2", "+3", "007", "9223372036854775807", "9223372036854775808", "1.5", ".5", "5.", "1e9", "-1E-3", "1d", "NaN", "Infinity", "true", "FALSE",
            "x", " 1", "1 ", "1\n", "--1", "1_000", "0x10", "1,5", "e5", ".", "+", "٣"]
    columns = {f"c.{k}": [rnd.choice(rnd.sample(pool, rnd.choice([1, 1, 2, 3])) + [None]) for _ in range(6)] for k in range(150)}
    columns |= {f"only {k}": [p, None] * 3 for k, p in enumerate(pool)} | {"none": [None] * 6}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns)).withColumn("day", F.col("`none`").isNull()).repartition(3)
    states = inference.column_states(df, list(columns))
    got = {c: t.simpleString() for c, t in inference.resolved(states, list(columns)).items()}
    assert got == {c: plain_type([v for v in vs if v is not None]) for c, vs in columns.items()}
    parts = [inference.column_states(df.where(F.col("`c.0`").isNull() == k), list(columns)) for k in (True, False)]
    assert inference.resolved(parts[0].union(parts[1]), list(columns)) == inference.resolved(states, list(columns))
    assert inference.column_states(df, [], by=["day"]).columns == ["day", "column", "cells", "mask"]
