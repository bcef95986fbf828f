"""Positions, pages by number, numbered exports and two ledgers: on ties, nulls and hot keys."""

import glob
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import filters as Fl
from ledgerlens.operators.ledgers import occurrences, reconcile_ledgers
from ledgerlens.operators.ordering import numbered, page_at, write_page_index
from ledgerlens.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "hot", "hot", f"k{rnd.randrange(50)}"]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "`a.b` string, n int").repartition(7)
    got = {r["position"]: (r["a.b"], r["n"]) for r in numbered(df, ["a.b", "n"], partitions=5).collect()}
    assert [got[k] for k in range(2000)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert numbered(df.limit(0), ["n"]).collect() == []


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(0, 2357, 1, 6).select(F.when(F.col("id") > 4, F.format_string("O%05d", (F.col("id") * 7919 % 2357))).alias("order_id"),
                                             F.col("id").alias("n"), (F.col("id") % 7).alias("amount"))


@pytest.mark.parametrize("order_by", [("order_id", "n"), ("amount", "n")])
def test_pages_by_number(spark, orders, tmp_path, order_by):
    path = str(tmp_path / "index")
    write_page_index(orders, path, order_by=order_by, stride=50)
    index = spark.read.parquet(path)
    assert index.count() == -(-2357 // 50) + 1
    whole = [r["n"] for r in orders.orderBy(*order_by).collect()]
    for size in (100, 30, 50, 1000):
        for page in (0, 1, 2357 // size - 1, 2357 // size, 2357 // size + 1):
            got = [r["n"] for r in page_at(orders, index, page, size, order_by=order_by).orderBy(*order_by).collect()]
            assert got == whole[page * size:(page + 1) * size], (size, page)
    assert page_at(orders.limit(0), index.limit(0), 3, 100, order_by=order_by).count() == 0


def test_a_deep_page_reads_one_range(spark, orders, tmp_path):
    write_page_index(orders, str(tmp_path / "index"), order_by=("order_id", "n"), stride=100)
    orders.repartitionByRange(8, "order_id").write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    page = page_at(stored, spark.read.parquet(str(tmp_path / "index")), 20, 100, order_by=("order_id", "n"))
    p = plan(page)
    assert "PushedFilters" in p and "GreaterThanOrEqual(order_id" in p and "LessThanOrEqual(or" in p
    assert "offset" not in p.lower()
    assert [r["order_id"] for r in page.collect()] == [r["order_id"] for r in Fl.page_rows(stored, 20, 100, order_by=("order_id", "n")).collect()]


def test_a_hot_export_name_takes_many_files(spark, tmp_path):
    rows = [(f"O{k}", "hot" if k % 3 else f"s{k % 11}", "2025-07") for k in range(3000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "order_id string, reconcile_status string, month string").repartition(4)
    path = sinks.export_drilldown(df, str(tmp_path / "export"), date_col="month", rows_per_file=100)
    files = defaultdict(list)
    for f in glob.glob(f"{path}/export=*/part=*/*.csv"):
        files[f.split("export=")[1].split("/")[0]].append(sum(1 for _ in open(f)) - 1)
    assert len(files["hot_details_2025-07"]) == 20 and max(files["hot_details_2025-07"]) < 160
    assert len(files["s0_details_2025-07"]) == 1 and sum(files["null_details_null"]) == 3
    back = spark.read.option("header", True).csv(path).select("order_id", "reconcile_status", "month")
    assert Counter(map(tuple, back.collect())) == Counter(rows)


def plain_ledgers(left, right):
    sides = []
    for rows in (left, right):
        by = defaultdict(list)
        for k, a in rows:
            by[k].append(a)
        sides.append({k: sorted(v, key=lambda a: (a is not None, a or 0)) for k, v in by.items()})
    out = []
    for k in sides[0].keys() | sides[1].keys():
        a, b = sides[0].get(k, []), sides[1].get(k, [])
        for n in range(max(len(a), len(b))) if k is not None else ():
            x, y = (v[n] if n < len(v) else None for v in (a, b))
            status = "match" if n < min(len(a), len(b)) else "not_found_in_m" if n < len(a) else "not_found_in_external"
            out.append((k, n + 1, x, y, None if x is None or y is None else x - y, status))
    out += [(None, None, a, None, None, "not_found_in_m") for a in sides[0].get(None, [])]
    return out + [(None, None, None, a, None, "not_found_in_external") for a in sides[1].get(None, [])]


@pytest.mark.parametrize("hot_rows", [10 ** 6, 20])
def test_ledgers(spark, hot_rows):
    rnd = random.Random(3)

    def ledger():
        return [(rnd.choice(["hot", None, f"O{rnd.randrange(60)}"]), rnd.choice([None, 1, 2, 3, 500])) for _ in range(400)]
    left, right = ledger(), ledger()
    frames = [spark.createDataFrame(x, "order_id string, amount int").repartition(3) for x in (left, right)]
    got = reconcile_ledgers(*frames, hot_rows=hot_rows)
    assert Counter(map(tuple, got.collect())) == Counter(plain_ledgers(left, right))
    empty = frames[0].limit(0)
    assert {r.reconcile_status for r in reconcile_ledgers(frames[0], empty, hot_rows=hot_rows).collect()} == {"not_found_in_m"}
    assert reconcile_ledgers(empty, empty).count() == 0


def test_a_hot_id_is_numbered_by_many_tasks(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("O"), "id")).otherwise(F.lit("hot")).alias("order_id"), F.col("id").alias("n"))
    got = occurrences(df, "order_id", ["n"], hot_rows=1000)
    hot = got.where("order_id = 'hot'").agg(F.min("occurrence"), F.max("occurrence"), F.count_distinct("occurrence")).first()
    assert tuple(hot) == (1, 20_000, 20_000) and got.where("occurrence = 1").count() == 10_001
    assert "Window" not in plan(numbered(df, ["order_id", "n"]))
