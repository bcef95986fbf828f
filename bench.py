"""Benchmark: build the silver tables once, then time every registered operator.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``

``silver_build`` is the derivation + Parquet write of the reconciliation tables;
``csv_ingest`` loads the transaction table back from one CSV file per day (two
header layouts); ``query:<key>`` is a registered query as the correctness check runs it,
derived from the source tables; every other entry is one operator run to completion on the
silver tables with a ``noop`` sink (full evaluation, nothing collected).
Each operator is run twice and the faster run is kept (the first run also pays
JIT warm-up of the generated code); an untimed warm-up job runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.drops import write_daily_drops  # noqa: E402
from ledgerlens.plans.queries import OPERATORS, SilverTables, queries  # noqa: E402
from ledgerlens.sources import csv_ingest  # noqa: E402
from ledgerlens.session import local_session, scratch_path  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def warm_up(spark, sf_dir: str) -> None:
    """Untimed: one small job over real tables (scan, join, aggregate, sort) so the
    timings below measure the queries, not the JVM's start-up compilation."""
    from pyspark.sql import functions as F
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    for _ in range(3):
        run(nation.join(region, nation.n_regionkey == region.r_regionkey)
            .groupBy("r_name").agg(F.count(F.lit(1)).alias("n")).orderBy("r_name"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    silver_dir = scratch_path(spark, f"bench-silver-{uuid.uuid4().hex[:8]}")

    warm_up(spark, sf_dir)
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    tables = SilverTables.build(spark, sf_dir, silver_dir)
    times["silver_build"] = round(time.perf_counter() - t0, 3)

    # CSV ingest: the recon table as daily drops (untimed setup), then the typed
    # load of every day (catalogue, latest versions, positional scan, header
    # resolution, casts) run to completion
    drops = f"{silver_dir}/drops"
    write_daily_drops(tables.recon(), drops, f"{silver_dir}/drops-staging")
    best = None
    for _ in range(repeats):
        t = time.perf_counter()
        run(csv_ingest.load(spark, drops, "reconciled"))
        best = min(best or 1e9, time.perf_counter() - t)
    times["csv_ingest"] = round(best, 3)

    source = queries()
    timed = {key: (lambda op=op: op(tables)) for key, op in OPERATORS.items()}
    timed |= {f"query:{key}": (lambda key=key: source[key](spark, sf_dir)) for key in ("reconcile_status_summary", "summary_stats")}
    for key, op in timed.items():
        best = None
        for _ in range(repeats):
            t = time.perf_counter()
            run(op())
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[key] = round(best, 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus, "silver_dir": silver_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
