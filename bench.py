"""Benchmark the headline queries; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 5), BENCH_COMPARE (default 1).

The flow follows the dashboard's: the three exports are cleaned and
classified once, then every report and search runs on the prepared tables.

* ``clean_orders`` and ``classify_income`` are timed from the raw export
  files (the load).
* The prepared tables are then written once to the shared folder
  (``prepare_sec``), and every report and search is timed reading them.

Each query runs once to warm up and then BENCH_RUNS times; the median wall
time is reported. A run executes the whole plan and discards the rows with
the ``noop`` sink, so nothing is collected to the driver.

With BENCH_COMPARE=1 the same work is timed on DuckDB, single node, with
as many threads (``single_node_duckdb_sec``): the oracle SQL, with the
cleaned tables created in memory once and every result materialised in
full. It stands in for the original single-process engine; the original
cleans in pandas, which is slower than SQL, so the stand-in favours it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

LOAD = ["clean_orders", "classify_income"]
REPORTS = [
    # one-table reports
    "orders_by_month", "sku_summary", "sku_monthly", "income_by_month",
    "traffic_by_month", "error_by_month",
    # join reports
    "top_buyers", "top_provinces", "adjustments", "region_analysis", "product_analysis",
    # searches
    "find_order", "find_city", "find_sku", "find_buyer",
]


def _sf(sf_dir: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1)) if m else sf_dir


def _median(fn, runs: int) -> float:
    fn()  # warm-up: JIT, file listing, codegen cache
    return round(statistics.median(_timed(fn) for _ in range(runs)), 4)


def _timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def spark_times(spark, sf_dir: str, names: list[str], runs: int) -> tuple[dict, float]:
    from sellerlens import catalog
    from sellerlens.session import scratch_path
    from sellerlens.sinks.tables import read_tables, write_tables

    out = {}
    for name in [n for n in names if n in LOAD]:
        out[name] = _median(lambda: _noop(catalog.QUERIES[name](spark, sf_dir)), runs)
    t0 = time.perf_counter()
    paths = write_tables(catalog.tables(spark, sf_dir), scratch_path(spark, "bench-prepared"))
    prepare = time.perf_counter() - t0
    prepared = read_tables(spark, paths)
    for name in [n for n in names if n not in LOAD]:
        out[name] = _median(lambda: _noop(catalog.ON_TABLES[name](prepared)), runs)
    return out, round(prepare, 4)


def duckdb_times(paths, names: list[str], cpus: int, runs: int) -> tuple[dict, float]:
    """Median DuckDB time per query over the same inputs."""
    import duckdb

    from sellerlens import oracle
    src = tuple(f"SELECT * FROM read_parquet('{p}/*.parquet')"
                for p in (paths.orders, paths.income, paths.overview))
    full = oracle.queries(src)
    body = oracle.bodies()
    prefix = oracle.prefix(*src)
    con = duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    out = {}
    for name in [n for n in names if n in LOAD]:
        out[name] = _median(lambda: con.execute(
            f"CREATE OR REPLACE TEMP TABLE bench_out AS {full[name]}"), runs)
    t0 = time.perf_counter()
    for t in ("c_orders", "c_income", "mkt_overview"):
        con.execute(f"CREATE OR REPLACE TABLE {t}_p AS {prefix} SELECT * FROM {t}")
    prepare = time.perf_counter() - t0
    con.execute("CREATE OR REPLACE VIEW c_orders AS SELECT * FROM c_orders_p")
    con.execute("CREATE OR REPLACE VIEW c_income AS SELECT * FROM c_income_p")
    con.execute("CREATE OR REPLACE VIEW mkt_overview AS SELECT * FROM mkt_overview_p")
    con.execute('CREATE OR REPLACE VIEW joined AS SELECT * FROM c_orders o JOIN c_income i '
                'ON o."Order ID" = i."Related order ID"')
    for name in [n for n in names if n not in LOAD]:
        out[name] = _median(lambda: con.execute(
            f"CREATE OR REPLACE TEMP TABLE bench_out AS {body[name]}"), runs)
    return out, round(prepare, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or LOAD + REPORTS

    from sellerlens.session import local_session
    from sellerlens.sources import fixtures

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="sellerlens-bench")
    t0 = time.perf_counter()
    paths = fixtures.materialize(spark, sf_dir)
    fixture_sec = time.perf_counter() - t0

    results, prepare = spark_times(spark, sf_dir, names, runs)
    report = {
        "metric": "sum_of_median_query_sec",
        "value": round(sum(results.values()), 4),
        "unit": "sec",
        "queries": results,
        "sf": _sf(sf_dir),
        "cpus": cpus,
        "runs": runs,
        "fixture_write_sec": round(fixture_sec, 3),
        "prepare_sec": prepare,
    }
    if os.environ.get("BENCH_COMPARE", "1") == "1":
        ref, ref_prepare = duckdb_times(paths, names, cpus, runs)
        report["single_node_duckdb_sec"] = ref
        report["single_node_duckdb_total_sec"] = round(sum(ref.values()), 4)
        report["single_node_duckdb_prepare_sec"] = ref_prepare
    print(json.dumps(report, ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
