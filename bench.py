"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.  Each: one warm-up, then the mean of three."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SUITE = [
    "q_count", "q_sum", "q_case_histogram", "q_stats", "q_top10_group", "q_join2_totals", "q_group_desc", "q_join3_activity", "q_join4_report", "q_above_avg", "q_percentiles",
    "q_correlated_counts", "q_self_join_ineq", "q_window_topk", "q_cross_matrix", "q_running_stats", "q_avg_group_top10", "q_range_count", "q_min_max",
    "cdc_net_state", "cdc_composite_key", "cdc_apply_cow", "j_asof",
]
#: The one published case: per account its own count and the mean of its branch, over a million accounts and half a million rows of history.
CORRELATED = "select aid, bid, balance, (select count(*) from {history} o where o.aid = a.aid) as own, (select round(avg(cnt), 4) from (select h.bid as b, count(*) as cnt from {history} h group by h.bid, h.aid) s where s.b = a.bid) as branch_mean from {accounts} a where balance > 0 order by own desc, aid limit 500"


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.operators.snapshot import SnapshotTable
    from tidemark.plans import merge
    from tidemark.plans import queries as suite

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    found, times = suite.queries(), {}

    def timed(name, run):
        began = time.time()
        run()
        cold = time.time() - began
        warm = []
        for _ in range(3):
            began = time.time()
            run()
            warm.append(time.time() - began)
        times[name], times[f"{name}_cold"] = round(sum(warm) / 3, 3), round(cold, 3)

    for name in SUITE:
        timed(name, lambda name=name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    root = tempfile.mkdtemp(prefix="bench-")
    accounts = spark.range(1_000_000).select(F.col("id").alias("aid"), (F.col("id") % 10).alias("bid"), (F.pmod(F.hash("id"), F.lit(20_000)) - 5_000).alias("balance"))
    accounts.write.parquet(f"{root}/accounts")
    spark.range(500_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("aid"), F.pmod(F.hash("id"), F.lit(10)).alias("bid")).write.parquet(f"{root}/history")
    tables = {"accounts": spark.read.parquet(f"{root}/accounts"), "history": spark.read.parquet(f"{root}/history")}
    timed("correlated_1m_500k", lambda: spark.sql(CORRELATED, **tables).write.format("noop").mode("overwrite").save())
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    n = orders.count()
    t = SnapshotTable(spark, root, "public", "orders").create(orders.schema)
    timed("ingest_append", lambda: t.append(orders))
    for share in (1, 10, 50):
        t = SnapshotTable(spark, root, "public", f"orders_{share}").create(orders.schema)
        t.append(orders)
        some = orders.where(F.pmod(F.hash("o_orderkey"), F.lit(100)) < share)
        net = some.select("o_orderkey", F.lit(False).alias("dead"), F.struct("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice")).alias("row"))
        timed(f"ingest_cow_{share}pct", lambda t=t, net=net: t.merge(net, ["o_orderkey"]))
    # Insert-only batches: the tenth must cost what the first did.
    t = SnapshotTable(spark, root, "public", "orders_batches").create(orders.schema)
    for i in range(10):
        began = time.time()
        t.append(orders.where(F.pmod(F.col("o_orderkey"), F.lit(10)) == i))
        if i in (1, 9):
            times[f"append_batch_{i + 1}"] = round(time.time() - began, 3)
    warm = {k: v for k, v in times.items() if not k.endswith("_cold")}
    rates = {f"{k}_rows_per_s": round(n / v) for k, v in warm.items() if k.startswith("ingest")}
    warm = {k: v for k, v in warm.items() if not k.startswith("append_batch")}
    print(json.dumps({"metric": "suite_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": times, "rates": rates, "sf": sf_dir.rsplit("sf", 1)[-1], "cores": int(cpus), "driver_memory": "8g"}))
    spark.stop()


if __name__ == "__main__":
    main()
