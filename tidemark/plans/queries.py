"""The query suite on the driver tables.

Relational queries are SQL that Spark and the oracle both run.  Change-feed, table and stream queries are
DataFrame plans of this library; their oracle is the same result as plain SQL.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as reg
from ..operators.snapshot import SnapshotTable
from ..sources import copytext
from . import evolve, merge

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Account, history and teller roles on the driver tables.
HISTORY = "(select o_custkey as aid, l_suppkey as tid, o_orderdate as mtime, l_extendedprice - 40000 as delta, o_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax from lineitem join orders on o_orderkey = l_orderkey)"

# Values have two digits, so means of 2, 4, 8 ... rows end exactly between two roundings; a ten-millionth more lets engines agree.
SQL: dict[str, str] = {
    "q_count": "select count(*) as n from customer",
    "q_sum": "select round(sum(c_acctbal), 2) as total from customer",
    "q_case_histogram": "select case when c_acctbal < 0 then 'negative' when c_acctbal < 5000 then 'positive' else 'very_positive' end as bucket, count(*) as cnt, round(avg(c_acctbal), 4) as avg_bal from customer group by 1 order by 1",
    "q_stats": f"select count(*) as txns, round(sum(delta), 2) as total_delta, round(avg(delta), 4) as avg_delta, min(delta) as min_delta, max(delta) as max_delta from {HISTORY} h",
    "q_top10_group": f"select aid, count(*) as txn_count, round(sum(delta), 2) as net_delta from {HISTORY} h group by aid order by txn_count desc, aid limit 10",
    "q_join2_totals": "select n_nationkey, n_name, count(c_custkey) as num_accounts, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean from nation join customer on c_nationkey = n_nationkey group by n_nationkey, n_name order by n_nationkey",
    "q_group_desc": "select l_returnflag, count(*) as txn_count, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 4) as mean from lineitem group by l_returnflag order by total desc",
    "q_join3_activity": "select s_suppkey, n_nationkey, n_name, count(l_orderkey) as txn_count, round(sum(l_extendedprice), 2) as total from supplier join nation on n_nationkey = s_nationkey join lineitem on l_suppkey = s_suppkey group by s_suppkey, n_nationkey, n_name order by txn_count desc, s_suppkey limit 20",
    "q_join4_report": f"select n_nationkey, count(distinct c_custkey) as active_accounts, count(delta) as total_txns, round(sum(delta), 2) as net_flow, round(sum(case when delta > 0 then delta else 0 end), 2) as credits, round(sum(case when delta < 0 then delta else 0 end), 2) as debits, count(distinct tid) as active_tellers from nation join customer on c_nationkey = n_nationkey join {HISTORY} h on h.aid = c_custkey join supplier on s_suppkey = h.tid and s_nationkey = n_nationkey group by n_nationkey order by total_txns desc, n_nationkey",
    "q_above_avg": f"select aid, txn_count, net_delta from (select aid, count(*) as txn_count, round(sum(delta), 2) as net_delta from {HISTORY} h group by aid) s where txn_count > (select avg(c) from (select count(*) as c from {HISTORY} h group by aid) t) order by txn_count desc, aid limit 20",
    "q_percentiles": "select c_nationkey, count(*) as n, round(percentile_cont(0.5) within group (order by c_acctbal), 4) as p50, round(percentile_cont(0.95) within group (order by c_acctbal), 4) as p95, min(c_acctbal) as least, max(c_acctbal) as most from customer group by c_nationkey order by c_nationkey",
    "q_correlated_counts": "select c_custkey, c_nationkey, c_acctbal, (select count(*) from orders where o_custkey = c_custkey) as own, (select round(avg(cnt), 4) from (select c2.c_nationkey as nk, count(*) as cnt from orders o2 join customer c2 on c2.c_custkey = o2.o_custkey group by c2.c_nationkey, o2.o_custkey) s where s.nk = c_nationkey) as nation_avg from customer where c_acctbal > 0 order by own desc, c_custkey limit 500",
    "q_self_join_ineq": "select a.user_id, a.event_type, count(*) as repeats, min(a.ts) as first_visit, max(a.ts) as last_visit from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type and a.ts < b.ts group by a.user_id, a.event_type having count(*) > 3 order by repeats desc, a.user_id, a.event_type limit 100",
    "q_window_topk": f"select * from (select c_nationkey, aid, delta, mtime, tid, round(sum(delta) over (partition by aid order by mtime, o_orderkey, l_linenumber, l_partkey, tid, delta, l_quantity, l_discount, l_tax rows between unbounded preceding and current row), 2) as running, row_number() over (partition by aid order by mtime, o_orderkey, l_linenumber, l_partkey, tid, delta, l_quantity, l_discount, l_tax) as txn_seq, lag(delta) over (partition by aid order by mtime, o_orderkey, l_linenumber, l_partkey, tid, delta, l_quantity, l_discount, l_tax) as prev_delta from {HISTORY} h join customer on c_custkey = aid) r where txn_seq <= 5",
    "q_cross_matrix": "with s as (select c_nationkey as k, count(o_orderkey) as n, round(sum(o_totalprice), 2) as flow from customer join orders on o_custkey = c_custkey group by c_nationkey) select a.n_nationkey as a, b.n_nationkey as b, s1.n as a_n, s2.n as b_n, round(s1.flow - s2.flow, 2) as diff from nation a cross join nation b join s s1 on s1.k = a.n_nationkey join s s2 on s2.k = b.n_nationkey where a.n_nationkey < b.n_nationkey order by abs(s1.flow - s2.flow) desc, a, b",
    "q_running_stats": "select user_id, event_id, value, round(sum(value) over w, 4) as running_total, round(avg(value) over w + 0.0000001, 4) as running_avg, min(value) over w as running_min, max(value) over w as running_max, count(*) over w as n, round(value - lag(value) over (partition by user_id order by event_id), 6) as step, case when value > 50 and lag(value) over (partition by user_id order by event_id) < 50 then 'up' when value < 50 and lag(value) over (partition by user_id order by event_id) > 50 then 'down' else 'same' end as pattern from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)",
    "q_avg_group_top10": "select o_custkey, round(avg(o_totalprice), 4) as mean from orders group by o_custkey order by avg(o_totalprice) desc, o_custkey limit 10",
    "q_range_count": "select count(*) as n from lineitem where l_extendedprice between 1000 and 20000 and l_shipdate is not null",
    "q_min_max": "select min(o_orderdate) as first_day, max(o_orderdate) as last_day, min(o_totalprice) as least, max(o_totalprice) as most from orders",
    "q_constant": "select 1 + 1 as two",
    "q_rollup": "select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus) as g from lineitem group by rollup (l_returnflag, l_linestatus)",
    "q_filter_agg": "select event_type, count(*) filter (where value > 50) as high, count(*) as n from events group by event_type",
    "q_set_ops": "select c_nationkey as k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0",
    "j_left": "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "j_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)",
    "j_cross_theta": "select a.r_regionkey as a, b.r_regionkey as b from region a cross join region b where a.r_regionkey < b.r_regionkey",
    "w_range_frame": "select event_id, user_id, sum(event_id) over (partition by user_id order by cast(ts as date)) as so_far, count(*) over (partition by user_id order by cast(ts as date)) as n from events",
    "e_interval": "select count(*) as old, count(*) filter (where ts >= (select max(ts) from events) - interval '7' day) as recent from events where ts < now() - interval '7' day",
    "j_asof": "select e.event_id, max(p.event_id) as purchase from events e left join events p on p.user_id = e.user_id and p.event_type = 'purchase' and p.event_id <= e.event_id group by e.event_id",
}


#: Other SQL for Spark where the plain form is quadratic in a key's rows or sorts more than it must.
FASTER: dict[str, str] = {
    # Of each time the later ones of the same user and type are counted, not listed.
    "q_self_join_ineq": "select user_id, event_type, sum(n * later) as repeats, min(case when later > 0 then ts end) as first_visit, max(case when later > 0 then ts end) as last_visit from (select user_id, event_type, ts, count(*) as n, coalesce(sum(count(*)) over (partition by user_id, event_type order by ts rows between 1 following and unbounded following), 0) as later from events where ts is not null and user_id is not null and event_type is not null group by user_id, event_type, ts) t group by user_id, event_type having sum(n * later) > 3 order by repeats desc, user_id, event_type limit 100",
    "j_asof": "select event_id, max(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id range between unbounded preceding and current row) as purchase from events",
    # One row per nation, customer and teller, so that only those few are counted as different.
    "q_join4_report": f"select n_nationkey, count(distinct c_custkey) as active_accounts, sum(total_txns) as total_txns, round(sum(net_flow), 2) as net_flow, round(sum(credits), 2) as credits, round(sum(debits), 2) as debits, count(distinct tid) as active_tellers from (select n_nationkey, c_custkey, tid, count(delta) as total_txns, sum(delta) as net_flow, sum(case when delta > 0 then delta else 0 end) as credits, sum(case when delta < 0 then delta else 0 end) as debits from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey join {HISTORY} h on h.aid = c_custkey and h.tid = s_suppkey group by n_nationkey, c_custkey, tid) t group by n_nationkey order by total_txns desc, n_nationkey",
}


def shared(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """``text`` over the tables that it names."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = re.sub(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b", r"\1 {\2}", text)
        return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops():
    return F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as keyed changes of one table: signup inserts, error deletes, the rest updates."""
    e = load(spark, sf_dir, "events")
    row = F.struct("user_id", "event_id", "event_type", "value")
    return e.select("user_id", F.col("event_id").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("sub"), (F.col("event_type") == "error").alias("dead"), row.alias("row"))


LAST = "select * from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1"
NET = f"select user_id, event_id, event_type, value from ({LAST}) u where event_type <> 'error'"
COLUMNS = ["user_id", "event_id", "event_type", "value"]


def cdc_net_state(spark, d):
    return merge.net_changes(feed(spark, d), ["user_id"]).where("not dead").select("row.*")


def cdc_dedup_last(spark, d):
    return merge.dedup_last(load(spark, d, "events").select(*COLUMNS), ["user_id", "event_type"], ["event_id"])


def cdc_filter_deleted(spark, d):
    deleted = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey")).distinct()
    return merge.anti_join(load(spark, d, "customer"), deleted, ["c_custkey"])


def cdc_apply_cow(spark, d):
    f = feed(spark, d)
    half = f.agg(F.count("*")).first()[0] // 2
    base = merge.net_changes(f.where(F.col("lsn") < half), ["user_id"]).where("not dead").select("row.*")
    return merge.apply_changes(base, merge.net_changes(f.where(F.col("lsn") >= half), ["user_id"]), ["user_id"])


def cdc_composite_key(spark, d):
    order = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    return merge.dedup_last(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *order), ["l_orderkey", "l_linenumber"], order)


def cdc_key_change(spark, d):
    e = load(spark, d, "events")
    old = e.select("user_id", F.col("event_id").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("sub"), F.lit(True).alias("dead"), F.struct("user_id", "event_id").alias("row")).where("event_type = 'purchase'")
    key = F.when(F.col("event_type") == "purchase", F.col("user_id") + 1000).otherwise(F.col("user_id"))
    new = e.select(key.alias("user_id"), F.col("event_id").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("sub"), F.lit(False).alias("dead"), F.struct(key.alias("user_id"), "event_id").alias("row"))
    return merge.net_changes(old.unionByName(new), ["user_id"]).where("not dead").select("row.*")


def changelog(spark, d):
    """``events`` as change rows: the event type is the table."""
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), F.lit("public").alias("schema_name"), F.col("event_type").alias("table_name"), ops().alias("op"), "user_id", "value")


def cdc_truncate_barrier(spark, d):
    c = changelog(spark, d)
    cut = c.where("table_name = 'click' and lsn % 1000 = 500").select("*").withColumn("op", F.lit("T"))
    return merge.after_truncate(c.unionByName(cut)).where("op <> 'T'").groupBy("table_name").agg(F.count("*").alias("n"), F.min("lsn").alias("first"))


def cdc_replay_dedup(spark, d):
    """The feed to 700 was flushed; it comes again from 300 on."""
    c = changelog(spark, d)
    flushed = c.where("lsn <= 700").groupBy("table_name").agg(F.max("lsn").alias("flush_lsn"))
    again = merge.beyond(c.where("lsn > 300"), flushed, ["table_name"], "flush_lsn")
    return c.where("lsn <= 700").unionByName(again).groupBy("table_name").agg(F.count("*").alias("n"))


def cdc_backfill_overlap(spark, d):
    marks = spark.createDataFrame([("click", 500), ("view", 250)], "table_name string, backfill_lsn bigint")
    return merge.beyond(changelog(spark, d), marks, ["table_name"], "backfill_lsn").groupBy("table_name").agg(F.count("*").alias("n"), F.min("lsn").alias("first"))


def cdc_exclude_tables(spark, d):
    return merge.choose_tables(changelog(spark, d), exclude=["click", "public.view"]).groupBy("table_name").agg(F.count("*").alias("n"))


def cdc_include_tables(spark, d):
    return merge.choose_tables(changelog(spark, d), include=["click", "public.view"]).groupBy("table_name").agg(F.count("*").alias("n"))


def cdc_op_counts(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), ops().alias("op")).agg(F.count("*").alias("n"))


def cdc_pending_min_lsn(spark, d):
    p = merge.pending(changelog(spark, d).where("lsn > 400"), ["table_name"])
    return p.select("table_name", "first_lsn", "last_lsn", F.least("last_lsn", F.col("first_lsn") - 1).alias("ack"))


def cdc_toast_fill(spark, d):
    f = feed(spark, d).withColumn("dead", F.lit(False)).withColumn("toast", F.when(F.col("row.event_type") == "click", F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")))
    base = spark.createDataFrame([], "user_id bigint, value double")
    filled = merge.fill_toast(f, base, ["user_id"], ["value"])
    return merge.net_changes(filled, ["user_id"]).select("row.user_id", "row.event_id", "row.value")


def cdc_rapid_updates(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg((F.count("*") - 1).alias("collapsed"), F.max_by("event_type", "event_id").alias("survivor"))


def j_anti_nullsafe(spark, d):
    c = load(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), "c_name")
    s = load(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey")).alias("k"))
    return merge.anti_join(c, s, ["k"])


def j_full_diff(spark, d):
    e = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    other = e.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, 0.5).otherwise(F.col("c_acctbal"))).unionByName(e.where("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return merge.table_diff(e, other, ["c_custkey"])


# Tables and schemas.


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.  A session on one machine without that setting uses its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, schema: T.StructType) -> SnapshotTable:
    return SnapshotTable(spark, scratch_dir(spark, "tables"), "public", "t").create(schema)


def _halves(spark, d):
    n = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return n.where("c_custkey % 2 = 0"), n.where("c_custkey % 2 = 1")


def _customer_table(spark, d):
    a, b = _halves(spark, d)
    t = scratch_table(spark, a.schema)
    t.append(a, {"last-lsn": 1})
    return t, a, b


def t_append_read(spark, d):
    t, _, b = _customer_table(spark, d)
    t.append(b, {"last-lsn": 2})
    return t.read()


def t_overwrite_read(spark, d):
    t, _, b = _customer_table(spark, d)
    t.overwrite(b)
    return t.read()


def t_time_travel(spark, d):
    t, _, b = _customer_table(spark, d)
    before = t.version()
    t.overwrite(b)
    return t.read(before)


def t_empty_after_delete_all(spark, d):
    t, a, _ = _customer_table(spark, d)
    t.delete_keys(a, ["c_custkey"])
    return t.read()


def t_truncate(spark, d):
    t, _, b = _customer_table(spark, d)
    t.truncate(5)
    t.append(b)
    return t.read()


def t_snapshot_summary(spark, d):
    t, _, b = _customer_table(spark, d)
    t.append(b, {"last-lsn": 2})
    t.overwrite(b, {"last-lsn": 3})
    return t.history().select("operation", "rows", F.col("summary")["last-lsn"].cast("bigint").alias("last_lsn"))


def _evolved(spark, d, changes, defaults=None):
    t, a, b = _customer_table(spark, d)
    t.evolve(changes, defaults)
    return t, b


def s_add_column(spark, d):
    t, b = _evolved(spark, d, [evolve.Change("ADD", "note", evolve.Field("note", reg.TEXT))])
    t.append(b.withColumn("note", F.lit("new")))
    return t.read()


def s_add_default(spark, d):
    t, b = _evolved(spark, d, [evolve.Change("ADD", "status", evolve.Field("status", reg.TEXT))], {"status": "'active'::text"})
    t.append(b.withColumn("status", F.lit("late")))
    return t.read()


def s_drop_column(spark, d):
    t, b = _evolved(spark, d, [evolve.Change("DROP", "c_name")])
    t.append(b.drop("c_name"))
    return t.read()


def s_widen(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    t = scratch_table(spark, n.schema)
    t.append(n)
    t.evolve([evolve.Change("TYPE", "n_nationkey", evolve.Field("n_nationkey", reg.INT8))])
    t.append(n.select((F.col("n_nationkey").cast("bigint") + 5_000_000_000).alias("n_nationkey"), "n_name"))
    return t.read()


def s_multi_change(spark, d):
    t, b = _evolved(spark, d, [evolve.Change("ADD", "extra", evolve.Field("extra", reg.INT8)), evolve.Change("DROP", "c_acctbal")])
    t.append(b.drop("c_acctbal").withColumn("extra", F.col("c_custkey") * 2))
    return t.read()


def s_diff(spark, d):
    old = [evolve.Field("id", reg.INT4, True), evolve.Field("a", reg.TEXT), evolve.Field("b", reg.INT4)]
    new = [evolve.Field("id", reg.INT4), evolve.Field("b", reg.INT8, True), evolve.Field("c", reg.TEXT)]
    return spark.createDataFrame([(c.kind, c.name) for c in evolve.diff_fields(old, new)], "kind string, name string")


CELLS = [("t", "7", "9876543210", "2.5", "2024-01-15", "2024-01-15 10:30:00", "\\x6869"), ("f", "-1", "-5", "Infinity", "1900-01-01", "1970-01-01 00:00:00", "\\x"), ("x", "1.5", "z", "q", "0001-01-01 BC", "infinity", "hi")]
CELL_OIDS = [("b", reg.BOOL), ("i", reg.INT4), ("l", reg.INT8), ("f", reg.FLOAT8), ("d", reg.DATE), ("ts", reg.TIMESTAMP), ("raw", reg.BYTEA)]


def _cells(spark):
    return spark.createDataFrame(CELLS, ", ".join(f"{n} string" for n, _ in CELL_OIDS))


def ty_parse_all(spark, d):
    parsed = _cells(spark).select(*[reg.parse(F.col(n), oid).alias(n) for n, oid in CELL_OIDS])
    return parsed.withColumn("raw", F.decode("raw", "utf-8"))


def ty_round_trip(spark, d):
    """All cells; those that have no value come back null."""
    return _cells(spark).select(*[reg.render(reg.parse(F.col(n), oid), oid).alias(n) for n, oid in CELL_OIDS])


LINES = ["1\ta\\tb\t\\N", "2\tback\\\\slash\\x41\\101\t2.5", "3\t\\q\\n\t\\N", "\\."]


def copy_parse(spark, d):
    return copytext.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string"), [("id", reg.INT4), ("name", reg.TEXT), ("value", reg.FLOAT8)])


def copy_unescape(spark, d):
    return load(spark, d, "nation").select("n_nationkey", copytext.copy_unescape(F.concat(F.col("n_name"), F.lit("\\t\\\\n"))).alias("name"))


def lsn_codec(spark, d):
    e = load(spark, d, "events").select("event_id", (F.col("event_id") * 7_000_000_007).alias("lsn"))
    return e.select("event_id", "lsn", reg.lsn_to_bigint(reg.bigint_to_lsn(F.col("lsn"))).alias("again"))


# Streams.

FIELDS = {("public", "users"): [evolve.Field("user_id", reg.INT8, True), evolve.Field("event_id", reg.INT8), evolve.Field("event_type", reg.TEXT)]}


def _stream(spark, d, restarts: int):
    from ..engine import Engine

    root = scratch_dir(spark, "stream")
    text = lambda c: F.col(c).cast("string")
    new = F.create_map(F.lit("user_id"), text("user_id"), F.lit("event_id"), text("event_id"), F.lit("event_type"), text("event_type"))
    op = F.when(F.col("event_type") == "error", "D").otherwise("U")
    log = load(spark, d, "events").select(F.col("event_id").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), F.lit("public").alias("schema_name"), F.lit("users").alias("table_name"), F.lit(1).alias("rel_version"), op.alias("op"), F.create_map(F.lit("user_id"), text("user_id")).alias("old_key"), F.when(op != "D", new).alias("new_row"), F.array().cast("array<string>").alias("toast"))
    log.withColumn("lsn", F.col("lsn") + 1).write.parquet(f"{root}/log")
    engine = Engine(spark, f"{root}/tables")
    for i in range(restarts + 1):
        source = spark.readStream.schema(merge.CHANGELOG).parquet(f"{root}/log")
        engine.sync(source, FIELDS, f"{root}/checkpoint-{i}", once=True).awaitTermination()  # a fresh checkpoint replays everything
    return engine.table("public", "users").read()


def st_foreach_batch_final_state(spark, d):
    return _stream(spark, d, 0)


def st_restart_idempotent(spark, d):
    return _stream(spark, d, 1)


def _log(spark, d, where: str = "true"):
    """``events`` as a change log of one table keyed by event, all inserts."""
    text = lambda c: F.col(c).cast("string")
    new = F.create_map(F.lit("event_id"), text("event_id"), F.lit("user_id"), text("user_id"), F.lit("event_type"), text("event_type"))
    return load(spark, d, "events").where(where).select(F.lit(10).cast("bigint").alias("lsn"), F.col("event_id").alias("seq"), F.lit("public").alias("schema_name"), F.lit("e").alias("table_name"), F.lit(1).alias("rel_version"), F.lit("I").alias("op"), F.lit(None).cast("map<string,string>").alias("old_key"), new.alias("new_row"), F.array().cast("array<string>").alias("toast"))


E_FIELDS = {("public", "e"): [evolve.Field("event_id", reg.INT8, True), evolve.Field("user_id", reg.INT8), evolve.Field("event_type", reg.TEXT)]}
PARTS = ("event_id < 100", "event_id between 100 and 299", "event_id >= 300")


def _engine(spark):
    from ..engine import Engine

    return Engine(spark, scratch_dir(spark, "engine"))


def st_split_lsn(spark, d):
    """One position in three batches, the middle one twice: nothing is lost and nothing comes twice."""
    engine = _engine(spark)
    for where in (PARTS[0], PARTS[1], PARTS[1], PARTS[2]):
        engine.apply(_log(spark, d, where), E_FIELDS)
    return engine.table("public", "e").read()


def t_insert_only_appends(spark, d):
    engine = _engine(spark)
    for where in PARTS:
        engine.apply(_log(spark, d, where), E_FIELDS)
    return engine.table("public", "e").history().select("version", "operation", "rows")


def t_pruned_merge(spark, d):
    """Three files by key range; a change in one of them leaves the others' files as they are."""
    engine = _engine(spark)
    engine.config.rows_per_file = 0  # a range is one file at any size
    for where in PARTS:
        engine.apply(_log(spark, d, where).coalesce(1), E_FIELDS)
    table = engine.table("public", "e")
    before = set(table.files())
    gone = _log(spark, d, "event_id between 120 and 130").withColumn("lsn", F.col("lsn") + 1).withColumn("op", F.lit("D")).withColumn("old_key", F.col("new_row"))
    engine.apply(gone, E_FIELDS)
    kept = len(before & set(table.files()))
    return table.read().select("event_id", F.lit(kept).alias("files_kept"))


def t_merge_on_read(spark, d):
    engine = _engine(spark)
    engine.config.merge_on_read = True
    engine.apply(_log(spark, d), E_FIELDS)
    log = _log(spark, d, "event_id % 3 = 0").withColumn("lsn", F.col("lsn") + 1).withColumn("old_key", F.col("new_row"))
    moved = F.map_concat(F.map_filter("new_row", lambda k, _: k != "user_id"), F.create_map(F.lit("user_id"), F.lit("-1")))
    engine.apply(log.withColumn("op", F.when(F.col("seq") % 2 == 0, "D").otherwise("U")).withColumn("new_row", F.when(F.col("op") == "U", moved)), E_FIELDS)
    return engine.table("public", "e").read()


def t_recover_after_fault(spark, d):
    """The hint of a commit could not be written; the next commit goes through."""
    t, _, b = _customer_table(spark, d)
    write = t.store.write

    def broken(name, text, overwrite):
        if "version-hint" in name:
            raise OSError("no hint")
        write(name, text, overwrite)

    t.store.write = broken
    try:
        t.overwrite(b)
    except OSError:
        pass
    t.store.write = write
    t.append(b, {"last-lsn": 2})
    return t.read()


def t_time_travel_evolved(spark, d):
    """A version from before a column came is read without it."""
    t, _, b = _customer_table(spark, d)
    before = t.version()
    t.evolve([evolve.Change("ADD", "note", evolve.Field("note", reg.TEXT)), evolve.Change("DROP", "c_name")])
    t.append(b.drop("c_name").withColumn("note", F.lit("new")))
    return t.read(before)


def _told(fields) -> dict[str, str]:
    return {"fields": json.dumps([vars(f) for f in fields])}


def st_schema_change(spark, d):
    """A column comes in the middle of a batch: earlier rows are merged first and hold null."""
    engine, narrow = _engine(spark), E_FIELDS["public", "e"]
    old = _log(spark, d, "event_id < 300")
    value = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("value").cast("string").alias("value"))
    new = _log(spark, d, "event_id >= 300").join(value, "seq").withColumn("new_row", F.map_concat("new_row", F.create_map(F.lit("value"), F.col("value")))).withColumn("lsn", F.col("lsn") + 2).withColumn("rel_version", F.lit(2)).select(*old.columns)
    rows = [(lsn, 0, "public", "e", version, "R", None, _told(fields), []) for lsn, version, fields in ((9, 1, narrow), (11, 2, [*narrow, evolve.Field("value", reg.FLOAT8)]))]
    engine.apply(old.unionByName(new).unionByName(spark.createDataFrame(rows, merge.CHANGELOG)))
    return engine.table("public", "e").read()


def st_message_log(spark, d):
    """``nation`` as binary replication messages through the stream source, in batches of whole transactions."""
    from ..sources import pgoutput as pg
    from ..streaming.messages import frame

    engine = _engine(spark)
    engine.config.flush_rows = 25
    fields = [evolve.Field("n_nationkey", reg.INT8, True), evolve.Field("n_name", reg.TEXT)]
    begin, commit = b"B" + bytes(20), b"C" + bytes(25)
    log, lsn = [frame(1, pg.relation(7, "public", "nation", fields))], 1
    for r in load(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():  # a fixture of 25 rows
        key = str(r["n_nationkey"])
        changes = [pg.insert(7, [key, r["n_name"]]), pg.update(7, [key, r["n_name"] + "!"])] + [pg.delete(7, [key, None])] * (key == "3")
        for message in (begin, *changes, commit):
            lsn += 1
            log.append(frame(lsn, message))
    engine.store.write(f"{engine.root}/log/0001.log", b"".join(log), overwrite=False)
    for _ in range(2):  # a second stream goes on where the slot stands, and changes nothing
        engine.catch_up(engine.stream(f"{engine.root}/log"), None, f"{engine.root}/checkpoint-{uuid.uuid4().hex}")
    return engine.table("public", "nation").read()


def j_catalog(spark, d):
    """The source's catalog relations, as fixtures: live columns of one table with key and default."""
    from ..sources import catalog

    frames = {
        "namespace": spark.createDataFrame([(1, "public"), (2, "other")], "oid bigint, nspname string"),
        "class": spark.createDataFrame([(10, "t", 1), (11, "t", 2), (12, "u", 1)], "oid bigint, relname string, relnamespace bigint"),
        "attribute": spark.createDataFrame([(10, "id", 20, -1, 1, False), (10, "gone", 25, -1, 2, True), (10, "status", 25, -1, 3, False), (11, "x", 23, -1, 1, False)], "attrelid bigint, attname string, atttypid bigint, atttypmod int, attnum int, attisdropped boolean"),
        "attrdef": spark.createDataFrame([(10, 3, "'active'::text"), (11, 1, "0")], "adrelid bigint, adnum int, expr string"),
        "key": spark.createDataFrame([(10, 1)], "indrelid bigint, attnum int"),
    }
    return catalog.live(frames, "public", "t")


def sql_pass_through(spark, d):
    """DDL and DML go to Spark as they are."""
    engine, name = _engine(spark), f"t_{uuid.uuid4().hex}"
    engine.sql(f"create table {name} (k int, v string) using parquet location '{engine.root}/ddl'")
    engine.sql(f"insert into {name} values (1, 'a'), (2, 'b;c');")
    return engine.sql(f"select k, v from {name}")


HALVES = "select c_custkey, c_name, c_acctbal from customer"
BUILT: dict[str, tuple[Callable, str]] = {
    "cdc_net_state": (cdc_net_state, NET),
    "cdc_dedup_last": (cdc_dedup_last, "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) t where rn = 1"),
    "cdc_filter_deleted": (cdc_filter_deleted, "select * from customer where c_custkey not in (select user_id from events where event_type = 'error')"),
    "cdc_apply_cow": (cdc_apply_cow, NET),
    "cdc_composite_key": (cdc_composite_key, "select l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_extendedprice desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_discount desc, l_tax desc) as rn from lineitem) t where rn = 1"),
    "cdc_key_change": (cdc_key_change, "select k as user_id, event_id from (select *, row_number() over (partition by k order by event_id desc, sub desc) as rn from (select user_id as k, event_id, 0 as sub, true as dead from events where event_type = 'purchase' union all select case when event_type = 'purchase' then user_id + 1000 else user_id end, event_id, 1, false from events) c) t where rn = 1 and not dead"),
    "cdc_truncate_barrier": (cdc_truncate_barrier, "select event_type as table_name, count(*) as n, min(event_id) as first from events where event_type <> 'click' or event_id > coalesce((select max(event_id) from events where event_type = 'click' and event_id % 1000 = 500), -1) group by event_type"),
    "cdc_replay_dedup": (cdc_replay_dedup, "select event_type as table_name, count(*) as n from events group by event_type"),
    "cdc_backfill_overlap": (cdc_backfill_overlap, "select event_type as table_name, count(*) as n, min(event_id) as first from events where event_id > case event_type when 'click' then 500 when 'view' then 250 else -1 end group by event_type"),
    "cdc_exclude_tables": (cdc_exclude_tables, "select event_type as table_name, count(*) as n from events where event_type not in ('click', 'view') group by event_type"),
    "cdc_include_tables": (cdc_include_tables, "select event_type as table_name, count(*) as n from events where event_type in ('click', 'view') group by event_type"),
    "cdc_op_counts": (cdc_op_counts, "select cast(ts as date) as day, case event_type when 'signup' then 'I' when 'error' then 'D' else 'U' end as op, count(*) as n from events group by 1, 2"),
    "cdc_pending_min_lsn": (cdc_pending_min_lsn, "select event_type as table_name, min(event_id) as first_lsn, max(event_id) as last_lsn, least(max(event_id), min(event_id) - 1) as ack from events where event_id > 400 group by event_type"),
    "cdc_toast_fill": (cdc_toast_fill, "select user_id, max(event_id) as event_id, arg_max(value, event_id) filter (where event_type <> 'click') as value from events group by user_id"),
    "cdc_rapid_updates": (cdc_rapid_updates, "select user_id, count(*) - 1 as collapsed, arg_max(event_type, event_id) as survivor from events group by user_id"),
    "j_anti_nullsafe": (j_anti_nullsafe, "select k, c_name from (select case when c_custkey % 10 <> 0 then c_custkey end as k, c_name from customer) c where not exists (select 1 from (select case when s_suppkey % 10 <> 0 then s_suppkey end as k from supplier) s where s.k is not distinct from c.k)"),
    "j_full_diff": (j_full_diff, "select c_custkey, 'missing' as kind from customer where c_custkey % 7 = 0 union all select c_custkey + 1000000, 'extra' from customer where c_custkey % 5 = 0 union all select c_custkey, 'mismatch' from customer where c_custkey % 7 <> 0 and c_custkey % 11 = 0 and c_acctbal is distinct from 0.5"),
    "t_append_read": (t_append_read, HALVES),
    "t_overwrite_read": (t_overwrite_read, HALVES + " where c_custkey % 2 = 1"),
    "t_time_travel": (t_time_travel, HALVES + " where c_custkey % 2 = 0"),
    "t_empty_after_delete_all": (t_empty_after_delete_all, HALVES + " where false"),
    "t_truncate": (t_truncate, HALVES + " where c_custkey % 2 = 1"),
    "t_snapshot_summary": (t_snapshot_summary, "select 'append' as operation, count(*) filter (where c_custkey % 2 = 0) as rows, cast(1 as bigint) as last_lsn from customer union all select 'append', count(*), 2 from customer union all select 'overwrite', count(*) filter (where c_custkey % 2 = 1), 3 from customer"),
    "s_add_column": (s_add_column, "select c_custkey, c_name, c_acctbal, case when c_custkey % 2 = 1 then 'new' end as note from customer"),
    "s_add_default": (s_add_default, "select c_custkey, c_name, c_acctbal, case when c_custkey % 2 = 1 then 'late' else 'active' end as status from customer"),
    "s_drop_column": (s_drop_column, "select c_custkey, c_acctbal from customer"),
    "s_widen": (s_widen, "select cast(n_nationkey as bigint) as n_nationkey, n_name from nation union all select n_nationkey + 5000000000, n_name from nation"),
    "s_multi_change": (s_multi_change, "select c_custkey, c_name, case when c_custkey % 2 = 1 then c_custkey * 2 end as extra from customer"),
    "s_diff": (s_diff, "select * from (values ('ADD', 'c'), ('DROP', 'a'), ('TYPE', 'b'), ('KEY', 'b')) t(kind, name)"),
    "ty_parse_all": (ty_parse_all, "select * from (values (true, 7, 9876543210, 2.5::double, date '2024-01-15', timestamp '2024-01-15 10:30:00', 'hi'), (false, -1, -5, 'Infinity'::double, date '1900-01-01', timestamp '1970-01-01', ''), (null, null, null, null, null, null, null)) t(b, i, l, f, d, ts, raw)"),
    "ty_round_trip": (ty_round_trip, "select * from (values ('t', '7', '9876543210', '2.5', '2024-01-15', '2024-01-15 10:30:00', '\\x6869'), ('f', '-1', '-5', 'Infinity', '1900-01-01', '1970-01-01 00:00:00', '\\x'), (null, null, null, null, null, null, null)) t(b, i, l, f, d, ts, raw)"),
    "copy_parse": (copy_parse, "select * from (values (1, 'a' || chr(9) || 'b', null::double), (2, 'back\\slashAA', 2.5), (3, 'q' || chr(10), null)) t(id, name, value)"),
    "copy_unescape": (copy_unescape, "select n_nationkey, n_name || chr(9) || '\\n' as name from nation"),
    "lsn_codec": (lsn_codec, "select event_id, event_id * 7000000007 as lsn, event_id * 7000000007 as again from events"),
    "st_foreach_batch_final_state": (st_foreach_batch_final_state, "select user_id, event_id, event_type from (" + NET + ") s"),
    "st_split_lsn": (st_split_lsn, "select event_id, user_id, event_type from events"),
    "st_schema_change": (st_schema_change, "select event_id, user_id, event_type, case when event_id >= 300 then value end as value from events"),
    "st_message_log": (st_message_log, "select n_nationkey, n_name || '!' as n_name from nation where n_nationkey <> 3"),
    "t_insert_only_appends": (t_insert_only_appends, "select 2 as version, 'append' as operation, count(*) filter (where event_id < 100) as rows from events union all select 3, 'append', count(*) filter (where event_id < 300) from events union all select 4, 'append', count(*) from events"),
    "t_pruned_merge": (t_pruned_merge, "select event_id, 2 as files_kept from events where event_id not between 120 and 130"),
    "t_merge_on_read": (t_merge_on_read, "select event_id, case when event_id % 3 = 0 then -1 else user_id end as user_id, event_type from events where event_id % 3 <> 0 or event_id % 2 <> 0"),
    "t_recover_after_fault": (t_recover_after_fault, HALVES),
    "t_time_travel_evolved": (t_time_travel_evolved, HALVES + " where c_custkey % 2 = 0"),
    "j_catalog": (j_catalog, "select * from (values (1, 'id', cast(20 as bigint), -1, true, null), (3, 'status', 25, -1, false, '''active''::text')) t(attnum, attname, atttypid, atttypmod, is_key, default_expr)"),
    "sql_pass_through": (sql_pass_through, "select * from (values (1, 'a'), (2, 'b;c')) t(k, v)"),
    "st_restart_idempotent": (st_restart_idempotent, "select user_id, event_id, event_type from (" + NET + ") s"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: shared(FASTER.get(k, v)) for k, v in SQL.items()} | {k: f for k, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | {k: s for k, (_, s) in BUILT.items()}
