"""Change-log dataflow: filters, net changes per key, and the copy-on-write merge.  All of it is DataFrame plans.

A *keyed change* has the key columns, ``lsn``, ``seq``, ``sub``, ``dead`` and ``row`` (a struct of all columns).
An update is two of them: its old key dies (sub 0) and its new row lives (sub 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as reg

CHANGELOG = "lsn bigint, seq bigint, schema_name string, table_name string, rel_version int, op string, old_key map<string,string>, new_row map<string,string>, toast array<string>"
ORDER = ["lsn", "seq", "sub"]


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Null equals null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def typed(source: Column, schema: T.StructType) -> Column:
    return F.struct(*[reg.parse(source[f.name], f.metadata.get("oid", reg.TEXT)).cast(f.dataType).alias(f.name) for f in schema.fields])


def keyed(changes: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Keyed changes of one table's change log.  Updates and deletes without a key are dropped."""
    row, old = typed(F.col("new_row"), schema), typed(F.col("old_key"), schema)
    dead = F.struct(F.lit(0).alias("sub"), F.lit(True).alias("dead"), old.alias("row"))
    live = F.struct(F.lit(1).alias("sub"), F.lit(False).alias("dead"), row.alias("row"))
    parts = F.when(F.col("op") == "I", F.array(live)).when(F.col("old_key").isNull(), F.array().cast(T.ArrayType(T.StructType([T.StructField("sub", T.IntegerType()), T.StructField("dead", T.BooleanType()), T.StructField("row", schema)]))))
    parts = parts.when(F.col("op") == "U", F.array(dead, live)).when(F.col("op") == "D", F.array(dead))
    out = changes.where(F.col("op").isin("I", "U", "D")).select("lsn", "seq", F.coalesce("toast", F.array().cast("array<string>")).alias("toast"), F.explode(parts).alias("c")).select("lsn", "seq", "toast", "c.*")
    return out.select(*[F.col(f"row.{k}").alias(k) for k in keys], "lsn", "seq", "sub", "dead", "row", "toast")


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key.  The limit of one row per key is applied before the shuffle too, so hot keys are cheap."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def net_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last keyed change of each key."""
    return last_rows(changes, keys, ORDER).select(*keys, "dead", "row")


def dedup_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key; without keys all rows."""
    return last_rows(rows, keys, order) if keys else rows


def semi_join(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is in ``named``."""
    return rows.alias("l").join(named.select(*keys).distinct().alias("r"), same_key("l", "r", keys), "left_semi")


def anti_join(rows: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is not in ``deletes``; Spark broadcasts or sorts by what it measures."""
    return rows.alias("l").join(deletes.select(*keys).alias("r"), same_key("l", "r", keys), "left_anti")


def apply_changes(existing: DataFrame, net: DataFrame, keys: list[str]) -> DataFrame:
    """Copy-on-write merge: what is untouched, and the rows that are alive."""
    alive = net.where(~F.col("dead")).select("row.*")
    return anti_join(existing, net, keys).unionByName(alive, allowMissingColumns=True)


def fill_toast(changes: DataFrame, existing: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Replace values that updates left out as unchanged.

    Per key each column takes its last sent value since the key last died; where none was sent, the value
    of the existing row under the key that the update names.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(*ORDER)
    life = F.sum((F.col("dead") & ~F.col("replaced")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nxt = Window.partitionBy(*keys).orderBy(*ORDER)
    marked = changes.withColumn("replaced", (F.lead("lsn").over(nxt) == F.col("lsn")) & (F.lead("seq").over(nxt) == F.col("seq"))).withColumn("replaced", F.coalesce("replaced", F.lit(False))).withColumn("life", life)
    seen = Window.partitionBy(*keys, "life").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*columns).alias("_old"))
    joined = marked.join(old, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    sent = {c: F.last(F.when(~F.col("dead") & ~F.array_contains("toast", c), F.struct(F.col(f"row.{c}").alias("v"))), ignorenulls=True).over(seen) for c in columns}
    filled = {c: F.when(F.array_contains("toast", c), F.when(sent[c].isNotNull(), sent[c]["v"]).when(F.col("life") == 0, F.col(f"_old.{c}"))).otherwise(F.col(f"row.{c}")) for c in columns}
    names = [f.name for f in changes.schema["row"].dataType.fields]
    row = F.struct(*[(filled[n] if n in filled else F.col(f"row.{n}")).alias(n) for n in names])
    return joined.select(*keys, "lsn", "seq", "sub", "dead", row.alias("row"), "toast")


def truncate_barrier(changes: DataFrame) -> DataFrame:
    """``(schema_name, table_name, barrier)``: the last truncate of each table."""
    return changes.where("op = 'T'").groupBy("schema_name", "table_name").agg(F.max(F.struct("lsn", "seq")).alias("barrier"))


def after_truncate(changes: DataFrame) -> DataFrame:
    """Changes later than their table's last truncate.  A table has one barrier row, so it broadcasts well."""
    t = truncate_barrier(changes)
    on = ["schema_name", "table_name"]
    return changes.join(t, on, "left").where(F.col("barrier").isNull() | (F.struct("lsn", "seq") > F.col("barrier"))).drop("barrier")


def beyond(changes: DataFrame, marks: DataFrame, on: list[str], mark: str) -> DataFrame:
    """Changes with an LSN above their table's ``mark`` (flushed or backfilled position); tables without one pass."""
    return changes.join(marks.select(*on, F.col(mark).alias("_mark")), on, "left").where(F.col("lsn") > F.coalesce("_mark", F.lit(-1))).drop("_mark")


def choose_tables(changes: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    name = F.concat_ws(".", "schema_name", "table_name")
    matches = lambda names: name.isin(*names) | F.col("table_name").isin(*names)
    if include:
        changes = changes.where(matches(list(include)))
    return changes.where(~matches(list(exclude))) if exclude else changes


def pending(changes: DataFrame, on: list[str]) -> DataFrame:
    """First unflushed LSN of each table."""
    return changes.groupBy(*on).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def safe_ack(received: int, first_lsns: list[int]) -> int:
    """The position up to which nothing is pending."""
    return min([received, *(x - 1 for x in first_lsns if x)])


def table_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``missing`` (only left), ``extra`` (only right) and ``mismatch`` rows by key."""
    rest = [c for c in left.columns if c not in keys]
    a, b = left.withColumn("_l", F.lit(True)).alias("a"), right.withColumn("_r", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rest], F.lit(True))
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(~same, "mismatch")
    return a.join(b, same_key("a", "b", keys), "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], kind.alias("kind")).where("kind is not null")
