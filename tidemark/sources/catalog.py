"""The source database's own catalog: live columns, defaults, and a copy of a table.

The catalog relations ``attribute``, ``class``, ``namespace`` and ``attrdef`` are frames, read over JDBC by
``connect`` or made from fixtures; the joins on them are Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as reg
from ..plans.evolve import Field

# What is read of each catalog relation.
RELATIONS = {
    "attribute": "(select attrelid::bigint, attname::text, atttypid::bigint, atttypmod, attnum, attisdropped from pg_catalog.pg_attribute where attnum > 0) t",
    "class": "(select oid::bigint, relname::text, relnamespace::bigint from pg_catalog.pg_class) t",
    "namespace": "(select oid::bigint, nspname::text from pg_catalog.pg_namespace) t",
    "attrdef": "(select adrelid::bigint, adnum, pg_get_expr(adbin, adrelid) as expr from pg_catalog.pg_attrdef) t",
    "key": "(select indrelid::bigint, unnest(indkey) as attnum from pg_catalog.pg_index where indisprimary) t",
}


def connect(spark: SparkSession, url: str, **options) -> dict[str, DataFrame]:
    return {name: spark.read.format("jdbc").options(url=url, dbtable=query, **options).load() for name, query in RELATIONS.items()}


def live(catalog: dict[str, DataFrame], schema: str, table: str) -> DataFrame:
    """The columns of a table that aren't dropped, with ``is_key`` and the text of their default."""
    n, c, a, d, k = (catalog[x].alias(x) for x in ("namespace", "class", "attribute", "attrdef", "key"))
    own = n.where(F.col("nspname") == schema).join(c.where(F.col("relname") == table), F.col("class.relnamespace") == F.col("namespace.oid"))
    columns = own.join(a.where(~F.col("attisdropped")), F.col("attribute.attrelid") == F.col("class.oid"))
    columns = columns.join(d, (F.col("attrdef.adrelid") == F.col("attribute.attrelid")) & (F.col("attrdef.adnum") == F.col("attribute.attnum")), "left")
    columns = columns.join(k, (F.col("key.indrelid") == F.col("attribute.attrelid")) & (F.col("key.attnum") == F.col("attribute.attnum")), "left")
    return columns.select("attribute.attnum", "attname", "atttypid", "atttypmod", F.col("key.attnum").isNotNull().alias("is_key"), F.col("attrdef.expr").alias("default_expr")).orderBy("attnum")


def fields(catalog: dict[str, DataFrame], schema: str, table: str) -> list[Field]:
    return [Field(r["attname"], r["atttypid"], r["is_key"], r["atttypmod"]) for r in live(catalog, schema, table).collect()]  # a row per column


def defaults(catalog: dict[str, DataFrame], schema: str, table: str, names: list[str]) -> dict[str, str]:
    """Text of the default of each of ``names`` that has one."""
    return {r["attname"]: r["default_expr"] for r in live(catalog, schema, table).where(F.col("attname").isin(names) & F.col("default_expr").isNotNull()).collect()}


def copy_table(spark: SparkSession, url: str, schema: str, table: str, columns: list[Field], by: str | None = None, parts: int = 1, **options) -> DataFrame:
    """A table over JDBC, cell by cell as text and then typed like the change feed.

    With ``by``, a whole-number column, ``parts`` connections read a range of its hash each.  Connections don't
    share a snapshot: changes after the position that ``resync`` is told repair what they see differently.
    """
    text = ", ".join(f"{reg.quote_ident(f.name)}::text as {reg.quote_ident(f.name)}" for f in columns)
    source = f"{reg.quote_ident(schema)}.{reg.quote_ident(table)}"
    frames = []
    for i in range(parts):
        where = f" where mod(abs({reg.quote_ident(by)}::bigint), {parts}) = {i}" if by and parts > 1 else ""
        frames.append(spark.read.format("jdbc").options(url=url, dbtable=f"(select {text} from {source}{where}) t", **options).load())
        if not (by and parts > 1):
            break
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(*[reg.parse(F.col(f.name), f.oid).alias(f.name) for f in columns])
