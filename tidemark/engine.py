"""The engine: change feed in, versioned tables out, SQL over them."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators.snapshot import SnapshotTable, Store
from .plans import evolve, merge
from .plans.evolve import Field
from .sources import copytext

log = logging.getLogger("tidemark")

SPARK_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.fieldId.write.enabled": "true", "spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.adaptive.enabled": "true"}


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        for k, v in SPARK_CONF.items():
            spark.conf.set(k, v)
        self.store = Store(spark, self.root)
        self.views: set[str] = set()
        self.owner, self.lock = uuid.uuid4().hex, threading.RLock()

    def table(self, schema: str, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.root, schema, name, self.store, self.owner, self.config.rows_per_file)

    # Registry of tables and backfill positions, one small JSON file beside the tables.

    def state(self) -> dict:
        path = f"{self.root}/_state.json"
        return json.loads(self.store.read(path)) if self.store.exists(path) else {"tables": {}, "backfill": {}}

    def _save_state(self, state: dict) -> None:
        self.store.write(f"{self.root}/_state.json", json.dumps(state), overwrite=True)

    # Query side.

    def tables(self) -> list[tuple[str, str]]:
        found = self.store.list(f"{self.root}/*/*/metadata/version-hint.text")
        return sorted(tuple(p.split("/")[-4:-2]) for p in found)

    def refresh(self) -> list[str]:
        """Views ``schema_table``, and ``table`` where only one schema has it; those of tables that went are dropped."""
        now = self.tables()
        names = [t for _, t in now]
        wanted = {}
        for s, t in now:
            wanted[f"{s}_{t}"] = (s, t)
            if names.count(t) == 1:
                wanted.setdefault(t, (s, t))
        for name in self.views - wanted.keys():
            self.spark.catalog.dropTempView(name)
        for name, (s, t) in wanted.items():
            self.table(s, t).read().createOrReplaceTempView(name)
        self.views = set(wanted)
        return sorted(wanted)

    def resolve(self, name: str) -> tuple[str, str]:
        schema, _, table = name.rpartition(".")
        found = [x for x in self.tables() if x[1] == table and (not schema or x[0] == schema)]
        if len(found) != 1:
            raise KeyError(f"{name}: {'no such table' if not found else 'in several schemas: ' + ', '.join(s for s, _ in found)}")
        return found[0]

    def sql(self, text: str, fresh: bool = True, **args) -> DataFrame | None:
        """Run ``text`` over fresh views (or those of the last refresh); empty text gives None.  ``args`` are bound by name."""
        if not text.strip().rstrip(";"):
            return None
        if fresh:
            self.refresh()
        return self.spark.sql(text.strip().rstrip(";"), args=args or None)

    # Change side.

    def apply(self, batch: DataFrame, fields: dict[tuple[str, str], list[Field]] | None = None, batch_id: int | None = None, defaults: dict[str, str] | None = None, primary_key: dict[tuple[str, str], list[str]] | None = None) -> dict[tuple[str, str], int]:
        """Merge one micro-batch of change rows into all tables it names; the new version of each.

        A table's snapshot holds the last position (LSN and sequence number) and batch that went into it, so a
        batch that comes again is skipped whatever step failed before.  Rows of op ``R`` describe a table from
        there on: what came before them is merged under the old schema first.  A table that nothing
        describes fails the batch, but only after all others are merged.
        """
        chosen = merge.choose_tables(batch, self.config.include_tables, self.config.exclude_tables).persist()
        try:
            parts = chosen.groupBy("schema_name", "table_name", "rel_version").agg(F.min(F.struct("lsn", "seq")).alias("start"), F.max(F.when(F.col("op") == "R", F.struct("lsn", "seq", F.col("new_row")["fields"].alias("fields")))).alias("relation"))
            touched: dict[tuple[str, str], list] = {}
            for r in parts.collect():  # a row per table and version of its schema
                touched.setdefault((r["schema_name"], r["table_name"]), []).append(r)

            def one(name: tuple[str, str]) -> int | None:
                version = None
                for r in sorted(touched[name], key=lambda r: tuple(r["start"])):
                    own = chosen.where((F.col("schema_name") == name[0]) & (F.col("table_name") == name[1]) & F.col("rel_version").eqNullSafe(F.lit(r["rel_version"])) & (F.col("op") != "R"))
                    known = self._describe(name, r["rel_version"], r["relation"] and r["relation"]["fields"], (fields or {}).get(name))
                    version = self._apply(own, name, known, batch_id, defaults, (primary_key or {}).get(name)) or version
                return version

            out, failed = {}, []
            with ThreadPoolExecutor(self.config.parallel_tables) as pool:
                running = {name: pool.submit(one, name) for name in sorted(touched)}
            for name, result in running.items():
                if error := result.exception():
                    failed.append(error)
                elif result.result():
                    out[name] = result.result()
            if failed:
                raise failed[0]
        finally:
            chosen.unpersist()
        return out

    def _describe(self, name: tuple[str, str], version: int | None, told: str | None, given: list[Field] | None) -> list[Field]:
        """The columns under which changes of relation ``version`` are read: as the stream told, now or before, else as given."""
        with self.lock:
            state = self.state()
            seen = state.setdefault("relations", {}).get(".".join(name))
            if told is not None:
                state["relations"][".".join(name)] = {"version": version, "fields": json.loads(told)}
                self._save_state(state)
                seen = state["relations"][".".join(name)]
        if seen and (told is not None or seen["version"] == version or given is None):
            return [Field(**f) for f in seen["fields"]]
        if given is None:
            raise KeyError(f"{'.'.join(name)}: neither the stream nor the caller describes this table")
        return given

    def _apply(self, own: DataFrame, name: tuple[str, str], fields: list[Field], batch_id: int | None, defaults: dict[str, str] | None, primary_key: list[str] | None) -> int | None:
        target = self.table(*name)
        here = target.exists()
        lsn, seq = target.flushed() if here else (0, 1 << 62)
        if here and (copied := self.state()["backfill"].get(".".join(name), 0)) > lsn:
            lsn, seq = copied, 1 << 62
        own = own.where((F.col("lsn") > lsn) | ((F.col("lsn") == lsn) & (F.col("seq") > seq)))
        facts = own.agg(F.max(F.struct("lsn", "seq")).alias("last"), F.min("lsn").alias("first"), F.max(F.when(F.col("op") == "T", F.struct("lsn", "seq"))).alias("cut"), F.max(F.col("op").isin("U", "D")).alias("mixed"), F.max(F.size(F.coalesce("toast", F.array().cast("array<string>")))).alias("toast"), F.count(F.when(F.col("op").isin("I", "U"), 1)).alias("rows"), F.count(F.when(F.col("op").isin("U", "D") & F.col("old_key").isNull(), 1)).alias("keyless")).first()
        if facts["last"] is None or (not here and not facts["rows"]):
            return None  # nothing new, or only deletes and truncates of a table that isn't there
        if not here:
            target.create(evolve.initial(fields))
        elif changes := evolve.reconcile(target.schema(), fields):
            target.evolve(changes, defaults)
        schema = target.schema()
        keys = primary_key or [f.name for f in fields if f.is_key]
        summary = {"last-lsn": facts["last"]["lsn"], "last-seq": facts["last"]["seq"], "first-lsn": facts["first"], **({"batch-id": batch_id} if batch_id is not None else {})}
        if facts["keyless"]:
            log.warning("%s: %d updates or deletes without a key were left out", ".".join(name), facts["keyless"])
            summary["skipped-keyless"] = facts["keyless"]
        if cut := facts["cut"]:
            own = own.where((F.col("lsn") > cut["lsn"]) | ((F.col("lsn") == cut["lsn"]) & (F.col("seq") > cut["seq"])))
        if not keys or (not facts["mixed"] and not cut):
            rows = own.where("op = 'I'").select(merge.typed(F.col("new_row"), schema).alias("row")).select("row.*")
            return target.commit(rows, "overwrite" if cut else "append", summary)
        changes = merge.keyed(own, schema, keys)
        base = self.spark.createDataFrame([], schema) if cut else None
        if facts["toast"]:
            if base is None:
                # Only rows that an update names are read for the values it left out.
                base = merge.semi_join(target.read(), changes, keys)
            changes = merge.fill_toast(changes, base, keys, [f.name for f in schema.fields if f.name not in keys])
        net = merge.net_changes(changes, keys)
        if cut:
            return target.overwrite(net.where("not dead").select("row.*"), summary)
        return (target.merge_on_read if self.config.merge_on_read else target.merge)(net, keys, summary)

    def sync(self, changes: DataFrame, fields: dict[tuple[str, str], list[Field]] | None, checkpoint: str, once: bool = False, **options):
        """Start a stream of change rows into the tables; ``once`` takes what is there and stops."""
        trigger = {"availableNow": True} if once else {"processingTime": f"{self.config.flush_interval} seconds"}
        return changes.writeStream.foreachBatch(lambda df, i: self.apply(df, fields, i, **options) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def catch_up(self, changes: DataFrame, fields: dict[tuple[str, str], list[Field]] | None, checkpoint: str, **options) -> None:
        """Merge, batch after batch, what a stream holds now, and stop."""
        query = self.sync(changes, fields, checkpoint, **options)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def stream(self, path: str | None = None) -> DataFrame:
        """The change rows of a message log; a batch ends at the first commit after ``flush_rows`` rows."""
        from .streaming.messages import MessageLog

        self.spark.dataSource.register(MessageLog)
        options = {"slot": self.config.slot_name, "publication": self.config.publication, "flushRows": str(self.config.flush_rows)}
        return self.spark.readStream.format(MessageLog.name()).options(**options).load(path or self.config.source_url)

    def supervise(self, start: Callable[[], object], most: int = 10, first_wait: float = 1.0, longest: float = 60.0) -> None:
        """Restart a failed stream with growing waits; its checkpoint and the snapshots say where to go on."""
        wait = first_wait
        for attempt in range(most + 1):
            try:
                start().awaitTermination()
                return
            except Exception:
                if attempt == most:
                    raise
                time.sleep(wait)
                wait = min(longest, 2 * wait)

    def resync(self, schema: str, name: str, path: str, fields: list[Field], lsn: int) -> int:
        """Replace a table by a bulk text export taken at ``lsn``; changes up to it are later left out."""
        self.cleanup([f"{schema}.{name}"])
        target = self.table(schema, name).create(evolve.initial(fields))
        version = target.append(copytext.read(self.spark, path, [(f.name, f.oid) for f in fields]), {"last-lsn": lsn})
        with self.lock:
            state = self.state()
            state["tables"][f"{schema}.{name}"] = {"path": target.path}
            state["backfill"][f"{schema}.{name}"] = lsn
            self._save_state(state)
        return version

    def cleanup(self, names: list[str], dry_run: bool = False) -> list[str]:
        """Delete tables and their registry entries; the folders, or with ``dry_run`` what would go."""
        gone = []
        for full in names:
            schema, _, table = full.partition(".")
            path = f"{self.root}/{schema}/{table}"
            if self.store.exists(path):
                gone.append(path)
                if not dry_run:
                    self.store.delete(path)
        if not dry_run:
            state = self.state()
            for full in names:
                state["tables"].pop(full, None)
                state["backfill"].pop(full, None)
                state.get("relations", {}).pop(full, None)
            self._save_state(state)
        return gone

    def resume_lsn(self, slot_lsn: int = 0) -> int:
        marks = [self.table(*t).flushed_lsn() for t in self.tables()]
        return max(slot_lsn, min(marks, default=0))
