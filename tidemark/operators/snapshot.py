"""Versioned Parquet tables with atomic commits.

Layout: ``<root>/<schema>/<table>/data/<commit>/*.parquet`` and ``metadata/`` with

* ``manifest-*.json``: the files that one commit added, each with its rows and the range of its key columns,
  or the delete files of a merge-on-read commit;
* ``list-*.json``: the manifests of one snapshot;
* ``v<N>.json``: schema and snapshots of a version, a line for each snapshot;
* ``version-hint.text``: the version that readers see.

A commit writes data files, manifest and list, then ``v<N+1>.json`` exclusively, and renames the hint into
place last; a reader sees the old or the new version.  A ``v<N+1>.json`` that the hint never reached was left by
a writer that died: it is replaced by its own writer at once and by others once it is old (``GRACE``).
Everything goes through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as reg
from ..plans import evolve

#: Seconds after which the metadata of a commit that nobody finished is replaced; snapshots that a version remembers; manifests of a snapshot from which they are joined.
GRACE, REMEMBERED, MANIFESTS = 60.0, 200, 64
#: Rows from which a data file is split; 0: a file for each task that writes, whatever its rows.
ROWS_PER_FILE = 5_000_000


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one started from."""


class Store:
    """Small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str | bytes, overwrite: bool) -> None:
        stream = self.fs.create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        finally:
            stream.close()

    def write(self, name: str, text: str | bytes, overwrite: bool) -> None:
        """A new file, or with ``overwrite`` one that replaces the old whole: readers see either."""
        if not overwrite:
            try:
                return self._create(name, text, False)
            except Exception as e:
                if self.exists(name):
                    raise CommitConflict(name) from e
                raise
        fresh = f"{name}.{uuid.uuid4().hex}.tmp"
        self._create(fresh, text, False)
        files = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        options[0] = files.Options.Rename.OVERWRITE
        files.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(fresh), self.path(name), options)

    def list(self, pattern: str) -> list[str]:
        return sorted(x.getPath().toString() for x in self.fs.globStatus(self.path(pattern)) or [])

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, table: str, store: Store | None = None, owner: str | None = None, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.name = spark, (schema, table)
        self.store = store or Store(spark, root)
        self.path = f"{root.rstrip('/')}/{schema}/{table}"
        self.owner = owner or uuid.uuid4().hex
        self.rows_per_file = rows_per_file

    # Metadata.

    @property
    def hint(self) -> str:
        return f"{self.path}/metadata/version-hint.text"

    def exists(self) -> bool:
        return self.store.exists(self.hint)

    def version(self) -> int:
        return int(self.store.read(self.hint).strip())

    def _meta(self, name: str) -> str:
        return f"{self.path}/metadata/{name}"

    def metadata(self, version: int | None = None) -> dict:
        return json.loads(self.store.read(self._meta(f"v{version or self.version()}.json")))

    def schema(self, version: int | None = None) -> T.StructType:
        return evolve.from_json(self.metadata(version)["schema"])

    def keys(self) -> list[str]:
        return [f.name for f in self.schema().fields if f.metadata.get("is_key")]

    def snapshots(self) -> list[dict]:
        return self.metadata()["snapshots"]

    def history(self) -> DataFrame:
        rows = [(s["version"], s["operation"], s["n_files"], s["rows"], s["summary"]) for s in self.snapshots()]
        return self.spark.createDataFrame(rows, "version int, operation string, files int, rows bigint, summary map<string,string>")

    def flushed(self) -> tuple[int, int]:
        """LSN and sequence number of the last change that went in."""
        found = self.snapshots() if self.exists() else []
        facts = found[-1]["summary"] if found else {}
        return int(facts.get("last-lsn", 0)), int(facts.get("last-seq", 1 << 62))

    def flushed_lsn(self) -> int:
        return self.flushed()[0]

    def _publish(self, meta: dict, base: int) -> None:
        meta["version"], meta["owner"] = base + 1, self.owner
        name, text = self._meta(f"v{base + 1}.json"), json.dumps(meta)
        try:
            self.store.write(name, text, overwrite=False)
        except CommitConflict:
            if self.exists() and self.version() > base:
                raise
            orphan = json.loads(self.store.read(name) or "{}")
            if orphan.get("owner") != self.owner and self.store.age(name) < GRACE:
                raise
            self.store.write(name, text, overwrite=True)
        self.store.write(self.hint, str(base + 1), overwrite=True)
        if self.metadata(base + 1).get("owner") != self.owner:
            raise CommitConflict(name)  # this writer was so slow that another took it for dead

    def create(self, schema: T.StructType) -> SnapshotTable:
        if any(evolve.FIELD_ID not in f.metadata for f in schema.fields):
            schema = T.StructType([T.StructField(f.name, f.dataType, True, {**f.metadata, evolve.FIELD_ID: i}) for i, f in enumerate(schema.fields, 1)])
        last = max((f.metadata[evolve.FIELD_ID] for f in schema.fields), default=0)
        self._publish({"schema": evolve.to_json(schema), "last_id": last, "snapshots": []}, 0)
        return self

    # Manifests.

    def _snapshot(self, version: int | None) -> dict | None:
        found = [s for s in self.metadata(version)["snapshots"] if version is None or s["version"] <= version]
        return found[-1] if found else None

    def _listed(self, snapshot: dict | None) -> list[dict]:
        return json.loads(self.store.read(self._meta(snapshot["list"])))["manifests"] if snapshot else []

    def entries(self, version: int | None = None, kind: str = "data") -> list[dict]:
        """The data or delete files of a version: ``path, commit`` and for data files the range of their keys."""
        return [f for m in self._listed(self._snapshot(version)) if m["kind"] == kind for f in json.loads(self.store.read(self._meta(m["path"])))["files"]]

    def files(self, version: int | None = None) -> list[str]:
        return [f["path"] for f in self.entries(version)]

    def _manifest(self, kind: str, files: list[dict], rows: int) -> dict:
        name = f"manifest-{uuid.uuid4().hex}.json"
        self.store.write(self._meta(name), json.dumps({"files": files}), overwrite=False)
        return {"kind": kind, "path": name, "files": len(files), "rows": rows}

    # Reading.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version under that version's schema, by field ID: renamed, widened and added columns read as it has them."""
        return self._read(self.entries(version), self.entries(version, "delete"), version)

    def _read(self, files: list[dict], deletes: list[dict], version: int | None = None) -> DataFrame:
        schema = self.schema(version)
        if not files:
            return self.spark.createDataFrame([], schema)
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        plain = T.StructType([T.StructField(f.name, f.dataType, True, {evolve.FIELD_ID: f.metadata[evolve.FIELD_ID]}) for f in schema.fields])
        late = [f for f in schema.fields if evolve.DEFAULT in f.metadata]
        # A default is the value of rows written before the column came, and a delete concerns rows written before it: both depend on the commit of a file.
        since, cuts = self.metadata(version).get("added", {}), sorted({d["commit"] for d in deletes})
        parts: dict[tuple, list[str]] = {}
        for f in files:
            filled = tuple(c.name for c in late if f["commit"] < since.get(c.name, 0))
            parts.setdefault((filled, sum(c <= f["commit"] for c in cuts)), []).append(f"{self.path}/data/{f['path']}")
        out = None
        for (names, done), paths in parts.items():
            df = self.spark.read.schema(plain).parquet(*paths)
            for c in late:
                if c.name in names:
                    df = df.withColumn(c.name, reg.parse(F.lit(c.metadata[evolve.DEFAULT]), c.metadata.get("oid", reg.TEXT)).cast(c.dataType))
            if done < len(cuts):
                from ..plans.merge import anti_join

                keys = deletes[0]["keys"]
                later = [f"{self.path}/data/{d['path']}" for d in deletes if d["commit"] in cuts[done:]]
                gone = self.spark.read.schema(T.StructType([plain[k] for k in keys])).parquet(*later)
                df = anti_join(df, gone, keys)
            out = df if out is None else out.unionByName(df)
        return out

    # Writing.

    def _write(self, df: DataFrame, base: int, keys: list[str]) -> tuple[list[dict], int]:
        schema = self.schema()
        self.spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
        meta = lambda f: {evolve.FIELD_ID: f.metadata[evolve.FIELD_ID]}
        shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=meta(f)) for f in schema.fields if f.name in df.columns])
        folder = f"{base + 1}-{uuid.uuid4().hex}"
        shaped.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.path}/data/{folder}")
        names = [x.rsplit("/", 1)[1] for x in self.store.list(f"{self.path}/data/{folder}/*.parquet")]
        if not names:
            return [], 0
        # Rows and the range of the first key by file, from that column alone; a row for each file comes back.
        k = F.col(keys[0]) if keys else F.lit(None)
        written = self.spark.read.schema(shaped.schema).parquet(f"{self.path}/data/{folder}")
        facts = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(k).cast("string").alias("low"), F.max(k).cast("string").alias("high"), F.count(F.when(k.isNull(), 1)).alias("nulls")).collect()
        by = {r["file"].rsplit("/", 1)[1]: r for r in facts}
        files = []
        for x, r in sorted(by.items()):  # files without a row have none here, and are left out
            files.append({"path": f"{folder}/{x}", "commit": base + 1, "rows": r["n"]})
            if keys:
                files[-1] |= {"key": keys[0], "low": r["low"], "high": r["high"], "nulls": r["nulls"]}
        return files, sum(f["rows"] for f in files)

    def commit(self, df: DataFrame | None, operation: str, summary: dict | None = None, base: int | None = None, replaced: list[dict] | None = None, deletes: tuple[DataFrame, list[str]] | None = None) -> int:
        """A new snapshot with the rows of ``df``, if any.

        ``append`` carries the present files forward; ``overwrite`` does not, or with ``replaced`` all but these;
        ``deletes`` (keys, column names) go out as a delete file that concerns all earlier files.
        """
        base = self.version() if base is None else base
        meta = self.metadata(base)
        keys = self.keys()
        old = meta["snapshots"][-1] if meta["snapshots"] else None
        kept = self._listed(old) if operation != "overwrite" or replaced is not None else []
        if replaced:
            gone = {f["path"] for f in replaced}
            left = [f for m in kept if m["kind"] == "data" for f in json.loads(self.store.read(self._meta(m["path"])))["files"] if f["path"] not in gone]
            kept = [m for m in kept if m["kind"] != "data"] + ([self._manifest("data", left, sum(f["rows"] for f in left))] if left else [])
        new, rows = self._write(df, base, keys) if df is not None else ([], 0)
        kept += [self._manifest("data", new, rows)] if new else []
        if deletes is not None:
            marks, _ = self._write(deletes[0].select(*deletes[1]).distinct(), base, [])
            kept += [self._manifest("delete", [{**m, "keys": deletes[1]} for m in marks], 0)] if marks else []
        if len(kept) > MANIFESTS:
            files = {k: [f for m in kept if m["kind"] == k for f in json.loads(self.store.read(self._meta(m["path"])))["files"]] for k in ("data", "delete")}
            kept = [self._manifest(k, files[k], sum(m["rows"] for m in kept if m["kind"] == k)) for k in files if files[k]]
        listed = f"list-{base + 1}-{uuid.uuid4().hex}.json"
        self.store.write(self._meta(listed), json.dumps({"manifests": kept}), overwrite=False)
        total = sum(m["rows"] for m in kept if m["kind"] == "data")  # with delete files, what they leave out included
        facts = {"operation": operation, "added-data-files": str(len(new)), "added-records": str(rows), "total-records": str(total), **{k: str(v) for k, v in (summary or {}).items()}}
        entry = {"version": base + 1, "operation": operation, "list": listed, "n_files": sum(m["files"] for m in kept if m["kind"] == "data"), "rows": total, "summary": facts, "at": int(time.time() * 1000)}
        meta["snapshots"] = [*meta["snapshots"], entry][-REMEMBERED:]
        self._publish(meta, base)
        return base + 1

    def append(self, df: DataFrame, summary: dict | None = None) -> int:
        return self.commit(df, "append", summary)

    def overwrite(self, df: DataFrame, summary: dict | None = None) -> int:
        return self.commit(df, "overwrite", summary)

    def truncate(self, lsn: int) -> int:
        return self.commit(None, "overwrite", {"last-lsn": lsn, "truncated": "true"})

    def touched(self, changed: DataFrame, keys: list[str]) -> list[dict]:
        """The data files that hold one of the keys of ``changed``: by the range of the first key, then by the keys themselves.

        Only key columns are read, of the files whose range meets that of the changes; a file name each comes back.
        """
        present = self.entries()
        k = F.col(keys[0])
        span = changed.agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count(F.when(k.isNull(), 1)).alias("nulls")).first()
        kind = self.schema()[keys[0]].dataType
        number = isinstance(kind, (T.IntegerType, T.LongType))

        def meets(f: dict) -> bool:
            if f.get("key") != keys[0] or not number or (span["nulls"] and f["nulls"]):
                return True
            return f["low"] is not None and span["low"] is not None and int(f["low"]) <= span["high"] and int(f["high"]) >= span["low"]

        near = [f for f in present if meets(f)]
        if not near:
            return []
        from ..plans.merge import same_key

        paths = {f"{self.path}/data/{f['path']}".rsplit("/data/", 1)[1]: f for f in near}
        plain = T.StructType([T.StructField(f.name, f.dataType, True, {evolve.FIELD_ID: f.metadata[evolve.FIELD_ID]}) for f in self.schema().fields if f.name in keys])
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        rows = self.spark.read.schema(plain).parquet(*[f"{self.path}/data/{p}" for p in paths]).select(*keys, F.col("_metadata.file_path").alias("_file"))
        hit = rows.alias("l").join(changed.select(*keys).alias("r"), same_key("l", "r", keys), "left_semi").select("_file").distinct().collect()
        return [paths[r["_file"].rsplit("/data/", 1)[1]] for r in hit]

    def merge(self, net: DataFrame, keys: list[str], summary: dict | None = None) -> int:
        """Copy-on-write of the files that ``net`` (keys, ``dead``, ``row``) touches; all others are carried forward."""
        from ..plans.merge import apply_changes

        net = net.persist()
        try:
            deletes = self.entries(kind="delete")
            hit = self.touched(net, keys) if not deletes else self.entries()
            rows = apply_changes(self._read(hit, deletes), net, keys)
            return self.commit(rows, "overwrite", summary, replaced=hit if not deletes else None)
        finally:
            net.unpersist()

    def merge_on_read(self, net: DataFrame, keys: list[str], summary: dict | None = None) -> int:
        """Writes the living rows and the keys of all changed ones; readers leave out earlier rows of those keys."""
        return self.commit(net.where(~F.col("dead")).select("row.*"), "delta", summary, deletes=(net, keys))

    def compact(self, summary: dict | None = None) -> int:
        """The same rows without delete files."""
        last = self.snapshots()[-1]["summary"] if self.snapshots() else {}
        return self.overwrite(self.read(), {**{k: v for k, v in last.items() if k.startswith("last-")}, **(summary or {})})

    def evolve(self, changes: list[evolve.Change], defaults: dict[str, str] | None = None) -> T.StructType:
        base = self.version()
        meta = self.metadata(base)
        schema, meta["last_id"] = evolve.evolve(evolve.from_json(meta["schema"]), changes, meta["last_id"], defaults)
        meta["schema"] = evolve.to_json(schema)
        meta.setdefault("added", {}).update({c.name: base + 1 for c in changes if c.kind == "ADD"})
        self._publish(meta, base)
        return schema

    def delete_keys(self, deletes: DataFrame, keys: list[str], summary: dict | None = None) -> int:
        from ..plans.merge import anti_join

        return self.overwrite(anti_join(self.read(), deletes, keys), summary)

    def expire(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` snapshots and delete what none of these uses; the number of data folders that went."""
        base = self.version()
        meta = self.metadata(base)
        meta["snapshots"] = meta["snapshots"][-keep:]
        lists = {s["list"] for s in meta["snapshots"]}
        manifests = {m["path"] for s in meta["snapshots"] for m in self._listed(s)}
        used = {f["path"].split("/", 1)[0] for m in manifests for f in json.loads(self.store.read(self._meta(m)))["files"]}
        self._publish(meta, base)
        for p in self.store.list(f"{self.path}/metadata/list-*") + self.store.list(f"{self.path}/metadata/manifest-*"):
            if p.rsplit("/", 1)[1] not in lists | manifests:
                self.store.delete(p)
        gone = [p for p in self.store.list(f"{self.path}/data/*") if p.rsplit("/", 1)[1] not in used]
        for p in gone:
            self.store.delete(p)
        return len(gone)
