"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.  The helpers cover three needs: reading a column under a
defined null rule, cutting lineage through the cluster's shared folder, and connected components that
never leave the executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to a Python worker at a time; texts are long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows of a small table that go into one file.
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting (a test on one machine) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of what goes to a Python worker at a time; Spark reads them when a query runs, so they stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        number = int(now) if now and now.lstrip("-").isdigit() else -1
        if number <= 0 or number > most:
            spark.conf.set(name, str(most))


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # keeps the frames, so no id is used again
        bound_batches(spark)

    def save(self, df: DataFrame, by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it again: later stages, and retries after a lost executor, start from the files.

        With ``by``, an int column of few values, its values are folders, and a filter on it reads only theirs.
        ``rows``, the number of rows or more, keeps a small table from as many files as a shuffle has partitions.
        """
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path, partitionBy=by)
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files that nothing refers to any more
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            if path := self.paths.pop(id(frame), (None, None))[1]:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop_parts(self, frame: DataFrame, by: str, *values: int) -> None:
        """Remove the rows with these values of the column that ``frame`` was saved by; filters on other values still read it."""
        jvm = self.spark.sparkContext._jvm
        for value in values:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.paths[id(frame)][1]}/{by}={value}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value; ``unpack`` is told their types."""
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, dtype="<i8", count=len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * kind.itemsize
    return out


def per_row(df: DataFrame, fn: Callable[[list], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch's columns as Arrow arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def as_bytes(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def as_texts(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


#: Edges that one task joins.
LOCAL_EDGES = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and for each the smallest node it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)  # roots take the smaller root
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def connected_components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """Label each node of ``edges (a long, b long)`` with the smallest node it reaches: ``(node, label)``.

    Edges are dealt to tasks, each of which joins at most about ``local`` and passes on a star for each of
    its components.  Where one task is enough, that is the result.  Beyond, rounds of the large-star and small-star
    steps follow, whose edge count never grows and which need about log(n) rounds whatever the shape of the graph.
    Each round is one table in the shared folder; the driver sees a count and a checksum only.  Nodes without
    an edge do not appear.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            a, b = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1))
            nodes, labels = joined(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["a", "b"])

    tasks = max(1, -(-now.count() // local))
    contracted = scratch.save(now.repartition(tasks).mapInArrow(stars, "a long, b long"))
    scratch.drop(now)
    if tasks == 1:
        return contracted.select(F.col("a").alias("node"), F.col("b").alias("label"))
    now, mark = contracted.where("a <> b"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        following = scratch.save(small)
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = following
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
