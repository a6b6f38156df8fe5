"""Sharding by a k-d tree; DataFrame functions only.

Every node splits at the weighted median (bytes) of the metadata dimension in which it is widest, relative
to the whole table, until leaves reach the target.  Medians are found for all nodes of a level at once: one
job sums the bytes per node and bin, the driver sees those sums (at most ``MOST_BINS`` rows), narrows each node
to the bin that holds its median and repeats.

The dimensions are metadata of the text (bytes, words, lines, letters beyond ASCII), and rows with equal ones
are ordered by the hash of the text, so equal texts always lie on one side of a cut, whatever their source.  Only
a group of equal texts that is heavier than a whole leaf should be is cut, by doc_id: no other cut is near equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MOST_BINS = 65_536
#: A cut is close enough when what lies in its bin is at most this share of a leaf's bytes.
TOLERANCE = 0.0005
#: Rows that one task numbers, about.
CHUNK = 200_000
LIMIT = 1 << 62


def metadata(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc_id, size, text_crc32, k1 (text), k2 (doc_id)`` and the coordinates ``d0...``; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_bytes, n_points = F.octet_length(text).cast("long"), F.length(text).cast("long")
    spaces, ends = F.length(F.translate(text, " ", "")), F.length(F.translate(text, "\n", ""))
    # Each per mille of the text's length or its logarithm, so that a few very long texts don't make a dimension wide.
    dims = [
        F.floor(F.log2(n_bytes + 1) * 1000).cast("long"),
        F.floor(1000 * (n_points - spaces) / F.greatest(n_points, F.lit(1))).cast("long"),
        F.floor(F.log2(n_points - ends + 1) * 1000).cast("long"),
        F.floor(1000 * (n_bytes - n_points) / F.greatest(n_bytes, F.lit(1))).cast("long"),
    ]
    names = [f"d{i}" for i in range(len(dims))]
    doc = F.col("doc_id").cast("long")
    out = docs.select(
        doc.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("k1"), F.shiftrightunsigned(F.xxhash64(F.coalesce(doc, F.lit(0)), F.lit("doc")), 2).alias("k2"),
        *[d.alias(n) for d, n in zip(dims, names)],
    )
    return out, names


@dataclass
class Node:
    leaves: int
    bytes: int
    dim: str
    #: Bytes that go left, counted from the start of the present range.
    want: int
    stage: int = 0  # 0: coordinate, 1: text, 2: doc_id
    low: int = 0
    width: int = 1
    span: int = 1
    cut: list[int] = field(default_factory=lambda: [0, 0, 0])
    settled: bool = False

    def narrow(self, bins: dict[int, int]) -> None:
        """Take the bin that holds the wanted byte; stop at the nearer edge once it is light enough."""
        before = 0
        for b in sorted(bins):
            if before + bins[b] >= self.want:
                break
            before += bins[b]
        else:
            b = max(bins, default=0)
            before -= bins.get(b, 0)
        weight, inside, share = bins.get(b, 0), self.want - before, self.bytes / self.leaves
        one_text = self.stage == 1 and self.width == 1 and weight <= share
        if weight <= share * TOLERANCE or one_text or (self.stage == 2 and self.width == 1):
            self.cut[self.stage] = self.low + self.width * (b + (2 * inside >= weight))
            self.settled = True
        elif self.width > 1:
            self.low, self.span, self.want = self.low + self.width * b, self.width, inside
        else:
            self.cut[self.stage] = self.low + b
            self.stage, self.low, self.span, self.want = self.stage + 1, 0, LIMIT, inside


def _before(cut: list[str], keys: list[Column]) -> Column:
    a, b, c = keys
    return (a < F.col(cut[0])) | ((a == F.col(cut[0])) & ((b < F.col(cut[1])) | ((b == F.col(cut[1])) & (c < F.col(cut[2])))))


def _coordinate(dims: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for d in dims:
        out = F.when(F.col("dim") == d, F.col(d)).otherwise(out)
    return out


def tree(meta: DataFrame, dims: list[str], leaves: int, scratch: Scratch) -> DataFrame:
    """``meta`` with its ``leaf``, 0 to ``leaves - 1``."""
    spark = meta.sparkSession
    ranges = [f for d in dims for f in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
    whole = meta.agg(F.sum("size").alias("bytes"), *ranges).first()
    now = meta.withColumn("leaf", F.lit(0))
    if whole["bytes"] is None:
        return now
    count = {0: leaves}
    while any(n > 1 for n in count.values()):
        facts = {r["leaf"]: r for r in now.groupBy("leaf").agg(F.sum("size").alias("bytes"), *ranges).collect()}  # a row per node
        nodes: dict[int, Node] = {}
        for leaf, n in count.items():
            if n > 1 and (r := facts.get(leaf)):
                wide = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]))
                nodes[leaf] = Node(n, r["bytes"], wide, r["bytes"] * (n // 2) // n, low=r[f"lo_{wide}"], span=r[f"hi_{wide}"] - r[f"lo_{wide}"] + 1)
        bins = max(2, min(4096, MOST_BINS // max(1, len(nodes))))
        schema = "leaf int, dim string, stage int, low long, width long, c0 long, c1 long"
        while open_nodes := {k: v for k, v in nodes.items() if not v.settled}:
            for v in open_nodes.values():
                v.width = -(-v.span // bins)
            asked = F.broadcast(spark.createDataFrame([(k, v.dim, v.stage, v.low, v.width, v.cut[0], v.cut[1]) for k, v in open_nodes.items()], schema))  # a row per node
            c = _coordinate(dims)
            key = F.when(F.col("stage") == 0, c).when(F.col("stage") == 1, F.col("k1")).otherwise(F.col("k2"))
            here = ((F.col("stage") == 0) | (c == F.col("c0"))) & ((F.col("stage") < 2) | (F.col("k1") == F.col("c1")))
            inside = here & (key >= F.col("low")) & (key - F.col("low") < F.col("width") * bins)
            got = now.join(asked, "leaf").where(inside).withColumn("at", key - F.col("low")).withColumn("bin", F.expr("at div width")).groupBy("leaf", "bin").agg(F.sum("size").alias("bytes"))
            found: dict[int, dict[int, int]] = {k: {} for k in open_nodes}
            for r in got.collect():
                found[r["leaf"]][r["bin"]] = r["bytes"]
            for k, v in open_nodes.items():
                v.narrow(found[k])
        after, rows = {}, []
        base = 0
        for leaf in sorted(count):
            n = count[leaf]
            if n > 1 and leaf in nodes:
                v = nodes[leaf]
                after[base], after[base + n // 2] = n // 2, n - n // 2
                rows.append((leaf, base, base + n // 2, v.dim, *v.cut))
            else:
                after[base] = n if n == 1 else 1
                rows.append((leaf, base, base, dims[0], 0, 0, 0))
            base += n
        moves = F.broadcast(spark.createDataFrame(rows, "leaf int, lo int, hi int, dim string, c0 long, c1 long, c2 long"))  # a row per node
        left = _before(["c0", "c1", "c2"], [_coordinate(dims), F.col("k1"), F.col("k2")])
        moved = now.join(moves, "leaf").withColumn("leaf", F.when(left, F.col("lo")).otherwise(F.col("hi"))).drop("lo", "hi", "dim", "c0", "c1", "c2")
        now, count = scratch.save(moved), after
    return now


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``slot``: gapless from 0 in each leaf, counted in chunks of bounded size.

    Rows are dealt into chunks at random, so neither repeated rows nor null ids make one large; the table that is written fixes them.
    """
    chunks = max(1, -(-rows.count() // CHUNK))
    dealt = scratch.save(rows.withColumn("chunk", F.floor(F.rand(7) * chunks).cast("long")))
    sizes = dealt.groupBy("leaf", "chunk").agg(F.count("*").alias("n"))  # leaves x chunks rows
    first = sizes.select("leaf", "chunk", (F.sum("n").over(Window.partitionBy("leaf").orderBy("chunk")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("leaf", "chunk").orderBy("k2", "k1", "text_crc32"))
    return dealt.withColumn("rank", rank).join(first, ["leaf", "chunk"]).withColumn("slot", F.col("first") + F.col("rank") - 1)


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The number of leaves is ``shards``, or what ``target_bytes`` a leaf comes to.  The law is near equal
    bytes.  Null texts count one byte and equal the empty ones, a null doc_id is as any other; repeated rows are
    all dealt out.  Equal texts share a shard unless their group is heavier than a shard.  A text is
    never cut, however long.  Columns other than doc_id and text are not read.  An empty table stays empty.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    meta, dims = metadata(docs)
    meta = scratch.save(meta)
    if shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 1
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    placed = numbered(tree(meta, dims, shards, scratch), scratch)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("leaf").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents, a folder per shard.  ``doc_id`` must be unique here."""
    where = placed.select(F.col("doc_id").alias("_doc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    docs.join(where, docs["doc_id"] == where["_doc"]).drop("_doc").repartitionByRange("_shard", "_slot").write.partitionBy("_shard").parquet(path)
