"""SimHash near-duplicates by multi-index hashing.

Fingerprints of word shingles are linked at a Hamming distance of at most three.  The 64 bits form two
segments of 32.  Two fingerprints within three bits have a segment in which they differ by at most one
bit, so each fingerprint enumerates the Hamming ball of radius one around each of its segments, fetches
what the segment tables hold there and verifies the whole distance.  Of a pair that differs by one bit in
a segment exactly one side has that bit clear, so only clear bits are flipped: half the probes, no loss.

A table slot that holds many fingerprints (one group of near copies) is not joined with itself.  Its
entries are indexed again by the other segment: eight blocks of four bits, of which two fingerprints
within three bits share at least five.  A sub-slot leaves twelve bits free and is fed by 33
neighbouring slots, so it holds at most 135,168 fingerprints whatever the input; it is linked by one task that returns a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import meet
from .common import Scratch, as_bytes, connected_components, per_row

RADIUS = 3
#: Entries of a slot from which it is indexed again.
CROWDED = 64
KEPT_BLOCKS = list(combinations(range(8), 5))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` set each bit."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255
        if whole:  # 255 ones still fit a byte, and byte sums are many times faster
            total += bits[: whole * 255].reshape(whole, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole * 255 :].sum(0, dtype=np.uint8)
    return total


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of ``text``, repeats included; no words: none; fewer words than a shingle: one."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    n = len(words)
    joined = b" ".join(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)] if n else []
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        stops = (ends - 1)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops)]
    return np.array(hashes, dtype=np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` set."""
    if not len(hashes):
        return 0
    return int(np.packbits((2 * bit_counts(hashes) > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text``, repeats included; no words: zero; fewer words than a shingle: one feature."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row; ``fp`` holds the unsigned bits as a signed long."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return per_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), one, "doc_id long, fp long")


def _half(fp, seg: int):
    return F.shiftrightunsigned(fp, 32) if seg == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(scratch: Scratch, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints of ``fps (fp long)`` that keep every connection within ``radius`` <= 3 bits."""
    fp = F.col("fp")
    slots = F.array(*[F.struct(F.lit(s).alias("seg"), _half(fp, s).alias("slot")) for s in (0, 1)])
    entries = fps.select("fp", F.explode(slots).alias("t")).select("fp", "t.seg", "t.slot")
    bits = F.array(*[F.lit(1 << i) for i in range(32)])
    flips = F.transform(F.filter(bits, lambda b: F.col("slot").bitwiseAND(b) == 0), lambda b: F.col("slot").bitwiseOR(b))
    probes = entries.select("fp", "seg", F.explode(F.concat(F.array("slot"), flips)).alias("slot"))
    crowded = scratch.save(entries.groupBy("seg", "slot").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("seg", "slot"))
    e, p = entries.alias("e"), probes.alias("p")
    at = ["seg", "slot"]
    calm_e = entries.join(crowded, at, "left_anti")
    calm = p.join(calm_e.alias("e"), at).where((F.col("p.fp") != F.col("e.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("e.fp"))) <= radius)).select(F.greatest("p.fp", "e.fp").alias("a"), F.least("p.fp", "e.fp").alias("b"))
    if crowded.isEmpty():
        return calm
    # Crowded slots: the other segment's blocks, five of eight at a time.
    other = F.when(F.col("seg") == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    masks = F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(sum(15 << (4 * b) for b in keep)).cast("long").alias("mask")) for i, keep in enumerate(KEPT_BLOCKS)])

    def dense(rows: DataFrame) -> DataFrame:
        return rows.join(crowded, at).select("fp", "seg", "slot", F.explode(masks).alias("m"), other.alias("o")).select("fp", "seg", "slot", "m.combo", F.col("o").bitwiseAND(F.col("m.mask")).alias("part"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["fp"].to_numpy())
        return pd.DataFrame(spanning_forest(values, radius), columns=["a", "b"]).astype("int64")

    inner = dense(p.select("p.*")).groupBy("seg", "slot", "combo", "part").applyInPandas(forest, "a long, b long")
    return calm.unionByName(inner)


def spanning_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join ``values`` (distinct fingerprints) exactly as all pairs within ``radius`` would."""
    bits, left, edges = values.view(np.uint64), np.arange(len(values)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(bits[left] ^ bits[front[0]]) <= radius
            edges += [(int(max(values[front[0]], values[i])), int(min(values[front[0]], values[i]))) for i in left[near]]
            front, left = np.concatenate([front[1:], left[near]]), left[~near]
    return edges


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Class of each document: ``(doc_id, fingerprint, component_id)``, one row per input row.

    Only ``doc_id`` and ``text`` are read, so further columns may have any name.  A null text counts as
    empty; texts without a word all have fingerprint zero and form one class with whatever is near it.
    Repeated rows appear as often as they came.  ``component_id`` is the smallest non-null ``doc_id`` of
    the class.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs))
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    labels = connected_components(scratch, links(scratch, distinct.select("fp")))
    known = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = known.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_fp = known.select("fp", "label").join(classes, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A text of n shingles has n / EXTRA more keys than one shared key asks for: so similar texts share as many more, and others seldom do.
EXTRA = 16
#: Keys that may be missed, since two of a text may be equal in the bits that travel.
MISSED = 2
#: Texts that a task sketches before it sends their keys, and keys of them.
HELD, HELD_KEYS = 50_000, 1_000_000


def _beyond(n: np.ndarray, similar: float) -> np.ndarray:
    """Of ``n`` different shingles of a text those that are no keys; the keys are those with the least hashes."""
    return np.maximum(np.ceil(n * similar - 1e-9) - 1 - n // EXTRA, 0).astype(np.int64)


def _near(size_a: np.ndarray, size_b: np.ndarray, fp_a: np.ndarray, fp_b: np.ndarray, similar: float) -> np.ndarray:
    """Keys that texts of these sizes share at least if they are similar.

    Up to the last key of the one text whose last key is less, all shingles of both are keys; beyond it they can't share more than
    this text has left.
    """
    longer = np.maximum(size_a, size_b)
    common = np.maximum(np.ceil((size_a + size_b) * (similar / (1 + similar)) - 1e-9), np.ceil(longer * similar - 1e-9)).astype(np.int64)
    least = np.maximum(common - np.maximum(_beyond(size_a, similar), _beyond(size_b, similar)) - MISSED, 1)
    return np.where(longer >= meet.LARGEST, 1, least)


def _least(size: Column, similar: float) -> Column:
    """Keys that a text of this size shares at least with any similar one: such has ``similar`` as many shingles or more."""
    shorter = F.ceil(size * similar - 1e-9)
    return F.when(size >= meet.LARGEST, 1).otherwise(F.greatest(F.lit(1), F.floor(shorter / EXTRA) + 1 - MISSED))


def _sketch(text: bytes, shingle: int, similar: float) -> tuple[int, int, np.ndarray]:
    """Number of different shingles, SimHash and keys."""
    found = np.unique(shingle_hashes(text, shingle))
    return len(found), fold(found), found[: len(found) - int(_beyond(np.int64(len(found)), similar))]


def _sketches(texts: list[str], shingle: int, similar: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and SimHashes of the texts, and places and values of their keys."""
    return _keys([_sketch(t.encode(), shingle, similar) for t in texts])


def _keys(sketched: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size, fp = np.array([v[0] for v in sketched]), np.array([v[1] for v in sketched], dtype=np.uint64)
    owner = np.repeat(np.arange(len(sketched)), [len(v[2]) for v in sketched])
    keys = np.concatenate([v[2] for v in sketched]) * np.uint64(0x9E3779B97F4A7C15)  # least hashes are small numbers
    return size, fp, owner, keys ^ keys >> np.uint64(32)


def _confirm(xs: list[str], ys: list[str], shingle: int, similar: float) -> np.ndarray:
    """Whether the sets of shingles of each pair are similar enough."""
    known: dict[str, np.ndarray] = {}
    good = np.zeros(len(xs), dtype=bool)
    for k, pair in enumerate(zip(xs, ys)):
        for t in pair:  # the first text of a key comes many times
            if t not in known:
                known[t] = np.unique(shingle_hashes(t.encode(), shingle))
        x, y = (known[t] for t in pair)
        same = len(np.intersect1d(x, y, assume_unique=True))
        good[k] = same >= (similar - 1e-9) * (len(x) + len(y) - same)
    return good


SKETCHED = "kind int, bucket int, blob binary, doc_id long, text_key long, id long"


def _sketched(source: DataFrame, buckets: int, shingle: int, similar: float, crowded: int) -> DataFrame:
    """All texts (kind 0), and what ``meet`` asks of the different texts that each task holds."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, np.ndarray]] = {}
        n_keys = 0

        def send() -> Iterator[pa.RecordBatch]:
            ids = np.fromiter(held, dtype=np.uint64, count=len(held)).view(np.int64)
            size, _, owner, keys = _keys(list(held.values()))
            for kind, bucket, blob in meet.outgoing(buckets, ids, size, np.zeros(len(ids), np.uint64), owner, keys, similar, partial(_near, similar=similar), crowded):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3))], schema=schema)
            held.clear()

        for batch in batches:
            ids = []
            for text in as_bytes(batch.column(1)):
                ids.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7))
                if ids[-1] not in held:
                    held[ids[-1]] = _sketch(text, shingle, similar)
                    n_keys += len(held[ids[-1]][2])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column(0), batch.column(2), pa.array(np.array(ids, dtype=np.uint64).view(np.int64))], schema=schema)
            if len(held) >= HELD or n_keys >= HELD_KEYS:
                yield from send()
                n_keys = 0
        if held:
            yield from send()

    return source.select("doc_id", "text", "text_key").mapInArrow(run, SKETCHED)


def similar_documents(docs: DataFrame, scratch: Scratch | None = None, shingle: int = 5, similar: float = 0.8, crowded: int = meet.CROWDED) -> DataFrame:
    """Class of each document by the similarity of its set of shingles: ``(doc_id, text_key, component_id, keep)``, one row per input row.

    No link is lost: a text's keys are as many of its least shingle hashes (about a quarter) as show of every pair whether it can be
    similar, and pairs that share as many as similar ones must are verified by the exact Jaccard similarity of their sets.  In crowded
    keys those with the nearest SimHashes come first.  Texts with the same words are one; nulls and ids are treated as by ``near_duplicates``.
    ``keep`` marks the rows of a class with its first (doc_id, text_key); a null doc_id comes after all others here.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packed = scratch.save(_sketched(source, max(1, -(-total // meet.BUCKET_BYTES)), shingle, similar, crowded), by="kind")
    rows = packed.where("kind = 0").select("doc_id", "text_key", "id")
    texts_of = scratch.save(rows.groupBy("id").agg(F.min("text_key").alias("text_key")))

    def of(ids: DataFrame) -> DataFrame:
        return source.select("text_key", "text").join(ids.join(texts_of, "id").hint("shuffle_hash"), "text_key").select("id", "text").dropDuplicates(["id"])

    labels = meet.components(scratch, packed, of, partial(_sketches, shingle=shingle, similar=similar), partial(_confirm, shingle=shingle, similar=similar), similar, partial(_near, similar=similar), crowded, partial(_least, similar=similar))
    known = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "text_key", F.coalesce("label", "id").alias("label"))
    classes = known.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    return known.join(classes, "label").select("doc_id", "text_key", "component_id", F.struct("doc_id", "text_key").eqNullSafe(F.struct("first.doc_id", "first.text_key")).alias("keep"))
