"""Benchmark decontamination with SimHash item-sized windows; DataFrame functions only.

An item of m shingles (five words each, lower case, white space as separator) is compared with every window
of m shingles of every document.  Windows are found where the document holds shingles of the item: a window
as similar as asked must hold at least ``2t / (1 + t) * m`` of the item's, so some hit lies within its
first ``m - that`` places, and no other window is built; a window meets only the items that opened it.  A document shorter than the item is one window as
a whole; with w shingles it must hold ``t / (1 + t) * (m + w)`` of the item's.  Window and item fingerprints (64 bits, every
shingle weighing as often as it occurs) meet by multi-index Hamming blocks: with ``radius + 1`` blocks two
fingerprints within ``radius`` agree on one at least, so none is lost.  Candidates are verified by the exact
weighted Jaccard similarity, the sum of the smaller over the sum of the larger multiplicities.

At the default similarity of 0.8 two fingerprints differ by about 10 bits with a standard deviation of 3, those of
five shingles and fewer by more.  A window further from its item than ``radius`` meets the item without blocks and is verified
like the others, so every window of the similarity is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 20
#: Most rows of a benchmark table, or of places in documents, that are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the word n-grams; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)]))
        return F.when(F.size(w) >= n, long).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # The one-element array binds the words: as a column they would be inlined, and split again for every shingle.
    return F.transform(F.array(words(text)), of)[0]


def lane_sums(h: Column) -> list[Column]:
    """Thirty-two sums; each holds the counts of two bits in lanes of 32 bits, so windows of any size fit."""
    out = []
    for k in range(32):
        pair = F.shiftrightunsigned(h, 2 * k).bitwiseAND(F.lit(3))
        out.append(F.sum(pair.bitwiseOR(F.shiftleft(pair, 31)).bitwiseAND(F.lit(LANES))).alias(f"c{k}"))
    return out


def fingerprint(m: Column) -> Column:
    """The bits that more than half of ``m`` shingles set, from the sums ``c0`` to ``c31``."""
    out = F.lit(0).cast("long")
    for k in range(32):
        for j in range(2):
            on = F.shiftrightunsigned(F.col(f"c{k}"), 32 * j).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > m
            out = out.bitwiseOR(F.when(on, F.shiftleft(F.lit(1).cast("long"), 2 * k + j)).otherwise(F.lit(0).cast("long")))
    return out


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of ``radius + 1`` blocks over 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_array(fp: Column, radius: int) -> Column:
    return F.array(*[F.lit(i << 32).cast("long") + F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for i, (at, width) in enumerate(blocks(radius))])


def shared(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller multiplicity; where ``b`` repeats none, the number of common shingles."""
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(F.size(F.array_distinct(b)) == F.size(b), F.size(F.array_intersect(a, b))).otherwise(counted)


def matches(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, text_key (hash of the text), item_id, start_word, n_shingles, distance, similarity`` of each matching window.

    Whole texts and items of any length are compared.  Null and empty texts hold no window; items of under ``shingle`` words are one shingle and match only a
    document that is as short.  ``n_shingles`` is the size of the window, less than the item's where the document is shorter.  Repeated rows of either table count once; ids may be shared by different
    texts; null ids are kept.  Further columns are not read.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().select("item_id", shingles(F.col("text"), shingle).alias("shingles")).withColumn("m", F.size("shingles")).where("m > 0")
    n_items = benchmark.count()
    items = scratch.save(items.withColumn("item", F.monotonically_increasing_id()), rows=n_items)
    n_rows = items.agg(F.sum("m")).first()[0] or 0
    item_rows = scratch.save(items.select("item", "m", F.explode("shingles").alias("h")), rows=n_rows)
    item_fp = scratch.save(item_rows.groupBy("item", "m").agg(*lane_sums(F.col("h"))).select("item", "m", fingerprint(F.col("m")).alias("item_fp")), rows=n_items)
    small = n_rows * (radius + 1) <= BROADCAST_ROWS

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    hashed = keyed.select("doc_id", "text_key", shingles(F.col("text"), shingle).alias("s"))
    hits = hashed.select("doc_id", "text_key", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h")).join(few(item_rows.select("h").distinct()), "h").distinct()
    hits = scratch.save(hits)
    # Of every item the shingle occurrences that a similar window needs; one item's hits may repeat in a document.
    span = F.least("n", "m")
    need = F.ceil((F.col("m") + span) * F.lit(similar / (1 + similar)) - F.lit(1e-9)).cast("int")
    placed = hits.join(few(item_rows.select("item", "m", "h").distinct()), "h").where(F.col("n") >= F.col("m") * similar - 1e-9)
    enough = placed.groupBy("doc_id", "text_key", "n", "item", "m").agg(F.collect_set("pos").alias("at")).where(F.size("at") >= need)
    reach = F.col("w") - F.col("need")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - reach), F.least(F.col("pos"), F.col("n") - F.col("w")))
    opened = enough.select("doc_id", "text_key", "n", "item", "m", span.alias("w"), need.alias("need"), F.explode("at").alias("pos")).where(F.col("pos") - reach <= F.col("n") - F.col("w"))
    # A window keeps the items whose shingles opened it, and meets only these.
    named = opened.select("doc_id", "text_key", "w", "item", "m", F.explode(starts).alias("start")).distinct()
    named = scratch.save(named.withColumn("window_id", F.xxhash64("doc_id", "text_key", "w", "start")))
    windows = named.select("window_id", "doc_id", "text_key", "w", "start").distinct()
    holders = scratch.save(named.select("doc_id", "text_key").distinct(), rows=hits.count())
    holders = F.broadcast(holders) if holders.count() <= BROADCAST_ROWS else holders  # two numbers a row
    again = keyed.alias("d").join(holders.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("d.text_key").eqNullSafe(F.col("h.text_key")), "left_semi")
    texts = scratch.save(again.select("doc_id", "text_key", shingles(F.col("text"), shingle).alias("s")).dropDuplicates(["doc_id", "text_key"]))
    cut = windows.alias("w").join(texts.alias("t"), F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.text_key") == F.col("t.text_key"))).select("w.window_id", "w.w", F.slice("t.s", F.col("w.start") + 1, F.col("w.w")).alias("window"))
    summed = cut.select("window_id", "w", F.explode("window").alias("h")).groupBy("window_id", "w").agg(*lane_sums(F.col("h")))
    marked = scratch.save(summed.select("window_id", fingerprint(F.col("w")).alias("fp")))
    left = named.join(marked, "window_id").select("*", F.explode(block_array(F.col("fp"), radius)).alias("block"))
    right = item_fp.select("item", "item_fp", F.explode(block_array(F.col("item_fp"), radius)).alias("block"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    named_so = ["doc_id", "text_key", "w", "m", "start", "item", "distance"]
    close = left.join(few(right), ["item", "block"]).withColumn("distance", apart).where(F.col("distance") <= radius).select(*named_so).distinct()
    # Short windows may be similar and further apart: they are verified all the same.
    far = named.join(marked, "window_id").join(few(item_fp.select("item", "item_fp")), "item").withColumn("distance", apart).where(F.col("distance") > radius).select(*named_so)
    candidates = scratch.save(close.unionByName(far))
    full = candidates.alias("c").join(texts.alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.text_key") == F.col("t.text_key"))).join(few(items).alias("i"), F.col("c.item") == F.col("i.item"))
    both = full.select("c.doc_id", "c.text_key", "i.item_id", "c.start", "c.w", "c.m", "c.distance", F.slice("t.s", F.col("c.start") + 1, F.col("c.w")).alias("window"), "i.shingles")
    same = shared(F.col("window"), F.col("shingles"))
    return both.withColumn("same", same).withColumn("similarity", F.col("same") / (F.col("w") + F.col("m") - F.col("same"))).where(F.col("similarity") >= similar - 1e-9).select("doc_id", "text_key", "item_id", F.col("start").alias("start_word"), F.col("w").alias("n_shingles"), "distance", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, n_windows, distance, similarity`` of the best window of each document and item.

    Of equally similar windows all are counted.  Documents of one doc_id, and items of one item_id, are told as one;
    null ids are ids of their own.  An empty table gives an empty table.
    """
    best = matches(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.max(F.struct("similarity", -F.col("distance"))).alias("b"), F.min("distance").alias("distance"))
    return best.select("doc_id", "item_id", "n_windows", "distance", F.round("b.similarity", 9).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a matching window, with all their columns, whatever their names.

    Rows are told apart by doc_id and text, a null doc_id being as any other.  Null and empty texts stay, and repeated rows stay repeated.
    An empty table stays empty.
    """
    found = matches(docs, benchmark, **options).select(F.col("doc_id").alias("_found"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_found"]) & (F.xxhash64(docs["text"].cast("string")) == found["_key"])
    return docs.join(found, same, "left_anti")
