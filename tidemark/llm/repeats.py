"""Removal of long repeated byte strings by prefix-free parsing.

Every byte covered by a string of ``MATCH`` bytes that also starts earlier in the corpus goes; the first
occurrence stays.  Order: doc_id, then text hash, then position.

1. *Parse.*  A rolling hash over ``GRAM`` bytes triggers phrases: the trigger of a string of ``MATCH`` bytes
   is its leftmost gram of least hash, so equal strings have the same trigger at the same place.  The starts
   that share a trigger, and the bytes they reach, are one phrase; every start lies in exactly one phrase.
2. *Dictionary.*  Phrases are grouped by trigger and content.  A phrase whose trigger occurs nowhere else
   holds no repeated string.  Every later occurrence of an equal phrase is repeated as a whole.  Each task
   combines its own phrases first, so frequent ones are shuffled once per task.
3. *Suffix order.*  Only dictionary entries that share a trigger but differ can still share strings.  Their
   suffix array is built by prefix doubling (to ``MATCH`` bytes, all that the question needs); in each run of
   equal suffixes all but the first in corpus order are repeated.
4. The starts found in 2 and 3 are united per document.

Between tasks phrases travel as packed arrays, one row for each task and bucket; the number of buckets
grows with the bytes of the corpus.  A trigger with very many different entries would outgrow its bucket: its
entries go past it (a task that sees ``HOT`` of them sends them on by document and tells the bucket), and their
suffixes are dealt out by the hash of their own ``MATCH`` bytes instead of by trigger, so they spread evenly.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pack, unpack

MATCH, GRAM = 100, 40
BUCKET_BYTES = 16 << 20
#: Bytes that are parsed at a time, and phrases that a task combines at a time.
SEGMENT, COMBINED = 1 << 19, 200_000
#: Suffixes are dealt into this many times as many buckets as phrases; entries that a task holds before it sends them.
FINER, HELD = 2, 20_000
#: Different entries of one trigger, in a task or a bucket, from which their suffixes are dealt out by their own hashes.
HOT = 500
LOW = np.uint64((1 << 24) - 1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
U64, U32, I64 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8")


@functools.cache
def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    n = SEGMENT + MATCH + 1
    out = []
    for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def parse(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the documents at ``starts`` in ``data``: document, first start, further starts, trigger and content hash."""
    n = len(data)
    long = sizes >= MATCH
    if n < MATCH or not long.any():
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, U64, U64))
    values = data.astype(U64) + np.uint64(1)
    up, down = powers(0)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[:n], dtype=U64)])
    grams = n - GRAM + 1
    h = mix((total[GRAM:] - total[:grams]) * down[:grams])
    ranked = (h & ~LOW) | np.arange(grams, dtype=U64)
    span, m = MATCH - GRAM + 1, n - MATCH + 1
    padded = np.full(-(-grams // span) * span, np.iinfo(np.uint64).max, dtype=U64)
    padded[:grams] = ranked
    rows = padded.reshape(-1, span)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    trigger = (np.minimum(tail[:m], head[span - 1 : span - 1 + m]) & LOW).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[starts[long]] += 1
    edge[starts[long] + sizes[long] - MATCH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:m]))
    t = trigger[at]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    t = t[new]
    up, down = powers(1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[:n], dtype=U64)])
    content = (total[last + MATCH] - total[first]) * down[first]
    content = mix(content ^ mix(((t - first) << 8 | (last - first)).astype(U64)))
    # The hashes of triggers are least ones, so small: mixed again they spread evenly over buckets.
    return np.searchsorted(starts, first, "right") - 1, first, last - first, mix(h[t] + ODD), content


PHRASES = (I64, I64, U64, U64, U32, U32, U32)  # documents: id, key; phrases: trigger, content, document, start, further
STARTS = (I64, I64, U32, U32, U32)  # documents: id, key; document, start, further
OPENED = (*STARTS, U64)  # and trigger
SPELLED = (I64, I64, U32, U32, U64)  # documents: id, key; document, start, hash of the bytes there
#: What a row of the parse holds: phrases for a trigger's bucket, starts that are repeated, entries of hot triggers, hot triggers.
NEW, GONE, PAST, TOLD = range(4)


def bucket_of(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def firsts(trigger: np.ndarray, content: np.ndarray, place: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over phrases in ``order`` (by trigger, content, place): which begin a run of equal ones, and which lie later than its first."""
    k, c, p = trigger[order], content[order], place[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    return head, p != p[np.flatnonzero(head)[np.cumsum(head) - 1]]


class Combiner:
    """What one task has parsed, until it is sent on."""

    def __init__(self, buckets: int, hot: int):
        self.buckets, self.hot, self.parts, self.ids, self.keys, self.count = buckets, hot, [], [], [], 0

    def add(self, parsed: tuple[np.ndarray, ...], ids: np.ndarray, keys: np.ndarray, offset: np.ndarray) -> None:
        doc, first, further, trigger, content = parsed
        if len(doc):
            self.parts.append((doc + sum(map(len, self.ids)), first - offset[doc], further, trigger, content))
            self.ids.append(ids)
            self.keys.append(keys)
            self.count += len(doc)

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.count:
            return
        doc, first, further, trigger, content = (np.concatenate(x) for x in zip(*self.parts))
        ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
        by = np.lexsort((keys, ids))
        rank = np.empty(len(ids), dtype=np.int64)
        fresh = np.concatenate([[False], (ids[by][1:] != ids[by][:-1]) | (keys[by][1:] != keys[by][:-1])])
        rank[by] = np.cumsum(fresh)
        ids, keys = ids[by][np.concatenate([[0], np.flatnonzero(fresh)])], keys[by][np.concatenate([[0], np.flatnonzero(fresh)])]
        doc = rank[doc]
        place = (doc.astype(U64) << np.uint64(32)) | first.astype(U64)
        order = np.lexsort((place, content, trigger))
        head, later = firsts(trigger, content, place, order)
        sent = order[head]
        t = trigger[sent]
        runs = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        many = np.diff(np.append(runs, len(t))) >= self.hot
        if many.any():
            told = t[runs[many]]
            to = bucket_of(told, self.buckets)
            for b in np.unique(to).tolist():
                yield int(b), TOLD, pack(told[to == b])
            hot = np.repeat(many, np.diff(np.append(runs, len(t))))
            past, sent = sent[hot], sent[~hot]
            where = doc[past] % self.buckets
            for b in np.unique(where).tolist():
                own = past[where == b]
                used, local = np.unique(doc[own], return_inverse=True)
                yield b, PAST, pack(ids[used], keys[used], local.astype(U32), first[own].astype(U32), further[own].astype(U32), trigger[own])
        edges = np.searchsorted(bucket_of(trigger[sent], self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = sent[edges[b] : edges[b + 1]]
            used, local = np.unique(doc[own], return_inverse=True)
            yield b, NEW, pack(ids[used], keys[used], trigger[own], content[own], local.astype(U32), first[own].astype(U32), further[own].astype(U32))
        gone = order[later]
        if len(gone):
            where = doc[gone] % self.buckets
            for b in np.unique(where).tolist():
                own = gone[where == b]
                used, local = np.unique(doc[own], return_inverse=True)
                yield b, GONE, pack(ids[used], keys[used], local.astype(U32), first[own].astype(U32), further[own].astype(U32))
        self.__init__(self.buckets, self.hot)
        pa.default_memory_pool().release_unused()


def parser(buckets: int, hot: int = HOT, combined: int = COMBINED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Combiner(buckets, hot)
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

        def send() -> Iterator[pa.RecordBatch]:
            for b, kind, blob in made.flush():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] and offsets[-1] else np.zeros(0, np.uint8)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
                j = min(j, len(texts))
                begin, end = int(offsets[i]), int(offsets[j])
                if end - begin <= SEGMENT:
                    at = offsets[i:j] - begin
                    made.add(parse(data[begin:end], at, np.diff(offsets[i : j + 1])), ids[i:j], keys[i:j], at)
                else:  # one long text, in pieces that overlap by what a start reaches
                    for s in range(begin, end, SEGMENT):
                        piece = data[s : min(end, s + SEGMENT + MATCH - 1)]
                        made.add(parse(piece, np.zeros(1, np.int64), np.array([len(piece)])), ids[i:j], keys[i:j], np.array([begin - s]))
                        if made.count >= combined:
                            yield from send()
                i = j
                if made.count >= combined:
                    yield from send()
        yield from send()

    return run


FOUND = "doc_id long, text_key long, whole binary, open binary"


def grouped(ids: np.ndarray, keys: np.ndarray, entries: np.ndarray) -> dict[tuple[int, int], bytes]:
    """The rows of ``entries`` as bytes, by document."""
    if not len(ids):
        return {}
    order = np.lexsort((keys, ids))
    ids, keys, entries = ids[order], keys[order], np.ascontiguousarray(entries[order])
    edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1, [len(ids)]])
    return {(int(ids[a]), int(keys[a])): entries[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())}


RANGE = np.dtype([("start", "<u4"), ("further", "<u4")])
OPEN = np.dtype([("start", "<u4"), ("further", "<u4"), ("trigger", "<u8"), ("hot", "<u4")])


def opened(start: np.ndarray, further: np.ndarray, trigger: np.ndarray, hot: np.ndarray | int) -> np.ndarray:
    rows = np.empty(len(start), dtype=OPEN)
    rows["start"], rows["further"], rows["trigger"], rows["hot"] = start, further, trigger, hot
    return rows


def dictionary(pdf: pd.DataFrame, hot: int, buckets: int) -> pd.DataFrame:
    """One bucket's phrases: the ranges of starts that are repeated as a whole, and those still open."""
    got, passed, still, told = [], [], [], [np.zeros(0, U64)]
    for kind, blob in zip(pdf["kind"], pdf["blob"]):
        if kind == GONE:
            ids, keys, doc, first, further = unpack(blob, *STARTS)
            passed.append((ids[doc], keys[doc], first, further))
        elif kind == PAST:
            ids, keys, doc, first, further, trigger = unpack(blob, *OPENED)
            still.append((ids[doc], keys[doc], opened(first, further, trigger, 1)))
        elif kind == TOLD:
            told += unpack(blob, U64)
        else:
            ids, keys, trigger, content, doc, first, further = unpack(blob, *PHRASES)
            got.append((trigger, content, ids[doc], keys[doc], first, further))
    if got:
        trigger, content, ids, keys, first, further = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.argsort(trigger)
        same = trigger[order][1:] == trigger[order][:-1]
        shared = np.isin(trigger[order], np.concatenate(told))
        shared[1:] |= same
        shared[:-1] |= same
        pick = order[shared]
        if len(pick):
            trigger, content, ids, keys, first, further = (x[pick] for x in (trigger, content, ids, keys, first, further))
            rank = np.lexsort((first, keys, ids))
            moved = np.concatenate([[False], (ids[rank][1:] != ids[rank][:-1]) | (keys[rank][1:] != keys[rank][:-1]) | (first[rank][1:] != first[rank][:-1])])
            place = np.empty(len(rank), dtype=np.int64)
            place[rank] = np.cumsum(moved)
            order = np.lexsort((place, content, trigger))
            head, later = firsts(trigger, content, place, order)
            gone = order[later]
            passed.append((ids[gone], keys[gone], first[gone], further[gone]))
            entry = order[head]
            t = trigger[entry]
            runs = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            sizes = np.diff(np.append(runs, len(t)))
            often = np.repeat((sizes >= hot) | np.isin(t[runs], np.concatenate(told)), sizes)
            several = np.repeat(sizes > 1, sizes) | often
            own = entry[several]
            still.append((ids[own], keys[own], opened(first[own], further[own], trigger[own], often[several])))
    full, left = {}, {}
    if still:
        left = dealt(buckets, *(np.concatenate(x) for x in zip(*still)))
    if passed:
        ids, keys, first, further = (np.concatenate(x) for x in zip(*passed))
        rows = np.empty(len(ids), dtype=RANGE)
        rows["start"], rows["further"] = first, further
        full = dealt(buckets, ids, keys, rows)
    every = sorted({*full, *left})
    return pd.DataFrame({"to": every, "whole": [full.get(x) for x in every], "open": [left.get(x) for x in every]}, columns=["to", "whole", "open"]).astype({"to": "int32"})


def dealt(buckets: int, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> dict[int, bytes]:
    """``rows`` packed by the bucket of their document."""
    to = ((ids ^ keys).astype(U64) * ODD >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    return {int(b): pack(*(x[order[edges[b] : edges[b + 1]]] for x in (ids, keys, rows))) for b in np.flatnonzero(np.diff(edges))}


def gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """What all buckets found for the documents of one: a row for each document."""
    found = []
    for column, kind in (("whole", RANGE), ("open", OPEN)):
        parts = [unpack(b, I64, I64, kind) for b in pdf[column] if b is not None]
        found.append(grouped(*(np.concatenate(x) for x in zip(*parts))) if parts else {})
    full, left = found
    every = sorted({*full, *left})
    return pd.DataFrame({"doc_id": [d for d, _ in every], "text_key": [k for _, k in every], "whole": [full.get(x) for x in every], "open": [left.get(x) for x in every]}, columns=["doc_id", "text_key", "whole", "open"]).astype({"doc_id": "int64", "text_key": "int64"})


def spelled(data: bytes, start: int, further: int) -> np.ndarray:
    """Hashes of the ``MATCH`` bytes at ``start`` and at each of the ``further`` places after it."""
    up, down = powers(0)
    values = np.frombuffer(data, np.uint8, further + MATCH, start).astype(U64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(values)], dtype=U64)])
    return mix((total[MATCH:] - total[: further + 1]) * down[: further + 1])


def entries_of(buckets: int):
    """Open dictionary entries with their bytes, a row for some thousands of one bucket; of hot triggers the hashes of their suffixes."""

    def send(found: dict[int, list], hot: list) -> Iterator[pa.RecordBatch]:
        for b, rows in found.items():
            blob = pack(np.array([r[0] for r in rows], I64), np.array([r[1] for r in rows], I64), np.array([r[2] for r in rows], I64), np.array([len(r[3]) for r in rows], I64), np.frombuffer(b"".join(r[3] for r in rows), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
        if hot:
            ids, keys = np.array([r[0] for r in hot], I64), np.array([r[1] for r in hot], I64)
            doc = np.repeat(np.arange(len(hot)), [len(r[3]) for r in hot])
            start = np.concatenate([np.arange(r[2], r[2] + len(r[3])) for r in hot])
            spell = np.concatenate([r[3] for r in hot])
            order = np.argsort(spell)
            edges = np.searchsorted(bucket_of(spell[order], buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                used, local = np.unique(doc[own], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([1], pa.int32()), pa.array([pack(ids[used], keys[used], local.astype(U32), start[own].astype(U32), spell[own])], pa.binary())], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            hot: list[tuple[int, int, int, np.ndarray]] = []
            held = 0
            for doc, key, text, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = text.as_buffer().to_pybytes() if blobs else b""
                for blob in blobs or ():
                    rows = np.frombuffer(blob, dtype=OPEN)
                    for b, start, further, is_hot in zip(bucket_of(rows["trigger"].astype(U64), buckets).tolist(), rows["start"].tolist(), rows["further"].tolist(), rows["hot"].tolist()):
                        if is_hot:
                            hot.append((doc, key, start, spelled(data, start, further)))
                        else:
                            found.setdefault(b, []).append((doc, key, start, data[start : start + further + MATCH]))
                        held += 1
                if held >= HELD:
                    yield from send(found, hot)
                    found, hot, held = {}, [], 0
            yield from send(found, hot)

    return run


def ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of each of ``starts`` in the order of the suffixes of ``data`` to ``MATCH`` bytes, equal ones having one place.

    Prefix doubling: the order by 2k bytes is that by the place of the first k and that of the next k.
    """
    n = len(data) - 7
    value = np.zeros(n, dtype=U64)
    for k in range(8):
        value = value << np.uint64(8) | data[k : k + n]
    width, most = 8, 1 << (MATCH.bit_length() - 1)
    while True:
        place = np.unique(value, return_inverse=True)[1].astype(np.uint32)
        if width == most:
            break
        value = place[:-width].astype(U64) << np.uint64(32) | place[width:]
        width *= 2
    return np.unique(place[starts].astype(U64) << np.uint64(32) | place[starts + (MATCH - width)], return_inverse=True)[1]


def suffix_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The starts of one bucket whose ``MATCH`` bytes also start earlier: from the suffix array of its entries, and from equal hashes."""
    kind, found = pdf["kind"].to_numpy(), []
    if (kind == 0).any():
        ids, keys, start, size, data = (np.concatenate(x) for x in zip(*(unpack(b, I64, I64, I64, I64, np.dtype(np.uint8)) for b in pdf["blob"][kind == 0])))
        base, count = np.cumsum(size) - size, size - MATCH + 1
        entry = np.repeat(np.arange(len(size)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append((ranks(data, base[entry] + inside), ids[entry], keys[entry], start[entry] + inside))
    if (kind == 1).any():
        parts = [unpack(b, *SPELLED) for b in pdf["blob"][kind == 1]]
        spell = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)[1] + (1 << 40)  # apart from the places above
        found.append((spell, *(np.concatenate(x) for x in zip(*((ids[doc], keys[doc], start.astype(I64)) for ids, keys, doc, start, _ in parts)))))
    run, ids, keys, start = (np.concatenate(x) for x in zip(*found))
    _, which, times = np.unique(run, return_inverse=True, return_counts=True)
    keep = times[which] > 1
    run, ids, keys, start = run[keep], ids[keep], keys[keep], start[keep]
    order = np.lexsort((start, keys, ids, run))
    r = run[order]
    head = np.concatenate([[True], r[1:] != r[:-1]])[: len(r)]
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    gone = order[(ids[order] != ids[lead]) | (keys[order] != keys[lead]) | (start[order] != start[lead])]
    rows = np.zeros(len(gone), dtype=RANGE)
    rows["start"] = start[gone]
    full = grouped(ids[gone], keys[gone], rows)
    return pd.DataFrame({"doc_id": [d for d, _ in full], "text_key": [k for _, k in full], "whole": list(full.values())}, columns=["doc_id", "text_key", "whole"]).astype({"doc_id": "int64", "text_key": "int64"})


def cut_out(text: bytes, blobs: list[bytes]) -> tuple[bytes, int]:
    """What stays of ``text``, and the number of runs that go."""
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    for blob in blobs:
        rows = np.frombuffer(blob, dtype=RANGE)
        np.add.at(edge, rows["start"], 1)
        np.add.at(edge, rows["start"].astype(np.int64) + rows["further"] + MATCH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, combined: int = COMBINED) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text is empty; texts under ``MATCH`` bytes lose nothing.  Rows with the same doc_id and text are
    one document and get the same result; different texts of one doc_id are ordered by their hash; a null
    doc_id comes first.  Further columns are not read.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    source = docs.select(own.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("data"))
    facts = scratch.save(source.select("doc_id", "text_key", F.octet_length("data").cast("long").alias("n_bytes"), F.unhex(F.sha2("data", 256)).alias("sha")))
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parsed = source.mapInArrow(parser(buckets, hot, combined), "bucket int, kind int, blob binary")
    settled = parsed.groupBy("bucket").applyInPandas(lambda pdf: dictionary(pdf, hot, buckets), "to int, whole binary, open binary")
    found = scratch.save(settled.groupBy("to").applyInPandas(gather, FOUND))
    # A whole text that a smaller doc_id has too is settled.
    first = scratch.save(facts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    facts = scratch.save(facts.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"))
    copies = facts.where("copy").select("doc_id", "text_key").distinct()
    found = found.join(copies, ["doc_id", "text_key"], "left_anti")
    still = found.where("open is not null").groupBy("doc_id", "text_key").agg(F.collect_list("open").alias("open"))
    entries = source.join(still, ["doc_id", "text_key"]).select("doc_id", "text_key", "data", "open").mapInArrow(entries_of(FINER * buckets), "bucket int, kind int, blob binary")
    more = scratch.save(entries.groupBy("bucket").applyInPandas(suffix_order, "doc_id long, text_key long, whole binary"))
    ranges = found.where("whole is not null").select("doc_id", "text_key", "whole").unionByName(more).groupBy("doc_id", "text_key").agg(F.collect_list("whole").alias("blobs"))
    rows = source.join(ranges, ["doc_id", "text_key"]).select("doc_id", "text_key", "data", "blobs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cut_out(t, b) for t, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(k) for k, _ in kept], pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(k).digest() for k, _ in kept], pa.binary())], names=["doc_id", "text_key", "n_kept", "spans", "kept_sha"])

    done = rows.mapInArrow(cut, "doc_id long, text_key long, n_kept long, spans long, kept_sha binary").dropDuplicates(["doc_id", "text_key"])
    all_gone = F.col("copy") & (F.col("n_bytes") >= MATCH)
    out = facts.join(done, ["doc_id", "text_key"], "left")
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )
