"""Best-fit packing by sum of squares.

Documents become token ids, longer ones are cut, and pieces fill sequences of a fixed length.  Pieces are
placed from long to short; each goes into the open sequence for which the sum over residual gaps of the
squared number of open sequences becomes smallest.  A new sequence is opened only where none has room.

Pieces are dealt by hash into groups of bounded size, whose number grows with the input; each group is
packed by one task, so an open sequence is lost per group at most.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_texts, per_row

LENGTH = 2048
#: Pieces that one task packs, about.
GROUP = 100_000
#: Different words whose ids a worker remembers; beyond that they are encoded each time.
REMEMBERED = 400_000
END_OF_TEXT = 0
SPECIAL = "<|endoftext|>"
#: Where a space touches other white space, or there is unusual white space, words can't be cut at spaces.
UNEVEN = re.compile(r"[^\S \n]|[\x1c-\x1f]| (?=\s)|(?<=\s) |\A | \Z")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian bytes, four for each id.

    The pre-tokeniser never joins what a single space between two other characters separates, so words cut
    there are encoded apart and remembered.  Texts with other white space are encoded whole; texts with the
    special token's name go through the tokenizer file itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if self.fast is None or SPECIAL in text:
            return np.array(self.file.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or SPECIAL in text or UNEVEN.search(text):
            return self.whole(text)
        words = text.split(" ")
        out = [self.whole(words[0])]
        known, encode = self.later, self.fast.encode_ordinary
        for word in words[1:]:
            ids = known.get(word)
            if ids is None:
                ids = np.array(encode(" " + word), dtype="<u4").tobytes()
                if len(known) < REMEMBERED and len(word) < 40:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: only the first may be shorter than ``length``."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of each row; ``salt`` depends on the content and on the place in its batch, so repeated rows differ in it."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer or default_tokenizer())
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1))):
            ids = memoryview(encode(text) + END_OF_TEXT.to_bytes(4, "little"))
            for k, (at, n) in enumerate(cut(len(ids) // 4, length)):
                crc = zlib.crc32(ids[4 * at : 4 * (at + n)])
                rows.append((doc, k, at, n, crc, zlib.crc32(b"%d %d" % (len(rows), k), crc)))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), *[pa.int64()] * 4])], names=names)

    return per_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), one, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def sum_of_squares(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` come from long to short."""
    of, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    n_open = np.zeros(length + 1, dtype=np.int64)  # by residual gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    made = 0
    for i, size in enumerate(lengths.tolist()):
        fitting = n_open[size:]
        gaps = np.flatnonzero(fitting)
        if len(gaps):
            # The squares change by 2 * (open at the gap that is left - open at the gap that is used) + 2; a full sequence leaves none.
            change = 2 * (n_open[gaps] - fitting[gaps]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * fitting[0]
            left = int(gaps[np.argmin(change)])
            gap = left + size
            sequence = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            sequence, gap, left = made, length, length - size
            made += 1
        of[i], at[i] = sequence, length - gap
        if left:
            stacks[left].append(sequence)
            n_open[left] += 1
    return of, at


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: ``PACKED``.

    A null or empty text is the end-of-text id alone.  Repeated rows are packed as often as they came.
    Further columns are not read; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    cut_up = scratch.save(pieces(docs, tokenizer, length))
    groups = max(1, -(-cut_up.count() // group))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        of, at = sum_of_squares(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(pdf["bin"].to_numpy(dtype=np.int64) << 32) + of, offset=at).drop(columns=["bin", "salt"])

    dealt = cut_up.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
    return dealt.groupBy("bin").applyInPandas(one, PACKED)
