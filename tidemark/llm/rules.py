"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  The votes of all documents are counted by pattern
(at most 3 to the number of rules, whatever the corpus), expectation-maximisation estimates from the counts
how each rule votes on good and on bad documents, and the posterior probability of "good" replaces the
usual demand that every rule passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import Scratch, as_bytes, per_row

STATS_SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in textstats.NAMES)


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``textstats`` for each row; a null text is empty."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([textstats.counts(t) for t in as_bytes(batch.column(1))], dtype=np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["doc_id", *textstats.NAMES])

    return per_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), one, STATS_SCHEMA)


def _vote(ratio: Column, good: float, bad: float) -> Column:
    """Good up to ``good``, bad from ``bad``, no vote between or without a value."""
    return F.when(ratio <= good, 1).when(ratio >= bad, -1).otherwise(0)


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) > 0, F.col(b))


def rules() -> dict[str, Column]:
    """name -> vote.  A rule abstains where it has nothing to go by.

    Latent classes are told apart by rules that agree, so each kind of damage is seen by two rules at least.
    """
    length = _per("word_chars", "n_words")
    return {
        "v_words": F.when(F.col("n_words") < 50, -1).when(F.col("n_words") >= 60, 1).otherwise(0),
        "v_word_length": F.when((length < 2) | (length > 12), -1).when(length.between(3, 9), 1).otherwise(0),
        "v_symbols": _vote(_per("n_symbols", "n_words"), 0.02, 0.1),
        "v_marks": _vote(_per("n_symbols", "word_chars"), 0.01, 0.04),
        "v_letters": F.when(_per("n_letters", "word_chars") >= 0.9, 1).when(_per("n_letters", "word_chars") < 0.8, -1).otherwise(0),
        "v_dup_lines": _vote(_per("n_dup_lines", "n_lines"), 0.1, 0.3),
        "v_repeats": _vote(_per("n_repeat_words", "n_words"), 0.15, 0.4),
        "v_capitals": _vote(_per("n_upper", "n_letters"), 0.15, 0.3),
        "v_exclaims": _vote(_per("n_exclaim", "n_words"), 0.02, 0.1),
        "v_variety": F.when(F.col("n_words") >= 20, _vote(1 - _per("n_distinct", "n_words"), 0.8, 0.95)).otherwise(0),
    }


def em(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> np.ndarray:
    """P(good) of each row of ``patterns`` (votes -1, 0, 1), which occurs ``weights`` times.

    Two classes; per rule and class a distribution over the three votes.  The start (doubt wherever a rule
    votes bad) fixes which class is the good one.  Plain sums in a fixed order: the same counts give the same result.
    """
    votes = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    good = np.where((patterns == -1).any(1), 0.1, 0.9)
    for _ in range(rounds):
        logs = []
        for p in (good, 1 - good):
            mass = weights * p
            table = np.einsum("n,nrv->rv", mass, votes) + smooth
            table /= table.sum(1, keepdims=True)
            logs.append(np.log((mass.sum() + smooth) / (weights.sum() + 2 * smooth)) + np.einsum("nrv,rv->n", votes, np.log(table)))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            return new
        good = new
    return good


def judge(docs: DataFrame, scratch: Scratch | None = None, keep_from: float = 0.5) -> DataFrame:
    """Per row: the counts, ``base_failed``, the votes, ``p_good`` and ``kept``.

    A null or empty text has no words and fails the base test.  Repeated rows are judged alike.  Further
    columns are not read.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    names = list(rules())
    voted = scratch.save(with_stats(docs).select("*", *[v.cast("int").alias(n) for n, v in rules().items()]))
    code = sum((F.col(n) + 1) * F.lit(3**i) for i, n in enumerate(names))
    counted = voted.groupBy(code.alias("code")).agg(F.count("*").alias("n")).orderBy("code").collect()  # 3 ** len(names) rows at most
    probability = {}
    if counted:
        every = np.array([[(r["code"] // 3**i) % 3 - 1 for i in range(len(names))] for r in counted])
        for r, p in zip(counted, em(every, np.array([float(r["n"]) for r in counted]))):
            probability[r["code"]] = round(float(p), 9)
    lookup = F.broadcast(spark.createDataFrame([(r["code"], probability[r["code"]]) for r in counted], "code int, p_good double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("code", code).join(lookup, "code").drop("code").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= keep_from))
