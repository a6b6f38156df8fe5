"""Quality classifier: Bradley-Terry pairwise ranking.

Documents marked good beat documents marked bad.  The strength of a document is linear in its features,
P(i beats j) = 1 / (1 + exp(-w (x_i - x_j))), and w minimises the logistic loss over the preference pairs
with a small ridge.  A ranking has no zero point of its own, so the cut comes from a score quantile: the
share of bad labels among the training rows says below which quantile of their strengths a document is
rejected.  The reported score maps strengths to 0..1 so that the cut lies at ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .rules import with_stats

#: Most labelled rows to learn from, those with the least hash of doc_id; all statistics of the corpus cover every row.
SAMPLE = 20_000
#: Preference pairs per rarer-class document in the sample.
PARTNERS, SEED = 40, 11
THRESHOLD = 0.3


def _ratio(a: str, b: str, most: float) -> Column:
    return F.least(F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)), F.lit(most)) / most


def features() -> list[Column]:
    """Bounded to about 0..1, from the text alone."""
    return [
        F.least(F.log1p("n_words") / 8, F.lit(1.0)), (F.col("n_words") < 5).cast("double"), (F.col("n_words") < 20).cast("double"), (F.col("n_words") < 50).cast("double"),
        _ratio("word_chars", "n_words", 20.0), _ratio("n_symbols", "n_words", 0.5), _ratio("n_symbols", "n_words", 3.0), _ratio("n_dup_lines", "n_lines", 1.0),
        _ratio("n_repeat_words", "n_words", 1.0), _ratio("n_repeat_words", "n_words", 0.3), _ratio("n_upper", "n_letters", 1.0), _ratio("n_upper", "n_letters", 0.2),
        _ratio("n_exclaim", "n_words", 0.2), _ratio("n_exclaim", "n_words", 1.0), _ratio("n_digits", "n_words", 1.0), _ratio("n_stops", "n_words", 1.0),
        _ratio("n_bars", "n_words", 0.3), _ratio("n_brackets", "n_words", 0.5), _ratio("n_distinct", "n_words", 1.0),
    ]


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method on the mean logistic loss of the differences good - bad."""
    if not len(good) or not len(bad):
        return np.zeros((good if len(good) else bad).shape[1])
    # Every row of the rarer class gets PARTNERS pairs, with rows of the other in the order of seeded permutations, so all of these are used alike.
    n, random = min(len(good), len(bad)) * PARTNERS, np.random.default_rng(SEED)

    def dealt(rows: np.ndarray) -> np.ndarray:
        return rows[np.concatenate([random.permutation(len(rows)) for _ in range(-(-n // len(rows)))])[:n]]

    diff = dealt(good) - dealt(bad)
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
        slope = -diff.T @ (1 - p) / len(diff) + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` and the counts of each labelled document that is not held out, one row for each doc_id.

    A document with several labels counts as bad if one of them says so; null labels and labels of unknown
    documents are left out.  Of several texts of one doc_id that with the least hash stands for it.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~is_held_out())
    once = named.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").where(~is_held_out()).withColumn("text_key", F.xxhash64("text"))
    chosen = texts.select("doc_id", "text_key").join(once, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text_key").alias("text_key"))
    rows = with_stats(texts.join(chosen.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")).dropDuplicates(["doc_id"])  # rows of one doc_id and text have the same counts
    return rows.join(chosen.select("doc_id", "quality"), "doc_id")


def cut_and_scale(strengths: DataFrame) -> tuple[float, float]:
    """The strength at the quantile that the share of bad rows names, and the slope of the score there, from all labelled rows.

    The quantile is exact: Spark sorts the strengths, and the driver sees the two at the cut.
    """
    facts = strengths.agg(F.count("*").alias("n"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.min("strength").alias("low"), F.max("strength").alias("high")).first()
    n, bad = facts["n"], facts["bad"] or 0
    if not bad or bad == n:
        return (-1.0 if not n else facts["high"] + 1 if bad else facts["low"] - 1), 1.0
    middle = strengths.groupBy((F.col("quality") > 0).alias("good")).agg(F.expr("percentile_approx(strength, 0.5, 10000)").alias("m")).collect()
    low, high = (next(r["m"] for r in middle if r["good"] is x) for x in (False, True))
    at = F.expr(f"percentile(strength, array({(bad - 1) / max(n - 1, 1)!r}D, {bad / max(n - 1, 1)!r}D))")  # exactly the share of bad rows lies below their middle
    a, b = strengths.agg(at.alias("p")).first()["p"]
    return float(a + b) / 2, float(6 / max(high - low, 1e-6))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, scratch: Scratch | None = None) -> tuple[np.ndarray, float, float]:
    """Weights, cut and slope from the labelled rows that are not held out.

    The weights come from at most ``sample`` of them, those with the least hash of doc_id; the cut and the slope from all.
    No label at all: every document gets the same score, above the threshold.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    known = scratch.save(labelled(docs, labels))
    rows = known.select("doc_id", "quality", F.array(*features()).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(features()))
    y = np.array([r["quality"] for r in rows], dtype=int)
    w = fit(x[y > 0], x[y == 0])
    cut, slope = cut_and_scale(known.select("quality", strength_column(w).alias("strength")))
    scratch.drop(known)
    return w, cut, slope


def strength_column(w: np.ndarray) -> Column:
    return sum((f * F.lit(float(c)) for f, c in zip(features(), w)), F.lit(0.0))


def score_column(w: np.ndarray, cut: float, slope: float, threshold: float = THRESHOLD) -> Column:
    """The score from the counts of ``textstats``."""
    logit = F.lit(slope) * (strength_column(w) - F.lit(cut)) + F.lit(float(np.log(threshold / (1 - threshold))))
    return F.round(1 / (1 + F.exp(-logit)), 9)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``.

    A null text is scored as the empty one; a null doc_id counts as not held out.  Equal texts score alike,
    whatever their rows; whole texts are counted, however long.  Further columns are not read; an empty table
    gives an empty table.
    """
    w, cut, slope = learn(docs, labels, sample, scratch)
    scored = with_stats(docs).select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), score_column(w, cut, slope, threshold).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
