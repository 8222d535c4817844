"""Document quality by Bradley-Terry pairwise ranking.

Each document gets a worth, linear in features of its text. The weights maximise the likelihood
that, of a labelled pair, the good document wins: P(i beats j) = logistic(worth_i - worth_j). Only
differences of features enter the fit, so it ranks; a quantile of the training worths then turns
the ranking into a decision.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import encoded, map_batches, text_hash, texts

FEATURES = ("log_words", "word_length", "upper_share", "digit_share", "marks_per_word", "bangs_per_word", "bars_per_word", "stops_per_word", "other_share", "distinct_words", "same_as_previous", "same_lines", "words_per_line", "longest_word")
#: Most labelled rows of each label that the fit reads, those with the least hash of their id.
SAMPLE = 10_000
#: Opponents of the other label that each sampled row meets.
OPPONENTS = 16
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~<>{}[]\\_=+", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
_PLAIN = _UPPER | _LOWER | _DIGIT | _STOPS | (np.arange(256) >= 128) | np.isin(np.arange(256), np.frombuffer(b" \n!|'\"-()", np.uint8)) | _MARKS


def features(text: bytes) -> list[float]:
    """Of one UTF-8 text, in the order of FEATURES; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = int(seen[_UPPER].sum() + seen[_LOWER].sum()) or 1
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(n)),
        min(len(text) / n, 40.0),
        seen[_UPPER].sum() / letters,
        seen[_DIGIT].sum() / len(text),
        min(seen[_MARKS].sum() / n, 5.0),
        min(seen[33] / n, 5.0),
        min(seen[124] / n, 5.0),
        min(seen[_STOPS].sum() / n, 5.0),
        seen[~_PLAIN].sum() / len(text),
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(np.log1p(max(map(len, words)))),
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted model: score = logistic((worth - threshold)), worth = weights . (features - mean) / scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        worth = ((rows - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(worth - self.threshold, -500, 500)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, opponents: int = OPPONENTS, ridge: float = RIDGE, rounds: int = 30) -> Ranking:
    """Fit by Newton steps on the logistic loss of feature differences, good minus bad.

    Every row meets ``opponents`` of the other label, taken in turn. Without rows of both labels
    every score is 0.5 or more (no evidence against any text).
    """
    both = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((1, len(FEATURES)))
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(len(FEATURES)), 0.0)
    g, b = (good - mean) / scale, (bad - mean) / scale
    k = np.arange(max(len(g), len(b)) * opponents)
    turn = k // max(len(g), len(b))
    diff = g[(k + turn) % len(g)] - b[(k * 7 + turn * 13) % len(b)]
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
        grad = diff.T @ (1 - p) / len(diff) - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    # the quantile that leaves as many sampled rows below as are labelled bad
    worth = np.concatenate([g @ w, b @ w])
    return Ranking(mean, scale, w, float(np.quantile(worth, len(b) / len(worth))))


def featured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named in ``more``, and x: the features of the whole text."""
    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in encoded(batch.column("text"))]
        names = ["doc_id", *more]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])

    return map_batches(docs, each, f"doc_id long{extra}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", sample: int = SAMPLE) -> Ranking:
    """Fit on at most ``sample`` labelled rows of each label for which ``usable`` (of doc_id) holds.

    The rows are those with the least hash of their id, so the choice doesn't depend on how the
    tables are cut. Rows with a null id or label are passed over; of rows that label one document
    twice, each counts.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(usable & F.col("doc_id").isNotNull())
    halves = [picked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most 2 x sample rows of two numbers
    rows = featured(texts(docs).join(chosen, "doc_id"), "y").select("y", "x").collect()  # bounded by the sample
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r.y for r in rows], int)
    order = np.lexsort([*x.T, y])  # the result doesn't depend on the order of arrival
    x, y = x[order], y[order]
    return fit_pairs(x[y == 1], x[y == 0])


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, text_hash and score of every row. A null or empty text gets the score of zero features; a null id stays null."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in encoded(batch.column("text"))], float)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(model.score(x))], names=["doc_id", "text_hash", "score"])

    return map_batches(texts(docs, "doc_id", "text", text_hash().alias("text_hash")), each, "doc_id long, text_hash long, score double")


def held_out() -> Column:
    """One document in three: labels of those are never learnt from. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
