"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features: words and word pairs, lower-cased; and runs of one to three word *shapes* (digits, marks,
capitalised, plain, or a repeat of the word before), so that texts of unknown words still say
something. Each n-gram is hashed to one of ``2 ** bits`` weights; a text's vector holds the n-grams it
has, each with the logarithm of its count, scaled to length one. A score is the sparse dot product of
this vector with the weights, through the logistic function. Only the text is read.

Training walks over at most ``max_train`` labelled rows (those with the smallest hash of doc_id: a
documented bound) in one task, whose memory that bound limits; scoring covers all rows in one pass
without a shuffle. The weights broadcast are ``4 * 2 ** bits`` bytes, whatever the input.

Defined cases: a null or empty text has only the constant feature and gets a score all the same; texts
of any length are read whole; repeated label rows count once, and of contradicting ones the lower
label counts; with no training row every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, texts, utf8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Hasher:
    """Turns texts into sorted distinct weight indices and their values."""

    def __init__(self, bits: int):
        self.bits = bits
        self.memo: dict[bytes, tuple[int, int]] = {}

    def _word(self, w: bytes) -> tuple[int, int]:
        if w.isdigit():
            shape = 1
        elif not any(c > 127 or chr(c).isalnum() for c in w):
            shape = 2
        elif any(48 <= c <= 57 for c in w):
            shape = 3
        elif 65 <= w[0] <= 90:
            shape = 4
        elif w[-1] < 128 and not chr(w[-1]).isalnum():
            shape = 5
        else:
            shape = 6
        return zlib.crc32(w.lower()), shape + 8 * min(len(w) // 4, 7)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > 500_000:
                memo.clear()
                new = set(words)
            memo.update((w, self._word(w)) for w in new)
        known = np.array([memo[w] for w in words], np.uint64).reshape(-1, 2)
        h, shape = known[:, 0], known[:, 1].copy()
        if len(h) > 1:
            shape[1:][h[1:] == h[:-1]] = 7
        one, two, base = np.uint64(1), np.uint64(1 << 40), np.uint64(64)
        grams = [np.array([1 << 50], np.uint64), h + one, shape + np.uint64(2 << 50)]
        if len(h) > 1:
            grams += [(h[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[1:] + two), shape[:-1] * base + shape[1:] + np.uint64(3 << 50)]
        if len(h) > 2:
            grams.append((shape[:-2] * base + shape[1:-1]) * base + shape[2:] + np.uint64(4 << 50))
        index, count = np.unique(_mixed(np.concatenate(grams), self.bits), return_counts=True)
        value = np.log1p(count)
        return index, value / np.sqrt((value * value).sum())


def train(rows, bits: int, *, alpha: float, beta: float, l1: float, l2: float, passes: int) -> np.ndarray:
    """Weights from (indices, values, label) rows, by the per-coordinate follow-the-regularised-leader rule."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for index, held, label in rows:
            value, w = held.astype(float), weights(index)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            more = n[index] + g * g
            z[index] += g - (np.sqrt(more) - np.sqrt(n[index])) / alpha * w
            n[index] = more
    return weights(slice(None)).astype(np.float32)


@dataclass
class QualityClassifier:
    """``fit`` learns ``weights`` from labelled texts."""

    bits: int = 20
    max_train: int = 16_000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    passes: int = 3
    weights: np.ndarray | None = None

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        """docs: doc_id, text. labels: doc_id and quality (0 or 1), only those to learn from."""
        chosen = (
            labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_train)
        )
        bits, how = self.bits, {"alpha": self.alpha, "beta": self.beta, "l1": self.l1, "l2": self.l2, "passes": self.passes}

        def make():
            hasher = Hasher(bits)

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                rows = [(i.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for i, v in map(hasher, utf8(b.column(1)))]
                return pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([i for i, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary()), b.column(2)],
                    ["doc_id", "index", "value", "quality"],
                )

            return run

        # at most max_train rows of two numbers: small enough to broadcast, whatever the input
        vectors = arrow_map(texts(docs).join(F.broadcast(chosen), "doc_id"), make, "doc_id long, index binary, value binary, quality int")

        def learn(batches):
            rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), q) for b in batches for i, v, q in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([train(rows, bits, **how).tobytes()], pa.binary())], ["weights"])

        # one task by the method's nature; its rows are bounded by max_train
        one = vectors.withColumn("order", F.crc32(F.col("doc_id").cast("string").cast("binary"))).repartition(1).sortWithinPartitions("order", "doc_id", "value")
        found = one.select("index", "value", "quality").mapInArrow(learn, "weights binary").collect()  # one row of 4 * 2 ** bits bytes
        self.weights = np.frombuffer(found[0][0], "<f4") if found else np.zeros(1 << bits, np.float32)
        return self

    def _score_all(self, raws: list[bytes], hasher: Hasher, weights: np.ndarray) -> np.ndarray:
        dots = np.array([float(weights[i] @ v) for i, v in map(hasher, raws)])
        return 1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35)))

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score of every row."""
        spark = docs.sparkSession
        weights, bits, score_all = spark.sparkContext.broadcast(self.weights), self.bits, QualityClassifier._score_all

        def make():
            hasher, w = Hasher(bits), weights.value

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0), pa.array(score_all(None, utf8(b.column(1)), hasher, w), pa.float64())], ["doc_id", "score"])

            return run

        return arrow_map(texts(docs, id_col=id_col, text_col=text_col), make, "doc_id long, score double")

    def keep(self, docs: DataFrame, threshold: float, *, text_col: str = "text") -> DataFrame:
        """The rows of docs that score at least ``threshold``, with all their columns; no shuffle."""
        weights, bits, score_all, held = docs.sparkSession.sparkContext.broadcast(self.weights), self.bits, QualityClassifier._score_all, {}

        @F.pandas_udf("boolean")
        def kept(text):
            import pandas as pd

            hasher = held.setdefault("hasher", Hasher(bits))
            return pd.Series(score_all(None, [(t or "").encode() for t in text], hasher, weights.value) >= threshold)

        return docs.filter(kept(F.col(text_col)))


def held_out(doc_id) -> object:
    """Rows never learnt from: crc32 of the decimal doc_id is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
