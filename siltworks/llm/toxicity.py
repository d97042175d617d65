"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of words cut to the characters in STEMS bytes (a crude stemmer, for inflected forms that the sample
lacks), of neighbouring pairs and of pairs with one or two words between them, hashed into 2**BITS buckets. Training is online (McMahan et al., 2013): a learning rate for each coordinate, L1 that keeps most
weights at exactly zero, and a feature takes part once MIN_DOCS documents of the sample have it. Only the non-zero
weights are broadcast.

Fitting sees at most PER_CLASS labelled documents of each class (with their whole texts); scoring sees every document.

Edge cases: null and empty texts have no features and get the score of the bias; without labels all scores are 0.5;
repeated rows are scored alike; an empty table gives an empty result; columns other than doc_id and text are never
read by a score, and clash with nothing.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import crc_mod, small_batches
from siltworks.llm.sampling import labelled_features

BITS = 20
SHIFT = np.uint64(64 - BITS)
#: Words between the two of a pair: 0 is a bigram, the others are skip-grams.
GAPS = (0, 1, 2)
STEMS = (4, 5)
PER_CLASS, MIN_DOCS, EPOCHS = 4000, 3, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
CACHE = 200_000
FOLD = (3, 1)
#: Lower-cases A-Z and makes a space of every ASCII byte that is neither digit nor letter.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))


class _Hashes(dict):
    """Number of each word met, with the CRC of the word and of its stems (0: as the word or longer)."""

    def __init__(self) -> None:
        super().__init__()
        self.crc = np.zeros((len(STEMS) + 1, CACHE), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= self.crc.shape[1]:  # one text with more words than the cache holds
            self.crc = np.concatenate([self.crc, np.zeros_like(self.crc)], axis=1)
        self.crc[0, at] = crc32(word)
        for i, n in enumerate(STEMS, 1):
            self.crc[i, at] = crc32(word[:n].decode("utf-8", "ignore").encode()) if len(word) > n else 0
        return at


def _buckets(text: str, hashes: _Hashes) -> np.ndarray:
    """The buckets of all features of a text, repeats included."""
    split = text.encode().translate(WORDS).split()
    if len(hashes) + len(split) > CACHE and len(hashes) > CACHE // 2:
        hashes.clear()
    at = np.fromiter(map(hashes.__getitem__, split), np.int64, len(split))
    h = hashes.crc[0][at]
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for i in range(1, len(STEMS) + 1):
        stems = hashes.crc[i][at]
        parts.append((stems[stems > 0] + np.uint64(i << 40)) * np.uint64(0x9E3779B97F4A7C15))
    for gap in GAPS:
        a, b = h[: max(0, len(h) - gap - 1)], h[gap + 1 :]
        parts.append((a * np.uint64(0xC2B2AE3D27D4EB4F) + b * np.uint64(0x165667B19E3779F9) + np.uint64(gap + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> SHIFT).astype(np.int32)


_HELD: list[_Hashes] = []


def _shared_hashes() -> _Hashes:
    """One cache a process."""
    if not _HELD:
        _HELD.append(_Hashes())
    return _HELD[0]


def features(text: str) -> bytes:
    return np.unique(_buckets(text, _shared_hashes())).tobytes()


def fit(rows: list[tuple[int, bytes]], seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of the non-zero weights."""
    size = 1 << BITS
    held = [(label, np.frombuffer(blob, np.int32)) for label, blob in rows]
    seen = np.zeros(size, np.int32)
    for _, ids in held:
        seen[ids] += 1
    held = [(label, ids[seen[ids] >= MIN_DOCS]) for label, ids in held]
    # The last coordinate is the bias, which isn't penalised.
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        l1 = np.where(ids == size, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(held)):
            label, ids = held[i]
            ids = np.append(ids, size)
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            root = np.sqrt(n[ids])
            z[ids] += g - (np.sqrt(n[ids] + g * g) - root) / ALPHA * w
            n[ids] += g * g
    w = weights(np.arange(size + 1))
    used = np.flatnonzero(w[:size])
    return used.astype(np.int32), w[used], float(w[size])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD) -> tuple[np.ndarray, np.ndarray, float]:
    small_batches(docs.sparkSession)
    return fit(labelled_features(docs, labels, "toxic", fold, per_class, features))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias = shipped.value
        dense = np.zeros(1 << BITS)
        dense[used] = weights
        hashes = _shared_hashes()
        for batch in batches:
            logits = []
            for text in batch.column(1).to_pylist():
                ids = _buckets(text or "", hashes)
                ids = np.unique(ids[dense[ids] != 0])
                logits.append(bias + dense[ids].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500))), pa.float64())], names=["doc_id", "score"])

    part = docs.select("doc_id", "text")
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLD[0]) == FOLD[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
