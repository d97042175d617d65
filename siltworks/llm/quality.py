"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words, of the character n-grams of its words and of its word pairs,
all hashed into one table; a softmax over two linear outputs follows. Both layers are trained together by stochastic
gradient descent in numpy. Case and punctuation are kept. A pair of equal words is written with a back reference, so
that all immediate repetitions share one vector.

The average and the output layer are linear, so for scoring each vector is folded into one number (its share of the
difference of the two outputs) and only that table of BUCKETS numbers is broadcast. Workers keep the sums of words
they have met; a full cache is emptied, never the text cut.

Fitting sees at most PER_CLASS labelled documents of each class (with their whole texts); scoring sees every document.

Edge cases: null and empty texts have no features and get the score of the output bias; without labels all scores are
0.5; repeated rows are scored alike; an empty table gives an empty result; columns other than doc_id and text are
never read by a score, and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import crc_mod, small_batches
from siltworks.llm.sampling import labelled_features

BUCKETS, DIM, GRAM = 1 << 16, 8, 3
PER_CLASS = 2500
EPOCHS, RATE = 6, 8.0
CACHE = 300_000
FOLD = (4, 2)
MASK = BUCKETS - 1
#: The bucket of a pair of equal words.
SAME = MASK


def _word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, which are byte n-grams here."""
    edged = b"<" + word + b">"
    return [crc32(edged) & MASK, *(crc32(edged[i : i + GRAM]) & MASK for i in range(len(edged) - GRAM + 1))]


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.where(a == b, np.uint64(SAME), mixed & np.uint64(MASK)).astype(np.int64)


def features(text: str) -> bytes:
    """Distinct buckets (int32) and their counts (float32) of a whole text."""
    split = text.encode().split()
    hashes = np.fromiter(map(crc32, split), np.uint64, len(split))
    ids: list[int] = []
    for word in split:
        ids += _word_features(word)
    every = np.concatenate([np.array(ids, np.int64), _pairs(hashes)]) if split else np.zeros(0, np.int64)
    kinds, counts = np.unique(every, return_counts=True)
    return kinds.astype(np.int32).tobytes() + counts.astype(np.float32).tobytes()


def fit(rows: list[tuple[int, bytes]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(folded table, bias): the logit of label 1 is bias + mean of the table over a text's features."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    held = []
    for label, blob in rows:
        n = len(blob) // 8
        if n:
            counts = np.frombuffer(blob, np.float32, n, 4 * n)
            held.append((label, np.frombuffer(blob, np.int32, n), counts / counts.sum()))
    share = [max(1, sum(1 for x in held if x[0] == c)) for c in (0, 1)]
    weight = [len(held) / (2 * s) for s in share]  # both classes pull alike
    steps, done = EPOCHS * len(held), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(held)):
            label, ids, part = held[i]
            rate = RATE * (1 - done / steps) * min(weight[label], 4.0)
            vectors = table[ids]
            mean = part @ vectors
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= np.float32(0.1 * rate) * np.outer(p, mean)
            bias -= np.float32(0.01 * rate) * p
            table[ids] -= np.float32(rate) * np.outer(part, back)
            done += 1
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


class _Words(dict):
    """Number of each word met, with its hash and the sum and number of its features."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tolist()
        self.hash, self.sum, self.n = np.zeros(CACHE, np.uint64), np.zeros(CACHE), np.zeros(CACHE)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= len(self.n):  # one text with more words than the cache holds
            self.hash, self.sum, self.n = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.hash, self.sum, self.n))
        ids = _word_features(word)
        t = self.table
        self.hash[at], self.sum[at], self.n[at] = crc32(word), sum([t[i] for i in ids]), len(ids)
        return at

    def logit(self, text: str, pairs: np.ndarray) -> float:
        split = text.encode().split()
        if not split:
            return 0.0
        if len(self) + len(split) > CACHE and len(self) > CACHE // 2:
            self.clear()
        at = np.fromiter(map(self.__getitem__, split), np.int64, len(split))
        return float((self.sum[at].sum() + pairs[_pairs(self.hash[at])].sum()) / (self.n[at].sum() + len(at) - 1))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD) -> tuple[np.ndarray, float]:
    small_batches(docs.sparkSession)
    return fit(labelled_features(docs, labels, "quality", fold, per_class, features))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """doc_id, the columns to keep, and the score under the given name, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shipped.value
        seen, pairs = _Words(table), table.astype(np.float64)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            logits = np.clip([bias + seen.logit(t or "", pairs) for t in texts], -500, 500)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *keep)], pa.array(1 / (1 + np.exp(-logits)), pa.float64())], names=["doc_id", *keep, name])

    part = docs.select("doc_id", *keep, *([] if "text" in keep else ["text"]))
    kinds = {f.name: f.dataType.simpleString() for f in part.schema}
    return part.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + f", `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLD[0]) == FOLD[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
