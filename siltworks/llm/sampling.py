"""Bounded samples of labelled documents for fitting the classifiers of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, crc_mod, release_shuffles

#: Bytes of features that a sample may have, half of them for each class, and of one document's; beyond, rows are left out of the fit.
SAMPLE_BYTES, ROW_BYTES = 48 << 20, 1 << 20
#: Parts in which a sample comes to the driver.
PARTS = 8


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: int, features: Callable[[str], bytes], sample_bytes: int = SAMPLE_BYTES) -> list[tuple[int, bytes]]:
    """(label, features of the whole text) of up to per_class labelled documents of each class, sample_bytes in all.

    Rows whose crc32(doc_id) mod fold[0] is fold[1] are held out. The documents are those with the smallest hashes of
    doc_id among the documents that docs has, so the sample doesn't depend on the order of rows or on partitions. Rows
    without a label, a doc_id or a text are left out; a doc_id with several labels has the smallest of them, and one
    with several texts gives the one of the smallest hash, so repeated rows count once.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold[0]) != fold[1]))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = checkpointed(one.filter("label = 0").orderBy(*order).limit(per_class).unionByName(one.filter("label = 1").orderBy(*order).limit(per_class)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = (c.to_pylist() for c in batch.columns)
            made = [features(t) for t in texts]
            kept = [i for i, m in enumerate(made) if len(m) <= ROW_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], t) for x, t in ((ids, pa.int64()), (marks, pa.int32()), (made, pa.binary()))], names=["doc_id", "label", "features"])

    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    made = checkpointed(chosen.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features binary"))
    so_far = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = made.select("doc_id", "label", F.sum(F.octet_length("features")).over(so_far).alias("upto")).filter(F.col("upto") <= sample_bytes // 2)
    # A part at a time: collected at once, the sample takes the driver's JVM several times its bytes.
    rows = list(made.join(F.broadcast(sized), ["doc_id", "label"]).select("doc_id", "label", "features").coalesce(PARTS).toLocalIterator())
    release_shuffles(docs.sparkSession)
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[0], r[2]))]
