"""Line deduplication with two Bloom filters.

Lines that many documents share are dropped everywhere but in the document with the largest doc_id. Each task keeps
two filters over the hashes of its lines, one of bits set once and one of bits set again; segments of both are merged
by a shuffle of sparse pieces, where bits that two tasks set once count as set again. The "again" filter alone is
gathered and broadcast (MAX_BITS bounds it; beyond that more lines are suspected, with the same result). A second pass
sends only the suspected lines, as 128-bit digests, to an exact count of documents; a third pass takes the lines out.
Texts without a suspected line are finished in place and their text is never shuffled.

Edge cases: null text counts as empty (one empty line); a null doc_id is a document smaller than all others; repeated
rows of a doc_id are one document and lose the same lines; an empty table gives an empty result; a line repeated within
one document counts once, and all its places go or stay; other columns are dropped by name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import ASCII_LOWER, checkpointed, get_bits, set_bits, small_batches, text_or_empty

MIN_LENGTH, MIN_DOCS = 20, 3
#: Bits a line, bits of a filter at least and at most (32 MB), bits of a merged segment.
BITS_A_LINE, MIN_BITS, MAX_BITS, SEGMENT = 8, 1 << 16, 1 << 28, 1 << 16
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(lines: list[bytes], min_length: int = MIN_LENGTH) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE)
        long_enough = len(key) >= 4 * min_length or (len(key) >= min_length and len(key.decode("utf-8", "replace")) >= min_length)
        out.append(key.translate(ASCII_LOWER) if long_enough else None)
    return out


def _bits(keys: list[bytes], n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64(n_bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(7) & mask).astype(np.int64)


def _distinct_keys(text: str | None, min_length: int) -> list[bytes]:
    return [k for k in dict.fromkeys(line_keys((text or "").encode().split(b"\n"), min_length)) if k is not None]


def repeat_filter(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> tuple[np.ndarray, int]:
    """(filter as bytes, number of bits): bits that were set by two documents' lines at least."""
    body = text_or_empty(text)
    n_lines = docs.agg(F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    n_bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(BITS_A_LINE * max(n_lines, 1)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                keys = _distinct_keys(value, min_length)
                if keys:
                    a, b = _bits(keys, n_bits)
                    seen = get_bits(once, a) & get_bits(once, b)
                    for at in (a, b):
                        set_bits(again, at[seen])
                        set_bits(once, at)
        for s in range(n_bits // SEGMENT):
            part = slice(s * SEGMENT // 8, (s + 1) * SEGMENT // 8)
            if once[part].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(once[part].tobytes(), 1)], "again": [zlib.compress(again[part].tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, once, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, again))
                if s in held:
                    held[s][1] |= two | (held[s][0] & one)
                    held[s][0] |= one
                else:
                    held[s] = [one.copy(), two.copy()]
        for s, (_, two) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "again": [two.tobytes()]})

    pieces = docs.select(F.col(text)).mapInArrow(build, "segment int, once binary, again binary")
    merged = pieces.repartition("segment").mapInArrow(merge, "segment int, again binary").collect()
    out = np.zeros(n_bits // 8, np.uint8)
    for r in merged:
        out[r[0] * SEGMENT // 8 : (r[0] + 1) * SEGMENT // 8] = np.frombuffer(r[1], np.uint8)
    return out, n_bits


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without dropped lines; null where it is unchanged), kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    found, n_bits = repeat_filter(docs, text, min_length)
    shipped = spark.sparkContext.broadcast(found)

    def suspects(value: str | None) -> list[bytes]:
        keys, bits = _distinct_keys(value, min_length), shipped.value
        if not keys:
            return []
        a, b = _bits(keys, n_bits)
        hit = get_bits(bits, a) & get_bits(bits, b)
        return [hashlib.blake2b(keys[i], digest_size=16).digest() for i in np.flatnonzero(hit)]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, ids, rows = [], [], []
            for doc_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = suspects(value)
                lines += got
                ids += [doc_id] * len(got)
                rows += [xxhash.xxh3_64_intdigest(value or "") >> 1] * len(got)
            yield pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.binary()), "doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = value or ""
                out.append((doc_id, xxhash.xxh3_64_intdigest(value) >> 1, value.count("\n") + 1, hashlib.sha256(value.encode()).hexdigest(), value if suspects(value) else None))
            yield _batch(out, ("doc_id", "row", "n_lines", "kept_sha256", "text"), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n_lines, sha, value, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not lines:
                    out.append((doc_id, n_lines, 0, None, sha))
                    continue
                gone, whole = set(lines), value.encode().split(b"\n")
                kept = b"\n".join(x for x, k in zip(whole, line_keys(whole, min_length), strict=True) if k is None or hashlib.blake2b(k, digest_size=16).digest() not in gone)
                n_kept = sum(1 for k in line_keys(whole, min_length) if k is None or hashlib.blake2b(k, digest_size=16).digest() not in gone)
                out.append((doc_id, n_lines, n_lines - n_kept, kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield _batch(out, ("doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))

    pair = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    flagged = pair.mapInArrow(flag, "line binary, doc_id long, row long")
    # Kept as a table, so that the join's sides are plain exchanges and a line of very many documents is split among tasks.
    repeated = checkpointed(flagged.groupBy("line", "doc_id").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs))
    lost = flagged.join(repeated, "line").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))
    whole = pair.mapInArrow(finish, "doc_id long, row long, n_lines long, kept_sha256 string, text string").alias("w")
    joined = whole.join(lost.alias("l"), F.col("w.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("w.row") == F.col("l.row")), "left")
    return joined.select("w.doc_id", "w.n_lines", "w.kept_sha256", F.when(F.col("l.lines").isNotNull(), F.col("w.text")).alias("text"), "l.lines").mapInArrow(take_out, "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
