"""Media columns stored as content-defined chunks.

A text's bytes, padded with 255 to rows of WIDTH samples, become an 8-bit greyscale image (PGM). A rolling gear hash
cuts the image into chunks of 256 to 4096 bytes; the cuts follow the content, so equal passages give equal chunks. The
digests of all chunks are counted; those that occur again go into a Bloom filter (MAX_BITS bounds it), with which a
second pass writes the store:

* list rows: a medium's ordered chunk list, with the bytes of chunks that occur once in place, digests for the others;
* chunk rows: the bytes of chunks that the filter says are shared, at most once a task.

Reading back joins the digests with one row of each shared chunk, puts the lists in order, and checks the SHA-256 of
the medium before any feature is computed. Copies have the same list, which is read back once. Only shared chunks are
ever shuffled with their bytes; a false positive of the filter only makes a chunk travel.

Edge cases: null text counts as empty, and an empty text is one row of 255s; repeated rows share their chunks; null
doc_ids are kept; an empty table gives an empty result; other columns are not read. A stored medium that doesn't
match its digest raises an error.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, get_bits, respread, set_bits, shared_path, small_batches

WIDTH = 576
#: Chunk sizes in bytes; CUT_BITS top bits of the gear hash are zero at a cut.
LEAST, MOST, CUT_BITS = 256, 4096, 10
#: Bits of the filter for each shared chunk, and of the filter at most (32 MB).
BITS_A_CHUNK, MIN_BITS, MAX_BITS, SEGMENT = 16, 1 << 16, 1 << 28, 1 << 16
#: Digests of chunks that a task remembers having written; forgetting writes a chunk again.
REMEMBERED = 200_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=576) for b in range(256)], np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def encode(data: bytes) -> bytes:
    """The payload as a binary PGM image of WIDTH columns."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def decode(image: bytes) -> np.ndarray:
    """The samples of an image made by encode(), a row of the array for each row of the image."""
    kind, size, top, data = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] becomes the sum of GEAR[data[i - k]] << k over k < 2 * step
        add = h[:-step] << np.uint32(step)
        h[step:] += add
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, n = [], 0, len(data)
    while n - start > LEAST:
        at = bisect.bisect_left(ends, start + LEAST)
        end = min(ends[at] if at < len(ends) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(image: np.ndarray) -> str:
    """Mean and deviation of the samples and the counts of their 16 brightness classes."""
    n = image.size
    counts = np.bincount(image.ravel(), minlength=256)
    level = np.arange(256)
    mean = float((counts * level).sum()) / n
    spread = math.sqrt(max(0.0, float((counts * level * level).sum()) / n - mean * mean))
    return f"{mean:.4f};{spread:.4f};" + "-".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))


def _bits(digests: list[bytes], n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) & np.uint64(n_bits - 1)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def shared_filter(shared: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter (bytes, number of bits) of a column of 16-byte digests; segments are merged by a shuffle."""
    n = shared.count()
    n_bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(BITS_A_CHUNK * max(n, 1)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                for at in _bits(batch.column(0).to_pylist(), n_bits):
                    set_bits(bits, at)
        for s in range(n_bits // SEGMENT):
            if (part := bits[s * SEGMENT // 8 : (s + 1) * SEGMENT // 8]).any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "bits": [zlib.compress(part.tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.frombuffer(zlib.decompress(bits), np.uint8)
                held[s] = held[s] | got if s in held else got
        for s, bits in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "bits": [bits.tobytes()]})

    out = np.zeros(n_bits // 8, np.uint8)
    for r in shared.mapInArrow(build, "segment int, bits binary").repartition("segment").mapInArrow(merge, "segment int, bits binary").collect():
        out[r[0] * SEGMENT // 8 : (r[0] + 1) * SEGMENT // 8] = np.frombuffer(r[1], np.uint8)
    return out, n_bits


STORE = "kind int, doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_chunks int, n_shared int, digest binary, data binary, parts array<struct<digest:binary,data:binary>>"
PARTS = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_chunks", pa.int32()), ("n_shared", pa.int32()), ("digest", pa.binary()), ("data", pa.binary()), ("parts", PARTS)])
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, n_shared int"


def write_store(docs: DataFrame, path: str) -> None:
    """The chunk store of docs (doc_id, text) as a Parquet table."""
    spark = docs.sparkSession
    small_batches(spark)
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [digest(c) for text in batch.column(0).to_pylist() for c in chunks(encode(payload(text)[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary())], names=["digest"])

    again = pair.select("text").mapInArrow(count, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    found, n_bits = shared_filter(checkpointed(again.select("digest")))
    shipped = spark.sparkContext.broadcast(found)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, written = shipped.value, set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_bytes, data = payload(text)
                image = encode(data)
                pieces = chunks(image)
                names = [digest(c) for c in pieces]
                a, b = _bits(names, n_bits)
                hit = (get_bits(bits, a) & get_bits(bits, b)).tolist()
                parts = [{"digest": d, "data": None} if h else {"digest": None, "data": c} for c, d, h in zip(pieces, names, hit, strict=True)]
                rows.append((0, doc_id, n_bytes, len(image), hashlib.sha256(image).hexdigest(), len(pieces), sum(hit), None, None, parts))
                for c, d, h in zip(pieces, names, hit, strict=True):
                    if h and d not in written:
                        if len(written) >= REMEMBERED:
                            written.clear()
                        written.add(d)
                        rows.append((1, None, None, None, None, None, None, d, c, None))
            columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    pair.mapInArrow(store, STORE).write.option("compression", "zstd").parquet(path)


def _read(doc_id: int | None, n_bytes: int | None, sha: str, n_chunks: int, n_shared: int, image: bytes) -> tuple:
    if hashlib.sha256(image).hexdigest() != sha:
        raise ValueError(f"medium {sha} doesn't match its digest")
    samples = decode(image)
    data = samples.tobytes()
    return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), sha, feature(samples), n_chunks, n_shared


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = [x.split()[0] for x in READ.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_store(spark, path: str) -> DataFrame:
    """Every medium of a store, read back and verified, with its features."""
    small_batches(spark)
    store = spark.read.parquet(path)
    lists = store.filter("kind = 0")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([_read(*row, b"".join(p["data"] for p in parts)) for *row, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, n_chunks, n_shared, parts, got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = {g["pos"]: g["data"] for g in got}
                rows.append(_read(None, None, sha, n_chunks, n_shared, b"".join(held[i] if p["data"] is None else p["data"] for i, p in enumerate(parts))))
            yield _rows(rows)

    columns = ["media_sha256", "n_chunks", "n_shared", "parts"]
    plain = lists.filter("n_shared = 0").select("doc_id", "n_bytes", *columns).mapInArrow(whole, READ)
    # Media with a chunk of their own occur once; of those made of shared chunks only, one list is read.
    mixed = lists.filter("n_shared > 0 AND n_shared < n_chunks").select(*columns)
    pure = lists.filter("n_shared > 0 AND n_shared = n_chunks").select(*columns).dropDuplicates(["media_sha256"])
    wanted = mixed.unionByName(pure)
    asked = wanted.select("media_sha256", F.posexplode("parts").alias("pos", "part")).filter("part.data IS NULL").select("media_sha256", "pos", F.col("part.digest").alias("digest"))
    held = store.filter("kind = 1").groupBy("digest").agg(F.first("data").alias("data"))
    got = asked.join(respread(held, "digest"), "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("pos", "data")).alias("got"))
    built = wanted.join(got, "media_sha256").select(*columns, "got").mapInArrow(assemble, READ).drop("doc_id", "n_bytes")
    copies = lists.filter("n_shared > 0").select("doc_id", "n_bytes", "media_sha256").join(built, "media_sha256")
    return plain.unionByName(copies.select(plain.columns))


def media_column(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs as media in the shared folder and returns what is read back."""
    path = shared_path(docs.sparkSession, "media")
    write_store(docs, path)
    return read_store(docs.sparkSession, path)
