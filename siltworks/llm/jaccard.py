"""Near-duplicates by a join on rare n-grams (prefix filtering; Chaudhuri et al., 2006, Xiao et al., 2008).

Two documents link when the Jaccard similarity of their sets of distinct word shingles is `percent` / 100 or more. Sets
are ordered rare shingles first, by counts over all documents. If |x & y| has to be at least percent * |x| / 100, x and
y share a shingle among the first |x| - that + 1 of x and likewise of y (their prefixes), so it is enough to

1. count shingles: each task counts into an array of CELLS cells, the arrays are added up by segments and broadcast as
   classes of four bits (the size of the array is fixed; fuller cells weaken the order, never the result);
2. send the prefixes of one document of each distinct set, leaving out shingles that stand alone in their cell: those are
   in one document;
3. join nodes (distinct sets) on prefix shingles under the length filter, the positional filter (what can still follow
   after both positions is enough) and the suffix filter (the parts after both positions, counted in 8 fixed ranges of
   hashes, don't differ too much);
4. verify each pair that is left once, on the whole sets.

The result is each document's class over links, so pairs within a class are needed only as far as they connect it. For a
shingle of up to SMALL nodes all pairs are candidates. One of more nodes pairs each node with the smallest and the
largest there; what that leaves apart is compared in blocks of bounded size, each pair of blocks in a task, which sends
out a link for each two classes it joins. No pair is lost, and a family of n near copies costs some n rows a shingle.

Edge cases: fewer words than a shingle make one shingle of the whole sequence; texts that are null or without words have
an empty set and link with nothing; equal sets link, whatever their texts; rows of one doc_id are documents of their
own; a null doc_id is a class's smallest only if there is no other; an empty table gives an empty result; other columns
are not read. Sets are told apart by 64-bit hashes, shingles likewise.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, few, release_shuffles, respread, small_batches, text_or_empty
from siltworks.llm.components import stars
from siltworks.llm.simhash import members, settle, similar

#: Words in a shingle and least similarity in hundredths.
SIZE, PERCENT = 5, 80
#: Cells of the array of counts (a byte each in a task, half of one when broadcast: 32 MB) and of a segment of it.
CELL_BITS, SEGMENT_BITS = 26, 16
#: Parts in which the array comes to the driver.
PARTS = 8
#: Nodes of a prefix shingle of which all pairs are candidates.
SMALL = 32
#: Upper ends of the classes of counts; a count over the last is in class 15.
CLASSES = np.array([0, 1, 2, 3, 7, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191])
_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_h64 = functools.partial(xxhash.xxh64_intdigest, seed=7)


_POWER = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(6).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTER[~_IN_WORD] = 0
#: Bytes that are hashed at a time.
PIECE = 1 << 18


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    out = []
    for base in (_POWER, pow(_POWER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and of the end) of texts that lie one after the other.

    data: the bytes; edges: where each text starts, and the end. A word's hash is the sum of its letters' numbers times
    powers of their places, so all words are done by a few passes over the bytes.
    """
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        s, e = starts[at], starts[to] if to < len(starts) else len(data)
        forth, back = _powers(1 << max(18, int(e - s - 1).bit_length()))
        part = _LETTER[data[s:e]] * forth[: e - s]
        local = starts[at:to] - s
        out[at:to] = np.add.reduceat(part, local) * back[local]
        at = to
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(starts, edges)


def combined(h: np.ndarray, wide: int) -> np.ndarray:
    """A hash of each `wide` consecutive words."""
    at = len(h) - wide + 1
    x = np.full(at, wide, np.uint64) * _SEEDS[-1]
    for i in range(wide):
        x += h[i : i + at] * _SEEDS[i]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    x = np.sort(h)
    kept = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=kept[1:])
    return x[kept]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its distinct shingles, in ascending order."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    h, first = word_hashes(body, edges - edges[0])
    every = combined(h, size) if len(h) >= size else h[:0]
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= size:
            yield distinct(every[s : e - size + 1])
        else:
            yield combined(h[s:e], e - s) if e > s else h[:0]


def set_id(shingles: np.ndarray) -> int:
    """A number for a set, as a signed 64-bit one."""
    return int(np.array([_h64(shingles.tobytes())], np.uint64).view(np.int64)[0])


def shared_at_least(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with a similar one."""
    return -(-percent * n // 100)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity(texts: DataFrame, size: int) -> bytes:
    """The class of each cell's count of texts (a column) that have a shingle in it, two classes in a byte, the first the higher."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << CELL_BITS, np.uint8)
        for batch in batches:
            for x in shingle_sets(batch.column(0), size):
                cells = _cells(x)
                now = held[cells]
                held[cells] = now + (now < 255)
        for s in range(1 << (CELL_BITS - SEGMENT_BITS)):
            part = held[s << SEGMENT_BITS : (s + 1) << SEGMENT_BITS]
            used = np.flatnonzero(part)
            if len(used):
                steps = np.diff(used, prepend=0).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "steps": [zlib.compress(steps.tobytes(), 1)], "counts": [zlib.compress(part[used].tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(s: int, total: np.ndarray) -> pa.RecordBatch:
            kinds = np.searchsorted(CLASSES, total).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "classes": [(kinds[::2] << 4 | kinds[1::2]).tobytes()]})

        now, total = None, np.zeros(1 << SEGMENT_BITS, np.int64)
        for batch in batches:
            for s, steps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now and now is not None:
                    yield done(now, total)
                    total[:] = 0
                now = s
                total[np.cumsum(np.frombuffer(zlib.decompress(steps), np.uint16), dtype=np.int64)] += np.frombuffer(zlib.decompress(counts), np.uint8)
        if now is not None:
            yield done(now, total)

    pieces = texts.mapInArrow(count, "segment int, steps binary, counts binary")
    out = np.zeros(1 << (CELL_BITS - 1), np.uint8)
    merged = pieces.repartition(PARTS, "segment").sortWithinPartitions("segment").mapInArrow(add, "segment int, classes binary")
    for s, classes in merged.toLocalIterator(prefetchPartitions=True):  # of fixed size, and a part at a time
        at = s << (SEGMENT_BITS - 1)
        out[at : at + len(classes)] = np.frombuffer(classes, np.uint8)
    return out.tobytes()


def classes_of(shingles: np.ndarray, packed: np.ndarray) -> np.ndarray:
    cells = _cells(shingles)
    both = packed[cells >> 1]
    return np.where(cells & 1, both & 15, both >> 4)


def numbered_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node (the number of its set; null without words) and n (shingles in the set) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(set_id(x) if len(x) else None, len(x)) for x in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())], names=["doc_id", "node", "n"])

    part = docs.select("doc_id", "text")
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, node long, n long")


def ranges(suffixes: np.ndarray) -> np.ndarray:
    """8 counts of 16 bits, packed into two longs a row; counts over 65,535 stay there, which only weakens the filter."""
    x = np.minimum(suffixes, 65_535).astype(np.uint64)
    shift = np.array([0, 16, 32, 48], np.uint64)
    return np.stack([(x[:, :4] << shift).sum(axis=1, dtype=np.uint64), (x[:, 4:] << shift).sum(axis=1, dtype=np.uint64)], axis=1).view(np.int64)


def prefixes(texts: DataFrame, size: int, percent: int, shipped: Broadcast) -> DataFrame:
    """(shingle, node, n, pos, s0, s1): the prefix of each distinct set; s0, s1: the counts of what follows pos by ranges of hashes.

    Texts of one set give rows once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, packed = set(), np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for x in shingle_sets(batch.column(0), size):
                if not len(x) or (node := set_id(x)) in done:
                    continue
                done.add(node)
                kinds = classes_of(x, packed)
                order = np.argsort(kinds.astype(np.uint64) << np.uint64(60) | x >> np.uint64(4), kind="stable")
                n, most = len(x), len(x) - shared_at_least(len(x), percent) + 1
                sent = np.flatnonzero(kinds[order[:most]] > 1)
                if not len(sent):
                    continue
                region = x.astype(np.int64) & 7
                after = np.bincount(region, minlength=8) - np.cumsum(region[order[:most], None] == np.arange(8), axis=0)
                s = ranges(after[sent])
                out.append([x[order[sent]].view(np.int64), np.full(len(sent), node), np.full(len(sent), n), sent, s[:, 0], s[:, 1]])
                if sum(len(o[0]) for o in out[-50:]) > 100_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return texts.mapInArrow(run, "shingle long, node long, n int, pos int, s0 long, s1 long")


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=["shingle", "node", "n", "pos", "s0", "s1"])


def filters(a: str, b: str, percent: int) -> Column:
    """Whether two prefix rows (structs) may be of similar sets, by length, positions and suffixes.

    At their first common prefix shingle similar sets pass all three; a pair that passes at none isn't similar.
    """
    n, m, i, j = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in (a, b))
    need = F.floor(((n + m) * percent + 99 + percent) / (100 + percent))  # the least whole number of at least percent * (n + m) / (100 + percent)
    length = (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)
    positional = F.least(n - i, m - j) >= need
    parts = [F.shiftright(F.col(f"{x}.{s}"), 16 * k).bitwiseAND(65_535) for s in ("s0", "s1") for k in range(4) for x in (a, b)]
    differ = functools.reduce(Column.__add__, [F.abs(p - q) for p, q in zip(parts[::2], parts[1::2], strict=True)])
    return length & positional & (differ <= n + m - 2 * need - i - j)


def pair(a: str, b: str) -> list[Column]:
    return [F.greatest(f"{a}.node", f"{b}.node").alias("a"), F.least(f"{a}.node", f"{b}.node").alias("b")]


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, repeated: bool) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one document of each; repeated: whether a doc_id has rows of one set."""
    of = checkpointed(wanted.join(nodes.select("node", "first"), "node"))
    texts = docs.select("doc_id", "text").join(few(of), F.col("doc_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True))
            made = [(node, x.view(np.int64)) for node, x in made if set_id(x) == node]  # rows of one doc_id may have other texts
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["node", "shingles"])

    found = texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    return checkpointed(found.dropDuplicates(["node"]) if repeated else found)


def candidates(sent: DataFrame, percent: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b that pass the filters, members node, group of shingles with over `small` nodes) of prefix rows."""
    row = F.struct("node", "n", "pos", "s0", "s1")
    # Most shingles that share a cell are in one set alone: they go before the wide rows are grouped.
    shared = checkpointed(sent.groupBy("shingle").agg(F.count("*").alias("met")).filter("met > 1"))
    release_shuffles(sent.sparkSession)
    # The lookup is made once and gives the number of sets too, so that only crowded shingles need their ends.
    met = checkpointed(sent.join(few(shared), "shingle").select("shingle", row.alias("x"), "met"))
    release_shuffles(sent.sparkSession)
    few_met, many = met.filter(F.col("met") <= small), met.filter(F.col("met") > small)
    listed = few_met.groupBy("shingle").agg(F.collect_list("x").alias("xs"))  # `small` rows at most
    close = listed.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y"))
    close = close.filter("x.node < y.node").filter(filters("x", "y", percent)).select(*pair("x", "y"))
    ends = many.groupBy("shingle").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low.node <> high.node")
    star = many.join(respread(ends, "shingle"), "shingle").select("x", F.explode(F.array("low", "high")).alias("y"))
    star = star.filter("x.node <> y.node").filter(filters("x", "y", percent)).select(*pair("x", "y"))
    # Shingles with the same nodes make the same pairs: one of them is enough.
    told = many.groupBy("shingle").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x.node")).alias("h"), F.min("x.node").alias("least"), F.max("x.node").alias("most"))
    one = told.groupBy("n", "h", "least", "most").agg(F.min("shingle").alias("group")).select("group")
    crowded = many.select(F.col("x.node").alias("node"), F.col("shingle").alias("group")).join(respread(one, "group"), "group", "left_semi")
    return checkpointed(close.unionByName(star).distinct()), checkpointed(crowded.select("node", "group"))


def connect(docs: DataFrame, nodes: DataFrame, size: int, percent: int, repeated: bool) -> DataFrame:
    """(a, b) of all nodes that link, as stars() gives them."""
    spark, share = docs.sparkSession, percent / 100 - 1e-12  # shares of sets differ by more, and equality is enough
    texts = docs.select(text_or_empty().alias("text"))
    shipped = spark.sparkContext.broadcast(rarity(texts, size))
    # Copies of a set don't go again from each task that has one; other rows of a chosen doc_id may, which changes nothing.
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(few(nodes.select("first")), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    sent = checkpointed(prefixes(chosen.select("text"), size, percent, shipped))
    shipped.destroy()
    release_shuffles(spark)
    pairs, crowded = candidates(sent, percent)
    del sent  # its checkpoint goes with the next collection
    release_shuffles(spark)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    sets = sets_of(ends, nodes, docs, size, repeated)
    release_shuffles(spark)
    roots = stars(similar(pairs, sets, share))
    if crowded.limit(1).count():
        release_shuffles(spark)
        settled = checkpointed(settle(crowded, sets, roots, share))
        if settled.limit(1).count():
            return stars(roots.unionByName(settled))
    return roots


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) of every row."""
    rows = checkpointed(numbered_sets(docs, size))
    with_words = rows.filter("n > 0")
    nodes = checkpointed(with_words.groupBy("node").agg(F.min("doc_id").alias("first")))
    repeated = with_words.groupBy("doc_id", "node").count().filter("count > 1").limit(1).count() > 0
    found = members(with_words.select(F.col("doc_id").alias("id"), "node", "n"), nodes, connect(docs, nodes, size, percent, repeated))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(empty)
