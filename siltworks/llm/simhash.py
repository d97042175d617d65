"""SimHash near-duplicates by the general pigeonhole principle (Qin et al., 2018).

Fingerprints are majority votes of the XXH64 hashes of word shingles. Two fingerprints within `radius` bits agree, for
thresholds T that sum to radius - m + 1 at least, to within T[i] bits in some partition i of m; a threshold of -1
leaves a partition out. Here

1. the counts of all pairs of bits give their correlations, and correlated bits are grouped into m partitions;
2. histograms of the partitions' values over all distinct fingerprints give estimates of candidate pairs, and dynamic
   programming allocates the thresholds (and m) of least estimated cost;
3. every distinct fingerprint is sent to the keys within T[i] / 2 bits of its value in each partition, so that two
   fingerprints within T[i] bits meet at a key;
4. what meets at a key is verified on the whole fingerprint, and only a star of each key's linked groups leaves the
   task, so that a group of n near copies gives some n links a key rather than n * n;
5. components follow by large-star and small-star sweeps.

Copies share one fingerprint and are joined back at the end; they are never expanded into pairs. A key with more than
BLOCK fingerprints is dealt to blocks of them and every two blocks meet in a group of their own, so no task gathers an
unbounded group and no pair is lost.

For filtering (keep_one) a node is a set of distinct shingles, so texts of one node have similarity 1, and its fingerprint
is the vote of the distinct shingles, so that a repeated line counts once. Steps 1 to 4 give the links within KEEP_RADIUS
bits. A fingerprint of few shingles changes in many bits with one of them, so nodes meet
in bands of MinHash values too: two sets share a value with a chance of exactly their Jaccard
similarity, whatever their sizes. Every link is verified by the exact similarity. Nodes that meet in
a band are compared with the smallest and largest node there, which costs one row a node. The pairs left in groups
that this doesn't connect are compared where the shingles of their documents meet, in blocks of bounded size; the task
that holds two blocks verifies their pairs exactly and sends out a link for each two groups that it connects.

Edge cases: null text counts as empty; texts with fewer words than a shingle are one shingle; texts without words have
fingerprint zero and link like any other; repeated rows give repeated results; null doc_ids are never a component's
smallest doc_id unless there is no other (then it is null); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import ASCII_LOWER, checkpointed, counted, few, free_name, release_shuffles, respread, small_batches, text_or_empty
from siltworks.llm.components import stars

#: Fingerprints that may meet in one group of a key.
BLOCK = 20_000
#: Shingles in one block of a crowded group, 8 bytes each; a task holds two blocks at a time.
BLOCK_SHINGLES = 4_000_000
#: Bits of a partition's value that histograms keep; the rest is taken as independent.
PREFIX = 12
#: Cost of a row sent to a key, in comparisons of two fingerprints.
ROW_COST = 500.0
PARTS = (2, 3, 4, 5, 6)
_h64 = functools.partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, repeats included."""
    split = text.encode().translate(ASCII_LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= size:
        return np.array([_h64(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(split) - size + 1].tolist()
    return np.fromiter((_h64(joined[s:e]) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _remix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = h + np.uint64((word * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, size: int = 3) -> int:
    """A signed 64-bit number; bit b is set if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, size))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)[0])


def text_hash() -> Column:
    """Tells the texts of rows of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and f0 of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t or "", size) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "f0"])

    part = docs.select("doc_id", "text")
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, f0 long")


def _bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and the 64 x 64 counts of bits of f0 that are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*cells, 64 * 64], pa.int64()), pa.array([*total.ravel()[cells], rows], pa.int64())], names=["cell", "n"])

    both = np.zeros(64 * 64 + 1, np.int64)  # the last is the number of nodes
    for r in nodes.select("f0").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        both[r[0]] = r[1]
    return int(both[-1]), both[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits, grown one after the other by the bit most correlated with what is in."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = list(range(64)), []
    for i in range(m):
        width = len(free) // (m - i)
        sums = tie[np.ix_(free, free)].sum(axis=1)
        part = [free.pop(int(np.argmax(sums)))]
        while len(part) < width:
            part.append(free.pop(int(np.argmax(tie[np.ix_(free, part)].sum(axis=1)))))
        out.append(sorted(part))
    return out


def values(f0: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each fingerprint, packed with the first as the lowest."""
    out = np.zeros(len(f0), np.int64)
    for at, bit in enumerate(bits):
        out |= ((f0.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def _pairs(hist: np.ndarray, rest: list[float], most: int) -> list[float]:
    """Estimated pairs of fingerprints at distance 0, 1, ... in a partition, from the histogram of its prefix."""
    width, at = int(math.log2(len(hist))), np.arange(len(hist))
    near = [float(sum((hist * hist[at ^ sum(1 << b for b in s)]).sum() for s in itertools.combinations(range(width), k))) / 2 if k < 3 else float(hist.sum()) ** 2 / 2 * math.comb(width, k) / 2**width for k in range(most + 1)]
    shares = [1.0]
    for q in rest:  # of the chance that so many of the other bits differ
        shares = [(shares[k] if k < len(shares) else 0) * (1 - q) + (shares[k - 1] * q if k else 0) for k in range(len(shares) + 1)]
    return [sum(near[a] * shares[k - a] for a in range(k + 1) if k - a < len(shares)) for k in range(most + 1)]


#: Thresholds and the radius of the balls of keys that find them.
STEPS = {-1: None, 0: 0, 2: 1, 4: 2}


def allocate(n: int, parts: list[list[int]], hists: list[np.ndarray], p: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """(estimated cost, thresholds) by dynamic programming over the partitions; the thresholds sum to radius - m + 1 at least."""
    need = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, hist in zip(parts, hists, strict=True):
        pairs = _pairs(hist, [2 * p[b] * (1 - p[b]) for b in bits[PREFIX:]], 4)
        price = {-1: 0.0}
        for t, r in STEPS.items():
            if r is not None:
                met = pairs[0] * ball(len(bits), r) + (2 * (pairs[1] + pairs[2]) if r == 1 else 0) + (6 * sum(pairs[1:]) * len(bits) if r == 2 else 0)
                price[t] = n * ball(len(bits), r) * ROW_COST + met
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, add in price.items():
                k = min(total + t, max(need, 0) + len(parts))
                if k not in new or cost + add < new[k][0]:
                    new[k] = (cost + add, [*chosen, t])
        best = new
    fit = [x for k, x in best.items() if k >= need and any(t >= 0 for t in x[1])]
    return min(fit) if fit else (math.inf, [])


def plan(nodes: DataFrame, radius: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """(partitions in use with the radius of their keys, blocks of each heavy value)."""
    n, both = _bit_counts(nodes)
    options = {m: group_bits(n, both, m) for m in PARTS}
    flat = [(m, i, bits) for m, parts in options.items() for i, bits in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(flat), 1 << PREFIX), np.int64)
        for batch in batches:
            f0 = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for k, (_, _, bits) in enumerate(flat):
                held[k] += np.bincount(values(f0, bits[:PREFIX]), minlength=1 << PREFIX)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(held.ravel()[cells], pa.int64())], names=["cell", "n"])

    hist = np.zeros(len(flat) << PREFIX)
    for r in nodes.select("f0").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        hist[r[0]] = r[1]
    hist = hist.reshape(len(flat), -1)
    p = np.diag(both) / max(n, 1)
    costs = {m: allocate(n, parts, [hist[k][: 1 << min(PREFIX, len(b))] for k, (o, _, b) in enumerate(flat) if o == m], p, radius) for m, parts in options.items()}
    m = min(costs, key=lambda k: costs[k][0])
    used = [(bits, STEPS[t]) for bits, t in zip(options[m], costs[m][1], strict=True) if t >= 0]
    heavy: dict[int, int] = {}
    widest = max(ball(len(bits), r) for bits, r in used)
    prefix_rows = [(k, i) for k, (o, i, _) in enumerate(flat) if o == m and costs[m][1][i] >= 0]
    if any(hist[k].max() * widest > BLOCK for k, _ in prefix_rows):
        heavy = _heavy_keys(nodes, used)
    return used, heavy


def _key_rows(f0: np.ndarray, used: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows) of all keys of fingerprints; a key holds the partition above its value."""
    rows = np.arange(len(f0))
    for i, (bits, r) in enumerate(used):
        at = values(f0, bits)
        for k in range(r + 1):
            for flips in itertools.combinations(range(len(bits)), k):
                yield (at ^ sum(1 << b for b in flips)) | (i << 40), rows


def _heavy_keys(nodes: DataFrame, used: list[tuple[list[int], int]]) -> dict[int, int]:
    """Keys with more than BLOCK fingerprints and their number of blocks; there are at most rows / BLOCK of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0 = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for keys, _ in _key_rows(f0, used):
                kinds, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n, pa.int64())], names=["key", "n"])

    found = nodes.select("f0").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK).collect()
    return {r[0]: math.ceil(r[1] / BLOCK) for r in found}


def _linked(f: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether the fingerprints a and b (row numbers of f) are within radius bits."""
    return np.bitwise_count(f[a] ^ f[b]) <= radius


def _sweep(f: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(smallest, the others) of each linked group of two and more of the rows of f, which are in order."""
    left = np.arange(len(f))
    while len(left):
        root, queue, left, got = left[0], [left[0]], left[1:], []
        while queue and len(left):
            hit = _linked(f, np.full(len(left), queue.pop()), left, radius)
            new = left[hit]
            left = left[~hit]
            queue += new.tolist()
            got.append(new)
        members = np.concatenate(got) if got else np.zeros(0, np.int64)
        if len(members):
            yield root, members


def _group_links(nodes: np.ndarray, f: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that connect the fingerprints that met at a key, as far as they are within radius bits."""
    nodes, first = np.unique(nodes, return_index=True)  # nodes are in order from here on
    f = f[first]
    if len(nodes) <= 512:
        a, b = np.triu_indices(len(nodes), 1)
        near = _linked(f, a, b, radius)
        if near.sum() <= len(nodes):
            return [(nodes[b[near]], nodes[a[near]])] if near.any() else []
    return [(nodes[members], np.full(len(members), nodes[root])) for root, members in _sweep(f, radius)]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of nodes (node, f0) that together connect all within radius bits."""
    used, heavy = plan(nodes, radius)
    weighty = np.array(sorted(heavy), np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, f = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)

            def batch_of(keys: np.ndarray, groups: np.ndarray, rows: np.ndarray, ids: np.ndarray = ids, f: np.ndarray = f) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(groups.astype(np.int32)), pa.array(ids[rows]), pa.array(f[rows])], names=["key", "pair", "node", "f0"])

            for keys, rows in _key_rows(f, used):
                hot = np.isin(keys, weighty) if len(weighty) else np.zeros(len(keys), bool)
                if not hot.all():
                    yield batch_of(keys[~hot], np.zeros((~hot).sum()), rows[~hot])
                if hot.any():
                    n = np.array([heavy[k] for k in keys[hot].tolist()])
                    mine = np.array([_h64(int(i).to_bytes(8, "little", signed=True)) for i in ids[rows[hot]]], np.uint64) % n.astype(np.uint64)
                    at = np.repeat(np.arange(len(n)), n)  # a row for each block that its own one meets
                    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    low, high = np.minimum(mine[at].astype(np.int64), other), np.maximum(mine[at].astype(np.int64), other)
                    yield batch_of(keys[hot][at], low * n[at] + high, rows[hot][at])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
            key, pair, node, f = held
            change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            edges = np.concatenate([[0], change, [len(key)]])
            if not last:
                edges = edges[:-1]
            out = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s == 2:
                    if node[s] != node[s + 1] and int(f[s] ^ f[s + 1]).bit_count() <= radius:
                        out.append((node[s : s + 1], node[s + 1 : e]))
                elif e - s > 2:
                    out += _group_links(node[s:e], f[s:e], radius)
            return [x[edges[-1] :] for x in held], out

        made = lambda out: pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["a", "b"])
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            now[3] = now[3].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            held, out = flush(held, False)
            if out:
                yield made(out)
        if held is not None and len(held[0]):
            _, out = flush(held, True)
            if out:
                yield made(out)

    sent = nodes.select("node", "f0").mapInArrow(send, "key long, pair int, node long, f0 long")
    return sent.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(meet, "a long, b long")


def members(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with component: the smallest id of those connected to its own node; roots as stars() gives them."""
    joined = nodes.select("node", "first").join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    member = joined.join(respread(smallest, "root"), "root").select("node", "component")
    return rows.join(respread(member, "node"), "node").drop("node")


def link_rows(rows: DataFrame, radius: int) -> DataFrame:
    """rows (id, f0) with component, over links within radius bits; a fingerprint is its own node."""
    rows = rows.withColumn("node", F.col("f0"))
    nodes = checkpointed(rows.groupBy("node").agg(F.first("f0").alias("f0"), F.min("id").alias("first")))
    return members(rows, nodes, stars(links(nodes, radius)))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    rows = checkpointed(fingerprints(docs, size).select(F.col("doc_id").alias("id"), "f0"))
    out = link_rows(rows, radius)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Near-duplicates for filtering: words in a shingle, least Jaccard similarity, bits between fingerprints of candidates.
KEEP_SIZE, KEEP_SHARE, KEEP_RADIUS = 5, 0.8, 3
#: Bands and MinHash values in each. Sets of similarity 0.8 share no band with a chance of (1 - 0.8^5)^40 = 1.3e-7.
BANDS, BAND_ROWS = 40, 5
_MIX = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), np.uint32)
_MIX[0] |= np.uint32(1)


def node_and_bands(text: str) -> tuple[int, int | None, np.ndarray]:
    """(a number for the set of distinct shingles, its fingerprint, a key for each band of its MinHash values); without shingles no fingerprint and no keys."""
    h = np.unique(shingle_hashes(text, KEEP_SIZE))
    if not len(h):
        return 0, None, np.zeros(0, np.int64)
    node = np.array([_h64(h.tobytes())], np.uint64).view(np.int64)
    x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _MIX[0] + _MIX[1]).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = _remix(keys * np.uint64(0x9E3779B97F4A7C15) + column, 1)
    return int(node[0]), majority(h), keys.view(np.int64)


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, row (text_hash()), node, f0 (its fingerprint) and bands of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [node_and_bands(t or "") for t in batch.column(1).to_pylist()]
            node, f0, bands = (pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, f0, bands], names=["doc_id", "row", "node", "f0", "bands"])

    part = docs.select("doc_id", "text", text_hash().alias("row"))
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, row long, node long, f0 long, bands array<long>")


def shingle_sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the distinct shingles' hashes of the first document of each node in ends."""
    wanted, n = counted(ends.join(nodes, "node").select("node", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row")))
    texts = docs.select("doc_id", "text", text_hash().alias("hash")).join(few(wanted, n=n), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pa.array([np.unique(shingle_hashes(text or "", size)).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), found], names=["node", "shingles"])

    return checkpointed(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, shingles array<long>"))


def similar(edges: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The edges (a, b) of nodes with at least `share` of their distinct shingles in common."""
    both = edges.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return both.filter(shared >= share * (F.size("left") + F.size("right") - shared)).select("a", "b")


def verify_group(nodes: np.ndarray, label: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what exact similarity connects among nodes, as far as labels don't connect it already.

    shingles: the distinct ones of each node, one node after the other. Once two labels are linked they are one, so a
    group of similar texts is done in one pass.
    """
    kinds, label = np.unique(label, return_inverse=True)
    words, flat = np.unique(shingles, return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(words), bool)
    of_bulk = label == np.argmax(np.bincount(label, minlength=len(kinds)))
    bulk, others = np.flatnonzero(of_bulk), np.flatnonzero(~of_bulk)
    a, b = [], []
    for at, row in enumerate(others):
        rest = others[at + 1 :]
        rest = rest[label[rest] != label[row]]
        if label[bulk[0]] != label[row]:
            rest = np.concatenate([bulk, rest])
        hit = rest[np.minimum(sizes[rest], sizes[row]) >= share * np.maximum(sizes[rest], sizes[row])]
        if not len(hit):
            continue
        n = sizes[hit]
        own = flat[starts[row] : starts[row] + sizes[row]]
        mark[own] = True
        met = mark[flat[np.repeat(starts[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        mark[own] = False
        shared = np.bincount(np.repeat(np.arange(len(hit)), n)[met], minlength=len(hit))
        hit = hit[shared >= share * (sizes[row] + n - shared)]
        for kind, first in zip(*np.unique(label[hit], return_index=True), strict=True):
            a.append(nodes[row])
            b.append(nodes[hit[first]])
            label[label == kind] = label[row]
    return np.array(a, np.int64), np.array(b, np.int64)


def settle(crowded: DataFrame, sets: DataFrame, roots: DataFrame, share: float = KEEP_SHARE) -> DataFrame:
    """(a, b): links among the nodes of each crowded group (node, group) by verify_group(), in pairs of blocks."""
    sizes = sets.select("node", F.size("shingles").alias("n"))  # before the join, which else would carry the sets
    known = crowded.join(sizes.join(roots.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "n"), "node")
    blocks = known.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.min("label").alias("one"), F.max("label").alias("two"))
    blocks = blocks.filter("one <> two").select("group", F.greatest("blocks", F.lit(1)).alias("blocks"))
    mine, other = F.pmod(F.xxhash64("node"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = known.join(blocks, "group").select("node", "label", "group", mine.alias("mine"), other)
    dealt = checkpointed(dealt.select("node", "label", "group", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")))
    useful = dealt.groupBy("group", "low", "high").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one <> two").select("group", "low", "high")
    met = dealt.join(useful, ["group", "low", "high"]).join(sets, "node").select("group", "low", "high", "node", "label", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            sizes = np.array([len(r[-1]) for r in rows], np.int64)
            a, b = verify_group(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.concatenate([r[-1] for r in rows]), sizes, share)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        group, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            lists = batch.columns[-1]
            for i, (*key, node, label) in enumerate(zip(*columns, strict=True)):
                if key != group and rows:
                    yield done(rows)
                    rows = []
                group = key
                rows.append((node, label, lists[i].values.to_numpy()))
        if rows:
            yield done(rows)

    return met.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that roots, as stars() gives them, don't connect."""
    both = pairs.join(roots.toDF("a", "of_a"), "a", "left").join(roots.toDF("b", "of_b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def connect(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of all nodes (node, first, f0, bands) connected over near-duplicate pairs, as stars() gives them."""
    spark = nodes.sparkSession
    near = checkpointed(links(nodes.filter("f0 IS NOT NULL").select("node", "f0"), KEEP_RADIUS))
    release_shuffles(spark)
    bands = nodes.select("node", F.explode("bands").alias("group"))
    ends = bands.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("n > 1")
    met = checkpointed(bands.join(ends, "group"))
    sets = shingle_sets(met.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), nodes, docs, KEEP_SIZE)
    release_shuffles(spark)
    first = met.groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b")).filter("a <> b")
    roots = stars(similar(near.unionByName(first).distinct(), sets, KEEP_SHARE))
    release_shuffles(spark)
    star = met.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    apart, n = counted(across(star.distinct(), roots))
    if n:
        release_shuffles(spark)
        roots = stars(roots.unionByName(similar(apart, sets, KEEP_SHARE)))
    release_shuffles(spark)
    settled, n = counted(settle(met.filter("n > 2").select("node", "group"), sets, roots))
    release_shuffles(spark)
    return stars(roots.unionByName(settled)) if n else roots


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but the document of the smallest doc_id of each group of near-duplicates; columns as they are."""
    columns = docs.columns
    made = checkpointed(banded(docs))
    rows = made.select(F.struct("doc_id", "row").alias("id"), "node", "f0", "bands")
    nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("f0").alias("f0"), F.first("bands").alias("bands")))
    grouped = members(rows.select("id", "node"), nodes, connect(nodes, docs))
    doc, row, mark = (free_name(docs, n) for n in ("_gone_doc", "_gone_row", "_text_hash"))
    gone = grouped.filter(F.col("component") != F.col("id")).select(F.col("id.doc_id").alias(doc), F.col("id.row").alias(row)).distinct()
    tagged = docs.withColumn(mark, text_hash())
    left = tagged.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(row)), "left_anti")
    if made.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", mark])
    return left.select(*columns)
