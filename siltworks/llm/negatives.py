"""Hard negatives by dual-tree search over inner products (Ram and Gray, 2012; Curtin et al., 2013).

Vectors become integers and a score is an exact integer. The tree over all rows has three stages: labels, cells (a tree
of coordinate medians, fitted on a bounded sample of vectors; every row is put into a cell) and blocks of a cell of at
most BLOCK_ROWS rows, each with a tree of balls of its own. The tree over anchors likewise: groups of at most
GROUP_ROWS anchors of a label and cell, halved down to ANCHOR_LEAF. From two balls follows an interval of all their
inner products: that of the centres, give or take |a| * r + |b| * s + r * s. So

1. each group takes the block of its label with the best centre first, which gives each anchor a bound of its worst
   positive;
2. the groups' balls meet the blocks' balls, chunk by chunk (CHUNK of each in a task, so the pairs of all of them are
   never a table), and a block that no anchor of the group can use is pruned for the whole group at once;
3. a pair that is left descends both trees in one task; leaves that are left are scored exactly. Each task sends at most
   k rows an anchor and block, and a window keeps the first k of all;
4. the same again for the negatives: of the best block of another label first, then of all whose interval meets the
   range of scores that some positive of the group asks for and can still be among the first.

A block meets its groups in runs of at most RUN, so that a block that all groups need is split among tasks.

Edge cases: rows with a null vec_id or label, a null vector or any null or non-finite component take no part; of rows of
one vec_id the one with the smallest label, then vector, counts; a shorter vector counts as padded with zeros; ties go
to the smaller vec_id, a third of all rows alike included; an anchor without another row of its label gives no rows, a
positive without a negative in its range none either; scores beyond 64 bits are exact in comparisons and are returned as
the nearest long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, few, release_shuffles, small_batches

#: Rows that the cells are fitted on, and levels of that tree at most.
SAMPLE, CELL_LEVELS = 8192, 8
#: Rows of a block, of a leaf of its tree, anchors of a group and of a leaf of its tree.
BLOCK_ROWS, LEAF, GROUP_ROWS, ANCHOR_LEAF = 8192, 64, 256, 16
#: Balls of groups and of blocks that meet in one task; groups that meet a block in one.
CHUNK, RUN = 512, 64
#: Share of a score's size that floating-point intervals are widened by.
SLACK = 1e-9
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's, from and to.
LOW, HIGH = 30, 90
_LONG = (1 << 63) - 1


def usable(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label and vector (doubles) of the rows that take part, one an id."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL").filter(F.col("vector").isNotNull())
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # Spark has NaN above all
    return rows.filter(whole).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("one")).select("id", "one.label", "one.vector")


def integers(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 * x), a row for each vector, shorter ones padded with zeros; whole numbers held as doubles."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * 256), -np.finfo(float).max, np.finfo(float).max)


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The vectors in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _as_one_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b: longs, or Python numbers where they could be beyond 2^53."""
    a, b = _as_one_width(a, b)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(v) for v in row] for row in a.tolist()], [[int(v) for v in row] for row in b.tolist()]
    return np.array([[sum(p * q for p, q in zip(r, s, strict=True)) for s in exact[1]] for r in exact[0]], object).reshape(len(a), len(b))


class Balls:
    """A tree of balls over rows: node k has the rows start[k] to end[k] and the children 2k + 1 and 2k + 2, if any."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.levels = max(0, math.ceil(math.log2(max(len(x), 1) / leaf)))
        edges = [(0, len(x))]
        for k in range((1 << self.levels) - 1):
            s, e = edges[k]
            edges += [(s, (s + e) // 2), ((s + e) // 2, e)]
        self.edges = edges
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = np.array([x[s:e].mean(axis=0) if e > s else np.zeros(x.shape[1]) for s, e in edges])
            self.radius = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(axis=1)).max(initial=0) for (s, e), c in zip(edges, self.centre, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def is_leaf(self, k: int) -> bool:
        return 2 * k + 1 >= len(self.edges)


def in_tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which the halves of halves are near each other: medians along the widest coordinate."""
    order, todo = np.arange(len(x)), [(0, len(x), max(0, math.ceil(math.log2(max(len(x), 1) / leaf))))]
    while todo:
        s, e, levels = todo.pop()
        if not levels or e - s < 2 or not x.shape[1]:
            continue
        part = x[order[s:e]]
        along = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        order[s:e] = order[s:e][np.argsort(along, kind="stable")]
        mid = (s + e) // 2
        todo += [(s, mid, levels - 1), (mid, e, levels - 1)]
    return order


def interval(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that rows of two balls (centres, norms, radii) can have; a row for each of a."""
    ca, cb = _as_one_width(a[0], b[0])
    with np.errstate(over="ignore", invalid="ignore"):
        mid, give = ca @ cb.T, np.outer(a[1], b[2]) + np.outer(a[2], b[1]) + np.outer(a[2], b[2])
        give = give + (np.outer(a[1] + a[2], b[1] + b[2]) * SLACK + 1e-6)
        low, high = mid - give, mid + give
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)  # NaN: nothing is known


def cells_of(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each row: splits are (coordinate, limit) of the nodes of a full binary tree."""
    at = np.zeros(len(x), np.int64)
    if not splits:
        return at
    along, limit = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    x = np.pad(x, ((0, 0), (0, max(0, int(along.max()) + 1 - x.shape[1]))))
    for _ in range((len(splits) + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[np.arange(len(x)), along[at]] > limit[at])
    return at - len(splits)


def fit_splits(x: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Splits of the sample at medians of the coordinate that spreads most."""
    splits, parts = [], [np.arange(len(x))]
    for _ in range(levels):
        new = []
        for p in parts:
            along = int(np.argmax(x[p].var(axis=0))) if len(p) and x.shape[1] else 0
            limit = float(np.median(x[p, along])) if len(p) and x.shape[1] else 0.0
            splits.append((along, limit))
            above = x[p, along] > limit if x.shape[1] else np.zeros(len(p), bool)
            new += [p[~above], p[above]]
        parts = new
    return splits


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def gathered(rows: DataFrame, size: int, leaf: int, of: str) -> DataFrame:
    """Blocks (of, label, n, kind, ids, data, centre, norm, radius) of rows (id, label, cell, vector): at most some `size` rows of one label and cell each."""
    counts = checkpointed(rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / size).alias("parts")))
    dealt = rows.join(few(counts), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
            x = integers(vectors)
            order = in_tree_order(x, leaf)
            kind, data = narrow(x[order])
            root = Balls(x, len(x))
            made = [key[3], key[0], len(x), kind, np.array(ids, np.int64)[order], data, root.centre[0].tolist(), float(root.norm[0]), float(root.radius[0])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types, strict=True)], names=names)

        names = [of, "label", "n", "kind", "ids", "data", "centre", "norm", "radius"]
        types: list[pa.DataType] = []
        now, ids, vectors = None, [], []
        for batch in batches:
            types = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for key, i, v in zip(keys, batch.column(4).to_pylist(), _lists(batch.column(5)), strict=True):
                if key != now and now is not None:
                    yield done(now, ids, vectors)
                    ids, vectors = [], []
                now = key
                ids.append(i)
                vectors.append(v.copy())
        if now is not None:
            yield done(now, ids, vectors)

    kind = dict(rows.dtypes)["label"]
    keyed = dealt.select("label", "cell", "part", F.xxhash64("label", "cell", "part").alias(of), "id", "vector")
    sorted_rows = keyed.repartition("label", "cell", "part").sortWithinPartitions("label", "cell", "part")
    return checkpointed(sorted_rows.mapInArrow(run, f"{of} long, label {kind}, n int, kind string, ids array<long>, data binary, centre array<double>, norm double, radius double"))


def chunks(balls: DataFrame, of: str, more: list[str]) -> tuple[DataFrame, int]:
    """Rows (chunk, balls) of some CHUNK balls each, and their number."""
    n = max(1, math.ceil(balls.count() / CHUNK))
    named = balls.select(F.struct(F.col(of).alias("id"), "label", "centre", "norm", "radius", *more).alias("x"), F.pmod(F.xxhash64(of), F.lit(n)).alias("chunk"))
    return named.groupBy("chunk").agg(F.collect_list("x").alias("balls")), n


def meet(groups: DataFrame, blocks: DataFrame, same: bool, best: bool) -> DataFrame:
    """(group, block, middle): blocks of the groups' own label or of others that can hold what a group still needs.

    groups have `low` and `high`: the range of scores of use. best: of each group and chunk only the block with the
    greatest product of centres.
    """
    left, _ = chunks(groups, "group", ["low", "high"])
    right, n = chunks(blocks, "block", [])
    pairs = left.select("balls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at"))
    met = pairs.join(right.select(F.col("chunk").alias("at"), F.col("balls").alias("others")), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ball(x: list[dict]) -> tuple:
            width = max((len(b["centre"]) for b in x), default=0)
            return np.array([b["centre"] + [0.0] * (width - len(b["centre"])) for b in x]), np.array([b["norm"] for b in x]), np.array([b["radius"] for b in x])

        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                a, b = one.as_py(), two.as_py()
                x, y = ball(a), ball(b)
                low, high = interval(x, y)
                alike = np.array([p["label"] for p in a], object)[:, None] == np.array([q["label"] for q in b], object)
                need = np.array([p["low"] for p in a], float)[:, None], np.array([p["high"] for p in a], float)[:, None]
                hit = (alike == same) & (high >= need[0]) & (low <= need[1])
                middle = (low + high) / 2 if np.isfinite(low).all() and np.isfinite(high).all() else np.zeros(low.shape)
                if best:
                    top = np.where(hit, middle, -np.inf).argmax(axis=1)
                    only = np.zeros(hit.shape, bool)
                    only[np.arange(len(a)), top] = True
                    hit &= only
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_pydict({"group": pa.array([a[k]["id"] for k in i], pa.int64()), "block": pa.array([b[k]["id"] for k in j], pa.int64()), "middle": pa.array(middle[i, j], pa.float64())})

    return met.select("balls", "others").mapInArrow(run, "group long, block long, middle double")


def first_choice(met: DataFrame) -> DataFrame:
    """(group, block): the best block of each group."""
    return checkpointed(met.groupBy("group").agg(F.max_by("block", F.struct("middle", "block")).alias("block")))


def vectors_of(kind: str, data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(data, kind)
    return flat.reshape(n, len(flat) // n).astype(float)


def visit(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, search: Callable[[dict, np.ndarray, dict, np.ndarray, Balls], list[tuple]], schema: str) -> DataFrame:
    """search() of every pair (group, block); groups and blocks come to it with all their columns."""
    runs = checkpointed(pairs.groupBy("block").agg(F.ceil(F.count("*") / RUN).alias("runs")))
    dealt = checkpointed(pairs.join(few(runs), "block").select("block", "group", F.pmod(F.xxhash64("group"), "runs").alias("run")))
    own = [c for c in groups.columns if c != "group"]
    asked = dealt.join(groups, "group").select("block", "run", F.struct("group", *own).alias("x"))
    held = dealt.select("block", "run").distinct().join(blocks, "block").select("block", "run", F.struct(*[c for c in blocks.columns if c not in ("block", "centre", "norm", "radius")]).alias("y"))
    union = asked.withColumn("y", F.lit(None).cast(held.schema["y"].dataType)).unionByName(held.withColumn("x", F.lit(None).cast(asked.schema["x"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, x, tree = None, None, None
        for batch in batches:
            for asked, held in zip(batch.column(2), batch.column(3), strict=True):
                if held.is_valid:  # a block comes before its groups
                    block = held.as_py()
                    x = vectors_of(block["kind"], block["data"], block["n"])
                    tree = Balls(x, LEAF)
                    block["ids"] = np.array(block["ids"], np.int64)
                    continue
                group = asked.as_py()
                group["ids"] = np.array(group["ids"], np.int64)
                rows = search(group, vectors_of(group["kind"], group["data"], group["n"]), block, x, tree)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    ordered = union.select("block", "run", "x", "y").repartition("block", "run").sortWithinPartitions("block", "run", F.col("y").isNull())
    return ordered.mapInArrow(run, schema)


def descend(a: np.ndarray, ta: Balls, tree: Balls, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, leaves): for each leaf of anchors the leaves of the block that can hold a score in some anchor's range.

    Whole groups of anchors are pruned where the two balls' interval misses the ranges of all of them.
    """

    def ball(t: Balls, k: list[int]) -> tuple:
        return t.centre[k], t.norm[k], t.radius[k]

    todo = [(0, [0])]
    while todo:
        k, nodes = todo.pop()
        s, e = ta.edges[k]
        if e == s:
            continue
        while True:
            least, most = interval(ball(ta, [k]), ball(tree, nodes))
            nodes = [n for n, x, y in zip(nodes, least[0], most[0], strict=True) if y >= low[s:e].min() and x <= high[s:e].max() and tree.edges[n][1] > tree.edges[n][0]]
            deeper = [n for n in nodes if not tree.is_leaf(n)]
            if not deeper or not ta.is_leaf(k):
                break
            nodes = [n for n in nodes if tree.is_leaf(n)] + [c for n in deeper for c in (2 * n + 1, 2 * n + 2)]
        if not nodes:
            continue
        if ta.is_leaf(k):
            yield s, e, [tree.edges[n] for n in nodes]
        else:
            below = [c for n in nodes for c in ((n,) if tree.is_leaf(n) else (2 * n + 1, 2 * n + 2))]
            todo += [(2 * k + 1, below), (2 * k + 2, below)]


def first_of(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if found.dtype != object and len(found) > 4 * k:
        at = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k])
    else:
        at = np.arange(len(found))
    return np.array(sorted(at.tolist(), key=lambda i: (-found[i], ids[i]))[:k], np.int64)


def _long(x: int) -> int:
    return max(-_LONG, min(_LONG, int(x)))


def _leaf_scores(a: np.ndarray, s: int, e: int, leaves: list[tuple[int, int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.concatenate([np.arange(p, q) for p, q in leaves])
    return rows, scores(a[s:e], x[rows])


def search_positives(group: dict, a: np.ndarray, block: dict, x: np.ndarray, tree: Balls) -> list[tuple]:
    """(anchor, positive, score) of the first POSITIVES rows of the block that are over the anchors' bounds."""
    bounds, out = np.array(group["bounds"] or [-np.inf] * len(a), float), []
    for s, e, leaves in descend(a, Balls(a, ANCHOR_LEAF), tree, bounds, np.full(len(a), np.inf)):
        rows, made = _leaf_scores(a, s, e, leaves, x)
        ids = block["ids"][rows]
        for i in range(s, e):
            other = np.flatnonzero(ids != group["ids"][i])
            best = first_of(made[i - s][other], ids[other], POSITIVES)
            out += [(int(group["ids"][i]), int(ids[other[j]]), _long(made[i - s][other[j]])) for j in best]
    return out


def wanted_range(score: int) -> tuple[int, int]:
    """The negatives' scores that a positive's score asks for."""
    return -(-LOW * score // 100), HIGH * score // 100


def search_negatives(group: dict, a: np.ndarray, block: dict, x: np.ndarray, tree: Balls) -> list[tuple]:
    """(anchor, positive, negative, score) of the first NEGATIVES rows of the block in each positive's range, if they are over its bound."""
    asked: dict[int, list[tuple[int, int, int]]] = {}
    for t in group["asked"]:
        low, high = wanted_range(t["score"])
        if t["bound"] is not None:
            low = max(low, t["bound"])
        if low <= high:
            asked.setdefault(t["anchor"], []).append((t["positive"], low, high))
    ranges = [asked.get(int(i), []) for i in group["ids"]]
    low = np.array([min((float(r[1]) for r in rs), default=np.inf) for rs in ranges])
    high = np.array([max((float(r[2]) for r in rs), default=-np.inf) for rs in ranges])
    out = []
    for s, e, leaves in descend(a, Balls(a, ANCHOR_LEAF), tree, low, high):
        rows, made = _leaf_scores(a, s, e, leaves, x)
        ids = block["ids"][rows]
        for i in range(s, e):
            for positive, least, most in ranges[i]:
                hit = np.flatnonzero((made[i - s] >= least) & (made[i - s] <= most))
                best = first_of(made[i - s][hit], ids[hit], NEGATIVES)
                out += [(int(group["ids"][i]), positive, int(ids[hit[j]]), _long(made[i - s][hit[j]])) for j in best]
    return out


def first_rows(found: DataFrame, by: list[str], key: str, score: str, k: int) -> DataFrame:
    """The first k rows of each `by` with their rank; Spark cuts each task's rows to k before the shuffle."""
    window = W.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return checkpointed(found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k))


def worst(found: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    """by and bound: the k-th best score, where there are k."""
    return found.filter(F.col("rank") == k).select(*by, F.col(score).alias("bound"))


def fitted(rows: DataFrame, n: int) -> list[tuple[int, float]]:
    """Splits fitted on some SAMPLE rows, taken by a hash of id; more levels for more rows, CELL_LEVELS at most."""
    levels = min(CELL_LEVELS, max(0, math.ceil(math.log2(max(n, 1) / (4 * BLOCK_ROWS)))))
    if not levels:
        return []
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1, SAMPLE / n) * (1 << 40)))
    return fit_splits(integers([np.array(r[0], float) for r in drawn.select("vector").collect()]), levels)


def with_cells(rows: DataFrame, splits: list[tuple[int, float]]) -> DataFrame:
    if not splits:
        return rows.withColumn("cell", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = cells_of(integers(_lists(batch.column(2))), splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=["id", "label", "vector", "cell"])

    kind = dict(rows.dtypes)["label"]
    return rows.select("id", "label", "vector").mapInArrow(run, f"id long, label {kind}, vector array<double>, cell long")


def hard_negatives(table: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchor: which rows (of key, label and vector as id, label, vector) are anchors.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = checkpointed(usable(table, key, vector, label))
    celled = checkpointed(with_cells(rows, fitted(rows, rows.count())))
    blocks = gathered(celled, BLOCK_ROWS, LEAF, "block")
    groups = gathered(celled.filter(anchor), GROUP_ROWS, ANCHOR_LEAF, "group")
    member = groups.select("group", F.explode("ids").alias("anchor"))
    release_shuffles(spark)

    def sought(same: bool, asked: DataFrame, search: Callable, schema: str, by: list[str], key: str, k: int, bounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """First the best block of each group, then all others that can be of use; the first k rows of both."""
        start = asked.withColumns({"low": F.lit(-float("inf")), "high": F.lit(float("inf"))}) if same else asked
        chosen = first_choice(meet(start, blocks, same, True))
        before = first_rows(visit(chosen, asked, blocks, search, schema), by, key, "score", k)
        now = checkpointed(bounds(before))
        rest = checkpointed(meet(now, blocks, same, False).select("group", "block").join(chosen, ["group", "block"], "left_anti"))
        return first_rows(before.drop("rank").unionByName(visit(rest, now, blocks, search, schema)), by, key, "score", k)

    def positive_bounds(before: DataFrame) -> DataFrame:
        known = member.join(worst(before, ["anchor"], "score", POSITIVES), "anchor", "left")
        least = known.groupBy("group").agg(F.min(F.coalesce(F.col("bound").cast("double"), F.lit(-float("inf")))).alias("low"), F.map_from_entries(F.collect_list(F.struct("anchor", F.coalesce(F.col("bound").cast("double"), F.lit(-float("inf")))))).alias("bound_of"))
        ranged = groups.join(least, "group").withColumn("high", F.lit(float("inf")))
        return ranged.withColumn("bounds", F.transform("ids", lambda i: F.element_at("bound_of", i))).drop("bound_of")

    unbound = groups.withColumn("bounds", F.lit(None).cast("array<double>"))
    positives = sought(True, unbound, search_positives, "anchor long, positive long, score long", ["anchor"], "positive", POSITIVES, positive_bounds).drop("rank")
    release_shuffles(spark)

    def with_asked(bounds: DataFrame | None) -> DataFrame:
        asked = positives.withColumn("bound", F.lit(None).cast("long")) if bounds is None else positives.join(bounds, ["anchor", "positive"], "left")
        score = F.col("score").cast("double")
        low, high = score * (LOW / 100) - F.abs(score) * SLACK - 1, score * (HIGH / 100) + F.abs(score) * SLACK + 1
        ranged = asked.withColumns({"low": F.greatest(low, F.coalesce(F.col("bound").cast("double"), F.lit(-float("inf")))), "high": high})
        entry = F.struct("anchor", "positive", "score", "bound")
        return groups.join(member.join(ranged, "anchor").groupBy("group").agg(F.collect_list(entry).alias("asked"), F.min("low").alias("low"), F.max("high").alias("high")), "group")

    of = ["anchor", "positive"]
    first = checkpointed(with_asked(None))
    negatives = sought(False, first, search_negatives, "anchor long, positive long, negative long, score long", of, "negative", NEGATIVES, lambda before: with_asked(worst(before, of, "score", NEGATIVES)))
    scored = negatives.join(positives.withColumnRenamed("score", "positive_score"), of)
    return scored.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

