"""Merkle manifest of a table: one root for all rows, and for each row a proof that it belongs to it.

A row's leaf is the SHA-256 of some of its columns. Leaves of one `group` (null is a group too) ascend by `key` and
make a binary tree; the trees' roots, ordered by group, make the top tree. Here

1. leaves get their place in their group: a range partition of all rows, numbered in place, so that neither a large
   group nor very many rows of one key come into one task;
2. bottom-up, one level is persisted for each STEP levels of the tree: 2 ** STEP neighbours are gathered to a row (a
   bounded number, whatever the group's size), which gives one node of the next persisted level;
3. top-down, each persisted level joins its children to their parents, and each child prepends its own siblings to the
   proof that the parent inherited. A proof thus travels once for 2 ** STEP children, never once a leaf.

verified() folds a leaf along its proof with built-in functions only, without the tree.

Edge cases: a null column is `-` in the leaf, an empty text `0:`; a null group is a group before all others; rows of one
key are ordered by their leaves (rows alike in all hashed columns can change places: their leaves are the same, so the
proofs of both hold); a group of one row has the leaf as its root, a table of one group that group's root; an empty
table gives an empty result; columns that aren't hashed count for nothing, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, crc_mod, few, small_batches

#: Columns of documents in a leaf.
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the binary tree from one persisted level to the next.
STEP = 8
#: How a proof's element says where the sibling stands; NONE is a node without one.
LEFT, RIGHT, NONE = "<", ">", "="


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256 (hex) of the columns: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    as_text = [c.cast("string") for c in columns.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [digests]
    for _ in range(levels):
        now = out[-1]
        out.append([parent(now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def levels_in(n: int, step: int) -> int:
    """Levels from a run of a persisted level with n nodes to the next one: as many as it takes to one node, `step` at most."""
    return min(step, (n - 1).bit_length())


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """The elements of a proof within one run, from the bottom up."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append(NONE if other >= len(nodes) else (LEFT if other < at else RIGHT) + nodes[other])
        at >>= 1
    return out


def places(rows: DataFrame) -> DataFrame:
    """rows (g, key, digest, ...) with pos, the row's place in its g from 0, and n, the number of rows of its g."""
    # A number of its own for each row lets the range partition split rows that are alike.
    kept = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    in_order = kept.repartitionByRange("g", "key", "digest", "row").sortWithinPartitions("g", "key", "digest", "row")
    numbered = checkpointed(in_order.drop("row").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = numbered.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    so_far = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    # A row for each group and partition that holds some of it.
    offsets = runs.select("g", "part", "first", F.coalesce(F.sum("rows").over(so_far), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    joined = numbered.join(few(checkpointed(offsets)), ["g", "part"])
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before", "key")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[list[int], pa.StructArray]:
    held = batch.column(batch.schema.get_field_index(name))
    return held.offsets.to_pylist(), held.values


def build(nodes: DataFrame, step: int = STEP) -> tuple[list[DataFrame], list[DataFrame]]:
    """Persisted levels and, for each, the groups whose tree ends there.

    nodes: g, n (nodes of the group), pos, digest and data (a struct that only leaves need). A level has a row (g, n,
    up, children) for each run of children; children are structs of pos, digest and data, in order.
    """
    small_batches(nodes.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, children = _flat(batch, "children")
            digests, made = children.field("digest").to_pylist(), []
            n = batch.column(1).to_pylist()
            for i, size in enumerate(n):
                made.append(climb(digests[offsets[i] : offsets[i + 1]], levels_in(size, step))[-1][0])
            left = pa.array([(size + (1 << step) - 1) >> step for size in n], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), left, batch.column(2), pa.array(made, pa.string())], names=["g", "n", "pos", "digest"])

    levels, tops, now = [], [], nodes
    while True:
        tops.append(now.filter("n = 1").select("g", F.col("digest").alias("subroot"), *(["data"] if not levels else [])))
        more = now.filter("n > 1")
        if more.limit(1).count() == 0:
            return levels, tops
        child = F.struct("pos", "digest", *(["data"] if not levels else []))
        runs = more.groupBy("g", "n", F.shiftright("pos", step).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        levels.append(checkpointed(runs))
        now = checkpointed(levels[-1].select("g", "n", "up", "children").mapInArrow(fold, "g string, n long, pos long, digest string"))


def push(levels: list[DataFrame], tops: list[DataFrame], inherited: DataFrame, step: int = STEP) -> DataFrame:
    """(g, digest, data, subroot, proof) of every leaf; subroot is its group's root, and proof has the elements from the leaf up to what the group inherits.

    inherited: (g, proof) of each group's root.
    """

    def prepend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, children = _flat(batch, "children")
            digests, first = children.field("digest").to_pylist(), children.slice(0)
            data = first.field("data") if "data" in [f.name for f in children.type] else None
            for i, (g, n, up, proof) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                s, e = offsets[i], offsets[i + 1]
                tree = climb(digests[s:e], levels_in(n, step))
                proofs = pa.array([siblings(tree, at) + proof for at in range(e - s)], pa.list_(pa.string()))
                columns = {"g": pa.array([g] * (e - s), pa.string()), "pos": pa.array(range(up << step, (up << step) + e - s), pa.int64()), "digest": pa.array(digests[s:e], pa.string())}
                if data is not None:
                    columns["data"] = data.slice(s, e - s)
                columns["subroot"] = pa.array([batch.column(4)[i].as_py()] * (e - s), pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), proofs], names=[*columns, "proof"])

    def at_top(k: int) -> DataFrame:
        named = tops[k].join(inherited.withColumnRenamed("g", "of"), F.col("g") == F.col("of")).drop("of")
        return named.select("g", F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("digest"), *(["data"] if k == 0 else []), "subroot", "proof")

    now = at_top(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        above = now.select(F.col("g").alias("of"), F.col("pos").alias("under"), "subroot", "proof")
        met = levels[k].join(above, (F.col("g") == F.col("of")) & (F.col("up") == F.col("under"))).select("g", "n", "up", "children", "subroot", "proof")
        kinds = dict(levels[k].select(F.explode("children").alias("c")).select("c.*").dtypes)
        data = f", data {kinds['data']}" if "data" in kinds else ""
        now = met.mapInArrow(prepend, f"g string, pos long, digest string{data}, subroot string, proof array<string>").unionByName(at_top(k))
    return now


def hashes(proof: Column) -> Column:
    """The siblings of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(now: Column, x: Column) -> Column:
        other = F.substring(x, 2, 64)
        return F.sha2(F.when(F.startswith(x, F.lit(LEFT)), F.concat(other, now)).otherwise(F.concat(now, other)).cast("binary"), 256)

    return F.aggregate(proof, digest, up)


def manifest(docs: DataFrame, hashed: tuple[str, ...] = HASHED, key: str = "doc_id", group: str = "lang", extra: dict[str, Column] | None = None, step: int = STEP) -> DataFrame:
    """key, the extra columns, leaf, subroot, root and proof (elements `<`, `>` and a digest, or `=`) of every row of docs."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    # The null group is before all others: "-" is below "=".
    data = F.struct(F.col(key).alias("key"), *[c.alias(n) for n, c in (extra or {}).items()])
    leaves = docs.select(g.alias("g"), F.col(key).alias("key"), leaf({c: F.col(c) for c in hashed}).alias("digest"), data.alias("data"))
    levels, tops = build(places(leaves), step)
    subroots = _all([t.select("g", "subroot") for t in tops])
    of_group = subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("digest"), F.struct(F.col("g").alias("of")).alias("data"))
    top_levels, top_tops = build(places(of_group), step)
    root = _all([t.select("g", "subroot") for t in top_tops]).first()  # one row, none of an empty table
    start = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast("array<string>").alias("proof"))
    inherited = checkpointed(push(top_levels, top_tops, start, step).select(F.col("data.of").alias("g"), "proof"))
    names = [F.col(f"data.{n}") for n in (extra or {})]
    return push(levels, tops, inherited, step).select(F.col("data.key").alias(key), *names, F.col("digest").alias("leaf"), "subroot", F.lit(root and root.subroot).cast("string").alias("root"), "proof")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tampered(docs: DataFrame, hashed: tuple[str, ...] = HASHED) -> Column:
    """The leaf with 1 added to n_chars where 7 divides the crc32 of doc_id, else null."""
    changed = leaf({c: F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in hashed})
    return F.when(crc_mod(F.col("doc_id"), 7) == 0, changed)


def verified(rows: DataFrame, changed: str) -> DataFrame:
    """rows of manifest() with proof_sha256, folded_root (of the column `changed`, where that isn't null) and verified."""
    root = folded(F.coalesce(F.col(changed), F.col("leaf")), F.col("proof"))
    made = rows.select("*", F.sha2(hashes(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
