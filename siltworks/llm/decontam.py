"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Items and documents are reduced to lower-case words. A window is WINDOW consecutive words of an item; a shorter item is
one window. The scan has two steps. Every occurrence of a window of n words covers a gram of g = ceil(n / 2) words that
starts at a multiple of n - g + 1 in the document, so only every sixth position (for n = 10) is hashed and looked up in
the set of the grams of all windows. Around a gram that is in the set, the windows themselves are looked up by hash,
and what is found is verified by comparing the words.

Up to MAX_SET grams the sets travel with the plan as constants (an InSet expression). A larger benchmark takes the same
steps as joins: the hashes of the aligned grams (one long for each six words) are joined with the table of grams, which
is broadcast if a count shows MAX_BROADCAST hashes at most; only documents with a hit go on.

Only the distinct hits, by doc_id and hash of the text, are ever shuffled; a document that isn't hit stays where it is.
Nothing depends on row numbers, so a task may run again anywhere.

Edge cases: null or wordless texts have no words and no hits; null items and wordless items have no windows; equal
windows of several items count for each; repeated rows are scanned alike; repeated items count once by item_id; an
empty benchmark hits nothing; columns to keep stay as they are, and other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, few, free_name, text_or_empty, words

WINDOW = 10
#: The constants take about 20 bytes each in the plan.
MAX_SET = 200_000
#: Hashes of 8 bytes in a broadcast table.
MAX_BROADCAST = 5_000_000
HITS = "array<struct<start:int,size:int,gram:array<string>>>"


def windows(items: DataFrame, n: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, size, gram): the distinct windows of each item."""
    split = items.select(F.col(key).cast("string").alias("item_id"), words(text_or_empty(text)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))
    return split.select("item_id", size.alias("size"), F.explode(grams).alias("gram")).distinct()


def _pieces(n: int) -> tuple[int, int]:
    """Words of a gram and the stride at which any window of n words covers one."""
    g = (n + 1) // 2
    return g, n - g + 1


def find(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_set: int = MAX_SET, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and spans (start, end) of words hit.

    keep: further columns of docs to carry along.
    """
    hits = checkpointed(hit_texts(docs, items, n, max_set))
    body = text_or_empty()
    plain = docs.select("doc_id", *keep)
    text, words_ = free_name(plain, "_text"), free_name(plain, "n_words")
    d, h = docs.select("doc_id", *keep, F.xxhash64(body).alias(text), F.size(words(body)).cast("long").alias(words_)).alias("d"), few(hits).alias("h")
    joined = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h._doc")) & (F.col(f"d.{text}") == F.col("h._text_hash")), "left")
    return joined.select(
        *[F.col(f"d.`{c}`") for c in ("doc_id", *keep, words_)],
        F.coalesce("h._n_hit", F.lit(0)).cast("long").alias(free_name(plain, "n_hit")),
        F.coalesce(F.size("h._items"), F.lit(0)).cast("long").alias(free_name(plain, "n_items")),
        F.sha2(F.coalesce(F.array_join("h._items", ","), F.lit("")), 256).alias(free_name(plain, "items_sha256")),
        F.col("h._doc_hit").isNotNull().alias(free_name(plain, "contaminated")),
        F.coalesce("h._spans", F.array().cast("array<struct<start:int,end:int>>")).alias(free_name(plain, "spans")),
    )


def hit_texts(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """(_doc, _text_hash) of the documents that hold a window, with _n_hit, _items, _spans, and _doc_hit, which is true."""
    held = checkpointed(windows(items, n).withColumn("hash", F.xxhash64("gram")))
    sizes = [r[0] for r in held.select("size").distinct().orderBy("size").collect()]
    part = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text_or_empty()).alias("_text_hash"), words(text_or_empty()).alias("_w"))
    if held.select("hash").distinct().count() * n <= max_set or not sizes:
        found = [_hits(held, size) for size in sizes]
        placed = part.select("_doc", "_text_hash", F.explode(F.concat(*found) if found else F.array().cast(HITS)).alias("hit"))
    else:
        placed = _hits_by_joins(part, held, sizes)
    # Copies of a row are one here; a window that very many documents hold meets its items by a broadcast, or a join that can split it.
    hits = placed.select("_doc", "_text_hash", "hit.start", "hit.size", "hit.gram").distinct().withColumn("hash", F.xxhash64("gram"))
    named = checkpointed(held.groupBy("hash", F.col("gram").alias("same")).agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    true = hits.join(few(named, MAX_SET), "hash").filter(F.col("same") == F.col("gram"))
    grouped = true.groupBy("_doc", "_text_hash").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("_spans"), F.collect_set("items").alias("_named"))
    hit = F.array_distinct(F.flatten(F.transform("_spans", lambda x: F.sequence(x["start"], x["end"] - 1))))
    return grouped.select("_doc", "_text_hash", F.lit(True).alias("_doc_hit"), F.size(hit).alias("_n_hit"), F.array_sort(F.array_distinct(F.flatten("_named"))).alias("_items"), "_spans")


def _near(held: DataFrame, size: int) -> DataFrame:
    """(h): the hashes of all grams of the windows of `size` words."""
    g, _ = _pieces(size)
    return held.filter(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(size - g + 1)), lambda i: F.xxhash64(F.slice("gram", i, g)))).alias("h")).distinct()


def _hits(held: DataFrame, size: int) -> Column:
    """The places of windows of `size` words in the column _w, by hash."""
    g, stride = _pieces(size)
    of_size = held.filter(F.col("size") == size)
    near = [r[0] for r in _near(held, size).orderBy("h").collect()]
    whole = [r[0] for r in of_size.select("hash").distinct().orderBy("hash").collect()]
    inside = lambda values: f"IN ({', '.join(f'{v}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})"
    marks = f"filter(sequence(0, greatest(int(floor((size(_w) - {g}) / {stride})), 0)), j -> xxhash64(slice(_w, j * {stride} + 1, {g})) {inside(near)})"
    around = f"array_distinct(flatten(transform({marks}, j -> sequence(greatest(j * {stride} - {size - g}, 0), least(j * {stride}, size(_w) - {size})))))"
    placed = f"transform(filter({around}, p -> xxhash64(slice(_w, p + 1, {size})) {inside(whole)}), p -> struct(p AS start, {size} AS size, slice(_w, p + 1, {size}) AS gram))"
    return F.when(F.size("_w") >= size, F.expr(placed)).otherwise(F.array().cast(HITS))


def _hits_by_joins(part: DataFrame, held: DataFrame, sizes: list[int]) -> DataFrame:
    """(_doc, _text_hash, hit): the same where the sets are too large for constants."""
    out = []
    for size in sizes:
        g, stride = _pieces(size)
        near = checkpointed(_near(held, size))
        places = f"transform(sequence(0, greatest(int(floor((size(_w) - {g}) / {stride})), 0)), j -> struct(j * {stride} AS at, xxhash64(slice(_w, j * {stride} + 1, {g})) AS h))"
        aligned = part.select("_doc", "_text_hash", F.explode(F.when(F.size("_w") >= size, F.expr(places))).alias("x")).select("_doc", "_text_hash", "x.at", "x.h")
        marks = aligned.join(few(near, MAX_BROADCAST), "h").select("_doc", "_text_hash", "at").distinct()
        spots = checkpointed(marks.groupBy("_doc", "_text_hash").agg(F.collect_set("at").alias("ats")))
        p, m = part.alias("p"), few(spots).alias("m")
        met = p.join(m, F.col("p._doc").eqNullSafe(F.col("m._doc")) & (F.col("p._text_hash") == F.col("m._text_hash"))).select("p._doc", "p._text_hash", "p._w", "m.ats")
        around = f"array_distinct(flatten(transform(ats, a -> sequence(greatest(a - {size - g}, 0), least(a, size(_w) - {size})))))"
        out.append(met.select("_doc", "_text_hash", F.explode(F.expr(f"transform({around}, p -> struct(p AS start, {size} AS size, slice(_w, p + 1, {size}) AS gram))")).alias("hit")))
    return functools.reduce(DataFrame.unionByName, out)


def remove(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs without the documents that hold a window of an item; columns as they are."""
    hits = few(checkpointed(hit_texts(docs, items, n, max_set).select("_doc", "_text_hash"))).alias("h")
    mark = free_name(docs, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text_or_empty())).alias("d")
    left = marked.join(hits, F.col("d.doc_id").eqNullSafe(F.col("h._doc")) & (F.col(f"d.{mark}") == F.col("h._text_hash")), "left_anti")
    return left.select(*[f"`{c}`" for c in docs.columns])
