"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A document's shard follows from its doc_id and the number of shards alone: no ring table is kept, and going from n
to n + 1 shards moves only the share 1/(n + 1) of the keys, all of them into the new shard.

Slots number the rows of a shard without gaps. A shard is unbounded, so its rows are never brought together: each
partition numbers its own rows by shard while it hashes their keys, and a table with a count for each partition and
shard gives the partition's first slot there. Rows are neither shuffled nor sorted, and equal rows need no salt. The
numbered rows are checkpointed before the counts are taken, so a task that runs again can't number them anew.

Edge cases: a null doc_id is the key 0; null text has size 1 and the CRC of no bytes; repeated rows get slots of their
own; an empty table gives an empty result; columns to keep stay as they are, and a column that the operator makes has
a name with underscores at its end where a kept one has its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, few, free_name, small_batches, text_or_empty

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys take their jumps together."""
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = ahead < n_shards
    while going.any():
        at[going] = ahead[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        going = ahead < n_shards
    return at.astype(np.int32)


def _key(column):
    return F.coalesce(column, F.lit(0)).cast("long")


def jump_column(key, n_shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), n_shards))

    return shard(_key(key))


def numbered(key, n_shards: int):
    """(shard, shard if one were added, number among the partition's rows of the shard) of a key."""

    @F.pandas_udf("shard int, grown int, nth long")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        before = np.zeros(n_shards, np.int64)
        for keys in batches:
            values = keys.to_numpy(np.int64)
            shard = jump_hash(values, n_shards)
            nth = np.zeros(len(shard), np.int64)
            for s in range(n_shards):
                own = np.flatnonzero(shard == s)
                nth[own] = before[s] + np.arange(len(own))
                before[s] += len(own)
            yield pd.DataFrame({"shard": shard, "grown": jump_hash(values, n_shards + 1), "nth": nth})

    return number.asNondeterministic()(_key(key))


def shard_rows(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, size, text_crc32, law, shard, slot and grown_shard (the shard if one were added)."""
    small_batches(docs.sparkSession)
    kept = docs.select("doc_id" if key == "doc_id" else F.col(key).alias("doc_id"), *keep)
    size, crc, law, shard, slot, grown = (free_name(kept, n) for n in MADE)
    at, part = free_name(kept, "_at"), free_name(kept, "_part")
    body = text_or_empty(text)
    rows = checkpointed(
        docs.select(
            F.col(key).alias("doc_id"),
            *keep,
            (F.octet_length(body) + 1).cast("long").alias(size),
            F.crc32(body.cast("binary")).alias(crc),
            numbered(F.col(key), n_shards).alias(at),
            F.spark_partition_id().alias(part),
        )
    )
    counts = rows.groupBy(part, F.col(f"{at}.shard").alias("_shard")).agg((F.max(f"{at}.nth") + 1).alias("_n"))
    before = Window.partitionBy("_shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = few(checkpointed(counts.select(F.col(part).alias("_of"), "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))))
    o, r = offsets.alias("o"), rows.alias("r")
    joined = r.join(o, (F.col(f"r.{part}") == F.col("o._of")) & (F.col(f"r.{at}.shard") == F.col("o._shard")))
    return joined.select(
        *[F.col(f"r.`{c}`") for c in ("doc_id", *keep, size, crc)],
        F.lit("key").alias(law),
        F.col(f"r.{at}.shard").alias(shard),
        (F.col("o._first") + F.col(f"r.{at}.nth")).cast("long").alias(slot),
        F.col(f"r.{at}.grown").alias(grown),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, key: str = "doc_id") -> None:
    """docs as Parquet with one folder a shard; a shard may have many files. A column named shard is replaced."""
    docs.withColumn("shard", jump_column(F.col(key), n_shards)).write.partitionBy("shard").parquet(path)
