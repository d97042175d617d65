"""Column expressions and helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import re
import string
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Everything but digits, a-z and non-ASCII separates words (after lower-casing A-Z).
WORD_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Documents and bytes in one Arrow batch; both bound a Python worker's memory where documents are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows of a narrow table (ids and hashes) that may be broadcast, at most some 30 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES for the Python stages of this package.

    The settings count when a query runs, not when it is made, so they stay with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltworks-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as checkpointed() gives it and its number of rows, which the same job counts.

    Spark's driver keeps the plan and the tasks of every query, so a count of its own costs it memory.
    """
    seen = Observation()
    return checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def few(df: DataFrame, rows: int = BROADCAST_ROWS, n: int | None = None) -> DataFrame:
    """df, a checkpointed table of narrow rows, to be broadcast if a count (n, if it is known) shows no more than `rows` of them."""
    return F.broadcast(df) if (df.limit(rows + 1).count() if n is None else n) <= rows else df


def respread(df: DataFrame, key: str) -> DataFrame:
    """df, an aggregate by the column `key` (long or binary), with the key written so that a join on it shuffles df again.

    A join with the aggregate as it is would keep the aggregate's own partitions, and Spark then can't split the
    other side's rows of a hot key among tasks. Of the aggregate there is one row a key.
    """
    same = F.concat(F.col(key), F.lit(b"")) if dict(df.dtypes)[key] == "binary" else F.col(key).bitwiseXOR(F.lit(0).cast("long"))
    return df.withColumn(key, same)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are checkpointed and out of use.

    Spark does so once the driver's JVM has collected them, which otherwise may take until long after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return os.path.join(use_checkpoint_dir(spark), f"{name}-{os.urandom(8).hex()}")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else: lower() where the text is all ASCII, else translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null-free texts without words."""
    return F.array_remove(F.split(ascii_lower(text), WORD_SEPARATOR), "")


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame from JSON in the plan itself, without Python or RDD stages."""
    import json

    blob = spark.range(1, numPartitions=1).select(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>").alias("rows"))
    return blob.select(F.inline("rows"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets bits by their numbers in an array of bytes, the highest bit of a byte first."""
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def get_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits of these numbers are set."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whichever store that is."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)
