"""Rewritten trees that are kept: a run reads what it has to, rewrites the files that changed, and publishes all at once.

A run's folder has the files that it rewrote and an index of the whole tree: for each path the digest of its source and
the run that rewrote it. CURRENT names the run whose index holds; it is replaced by a rename after all else is written,
so a reader sees one run or the next, and a run that dies changes nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import organize, rewrite
from siltworks.sources.files import _exists

#: Part of each digest: another number makes the next run rewrite everything.
RULES = "1"
CURRENT = "CURRENT"


def digest(content: Column) -> Column:
    return F.sha2(F.concat(F.lit(RULES + ":"), F.coalesce(content, F.lit(""))).cast("binary"), 256)


def current(spark: SparkSession, home: str) -> str | None:
    """The name of the run that holds, if there is one."""
    pointer = os.path.join(home, CURRENT)
    return spark.read.text(pointer).first()[0] if _exists(spark, pointer) else None


def index(spark: SparkSession, home: str, run: str) -> DataFrame:
    """(path, digest, run) of all files."""
    return spark.read.parquet(os.path.join(home, run, "index"))


def refresh(files: DataFrame, home: str) -> dict[str, int]:
    """Brings the snapshot at home up to files (path, content; a path once): the counts of changed and removed files and of fixes.

    Only changed files go through the passes. Where nothing changed, nothing is written.
    """
    spark = files.sparkSession
    sources = files.select("path", "content", digest(F.col("content")).alias("digest"))
    now, before = sources.select("path", "digest"), current(spark, home)
    old = index(spark, home, before) if before else spark.createDataFrame([], "path string, digest string, run string")
    changed = sources.join(old.select("path", "digest"), ["path", "digest"], "left_anti")
    removed = old.join(now, "path", "left_anti").count()
    if before and not removed and not changed.limit(1).count():
        return {"changed": 0, "removed": 0, "fixes": 0}
    run, seen = f"run-{uuid.uuid4().hex}", Observation()
    folder = os.path.join(home, run)
    fixed = rewrite.fix_files(changed).observe(seen, F.count("*").alias("changed"), F.coalesce(F.sum("n_fixes"), F.lit(0)).alias("fixes"))
    fixed.select("path", "digest", F.col("fixed").alias("content"), "n_fixes").write.parquet(os.path.join(folder, "files"))
    kept = now.join(old, ["path", "digest"]).select("path", "digest", "run")
    made = spark.read.parquet(os.path.join(folder, "files")).select("path", "digest", F.lit(run).alias("run"))
    kept.unionByName(made).write.parquet(os.path.join(folder, "index"))
    organize.write_files(spark.createDataFrame([(CURRENT, run)], "path string, content string"), home)
    return {"changed": int(seen.get["changed"]), "removed": removed, "fixes": int(seen.get["fixes"])}


def fixed_files(spark: SparkSession, home: str) -> DataFrame:
    """(path, content, n_fixes) of the snapshot, each file from the run that rewrote it."""
    held = index(spark, home, current(spark, home))
    runs = [r[0] for r in held.select("run").distinct().collect()]  # one for each refresh that some file is left of
    rows = [spark.read.parquet(os.path.join(home, r, "files")).withColumn("run", F.lit(r)) for r in runs]
    if not rows:
        return held.select("path", F.lit(None).cast("string").alias("content"), F.lit(0).alias("n_fixes"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return held.join(every.drop("digest"), ["path", "run"]).select("path", "content", "n_fixes")
