"""What a source tree says about itself, taken in one pass: its files, packages, imports and types.

summary() is small whatever the tree's size (a row for each distinct name), so it is written once and every stage of an
analysis reads that table in place of the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators import extract
from siltworks.session import materialised

KINDS = ("file", "package", "import", "class")


def file_kind(path: Column) -> Column:
    """A file's name in the summary: its extension, and whether its own name is obfuscated and has two letters at most."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.concat_ws("|", F.substring_index(path, ".", -1), extract.obfuscated(name).cast("string"), (F.length(name) <= 2).cast("string"))


def facts(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, name, path, line_no, n) of files (path, content): one row a file (n: its obfuscated methods), declaration or import.

    The text is split once, and each line gives all it has; an import gives its package too.
    """
    bad = F.size(F.filter(F.regexp_extract_all("content", F.lit(fixed.METHOD), F.lit(1)), extract.obfuscated))
    methods = F.coalesce(bad, F.lit(0)) if "file" in kinds else F.lit(0)
    lines = files.select("path", methods.alias("bad"), F.posexplode_outer(F.split("content", "\r\n|\n|\r")).alias("line_no", "line"))
    # Most lines declare nothing: they are left out by a search for a word before the expressions that follow.
    word = {"file": F.coalesce(F.col("line_no"), F.lit(0)) == 0, "package": F.col("line").contains("package ") | F.col("line").contains("import "), "import": F.col("line").contains("import "), "class": F.lit(True)}
    lines = lines.filter(reduce(lambda a, b: a | b, [F.coalesce(word[k], F.lit(False)) for k in kinds]))
    imported = extract.import_name(F.col("line"))
    found = {
        "file": F.when(F.coalesce(F.col("line_no"), F.lit(0)) == 0, file_kind(F.col("path"))),
        "package": extract.package_name(F.col("line")),
        "import": imported,
        "class": extract.class_name(F.col("line")),
    }
    entries = [F.struct(F.lit(k).alias("kind"), found[k].alias("name")) for k in kinds]
    if "package" in kinds and "import" in kinds:
        entries.append(F.struct(F.lit("package").alias("kind"), F.nullif(extract.package_of(imported), F.lit("")).alias("name")))
    rows = lines.select("path", F.coalesce("line_no", F.lit(0)).alias("line_no"), "bad", F.explode(F.filter(F.array(*entries), lambda x: x["name"].isNotNull())).alias("x"))
    return rows.select("x.kind", "x.name", "path", "line_no", F.when(F.col("x.kind") == "file", F.col("bad")).otherwise(0).alias("n"))


def summary(files: DataFrame, kinds: tuple[str, ...] = ("file", "package", "import")) -> DataFrame:
    """(kind, name, path, line_no, n_places, n) of each distinct name: its first place, how often it is there, and the sum of n; written once."""
    rows = facts(files, kinds).groupBy("kind", "name").agg(F.min(F.struct("path", "line_no")).alias("at"), F.count("*").alias("n_places"), F.sum("n").alias("n"))
    return materialised(rows.select("kind", "name", "at.path", "at.line_no", "n_places", "n"))


def named(found: DataFrame, kind: str) -> DataFrame:
    """(kind's name, path, line_no) of a summary."""
    return found.filter(F.col("kind") == kind).select(F.col("name").alias(kind), "path", "line_no")


def class_counts(found: DataFrame) -> DataFrame:
    """extract.class_counts() of a summary."""
    parts = F.split("name", r"\|")
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_places"))), F.lit(0))
    return found.filter(F.col("kind") == "file").agg(
        F.coalesce(F.sum("n_places"), F.lit(0)).alias("n_classes"), n_if(parts[1] == "true").alias("n_obfuscated"), F.sum("n").alias("n_methods"), n_if(parts[2] == "true").alias("n_short")
    )


def languages(found: DataFrame) -> DataFrame:
    """extract.languages() of a summary."""
    extension = F.split("name", r"\|")[0]
    has = lambda ext: F.coalesce(F.bool_or(extension == ext), F.lit(False))
    return found.filter(F.col("kind") == "file").agg(has("java").alias("has_java"), has("kt").alias("has_kotlin"))
