"""Packages, imports, declarations and references of source lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def evaluated_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column, of which filters and other columns that use it read the value.

    The optimizer moves a filter below an ordinary column, with the column's expression in place of each mention of it;
    it doesn't look into what an explode() gives.
    """
    return rows.withColumn(name, F.explode(F.array(value)))


def is_kotlin() -> Column:
    return F.col("path").endswith(".kt")


def package_name(line: Column) -> Column:
    """The package that a line declares, else null; only Java's lose a semicolon."""
    t = trimmed(line)
    name = F.substring(t, 9, 1 << 30)
    return F.when(t.startswith("package "), trimmed(F.when(is_kotlin(), name).otherwise(F.regexp_replace(name, ";$", ""))))


def import_name(line: Column) -> Column:
    """What a line imports, else null, without a trailing `.*`: Java's without `static` and `;`, Kotlin's up to ` as `."""
    t = trimmed(line)
    name = F.substring(t, 8, 1 << 30)
    java, kotlin = trimmed(F.regexp_replace(F.regexp_replace(name, "^static ", ""), ";$", "")), trimmed(F.substring_index(name, " as ", 1))
    return F.when(t.startswith("import "), F.regexp_replace(F.when(is_kotlin(), kotlin).otherwise(java), r"\.\*$", ""))


def class_name(line: Column) -> Column:
    """The first declaration of a line, else null: of a type in Java, of a class, object or interface in Kotlin."""
    return F.nullif(F.when(is_kotlin(), F.regexp_extract(line, fixed.KOTLIN_CLASS, 2)).otherwise(F.regexp_extract(line, fixed.CLASS, 1)), F.lit(""))


def packages(lines: DataFrame) -> DataFrame:
    """(path, line_no, package) of package declarations."""
    return lines.select("path", "line_no", package_name(F.col("line")).alias("package")).filter("package IS NOT NULL")


def imports(lines: DataFrame) -> DataFrame:
    """(path, line_no, import) of import lines."""
    return lines.select("path", "line_no", import_name(F.col("line")).alias("import")).filter("import IS NOT NULL")


def package_of(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.", 1)


def classes(lines: DataFrame) -> DataFrame:
    """(path, line_no, class): the first declaration of each line."""
    return lines.select("path", "line_no", class_name(F.col("line")).alias("class")).filter("class IS NOT NULL")


def methods(lines: DataFrame) -> DataFrame:
    """(path, line_no, method), every match of a line."""
    return lines.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(fixed.METHOD), F.lit(1))).alias("method"))


def starts_with_any(name: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes])


def category(package: Column) -> Column:
    """Platform, androidx, google, third_party or app; the first that applies."""
    return (
        F.when(starts_with_any(package, ("android.", "java.", "javax.")), "platform").when(package.startswith("androidx."), "androidx")
        .when(starts_with_any(package, ("com.google.android.gms", "com.google.firebase")), "google").when(starts_with_any(package, fixed.THIRD_PARTY), "third_party").otherwise("app")
    )


def obfuscated(name: Column) -> Column:
    return name.rlike(fixed.OBFUSCATED)


def obfuscation_level(bad: Column, total: Column) -> Column:
    """NONE, LIGHT, MODERATE or HEAVY; the ratio is a float and compared as a double, so that 1 in 10 is LIGHT."""
    ratio = F.when(total > 0, (bad.cast("double") / total).cast("float")).otherwise(F.lit(0).cast("float")).cast("double")
    return F.when(ratio < 0.1, "NONE").when(ratio < 0.3, "LIGHT").when(ratio < 0.6, "MODERATE").otherwise("HEAVY")


def ancestors(package: Column) -> Column:
    """All dotted prefixes of a package, itself included: turns dot-bounded prefix joins into equi-joins."""
    parts = F.split(package, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def under_prefixes(df: DataFrame, column: str, prefixes: DataFrame, keep: bool) -> DataFrame:
    """Rows whose package is one of `prefixes` (prefix) or below one (keep), or the others; duplicates in df stay."""
    found = df.select(column).distinct().select(column, F.explode(ancestors(F.col(column))).alias("prefix")).join(prefixes, "prefix", "left_semi").select(column).distinct()
    return df.join(found, column, "left_semi" if keep else "left_anti")


def library_package(package: Column) -> Column:
    """Whether a renamed (p, digits, rest) or one-letter package is a library's; the known prefixes are under_prefixes()'."""
    return package.rlike(rf"^p\d++(?:j\$|j\z|.*(?i:{'|'.join(fixed.LIBRARY_WORDS)}))|^[a-z]\z")


def first_package(content: Column, path: Column) -> Column:
    """The package that a file's first line of code declares, else the folders below `sources`, else empty."""
    first = trimmed(F.coalesce(F.regexp_extract(content, r"\A(?:\s*+(?://|/?\*)[^\r\n]*+)*+\s*+([^\r\n]*+)", 1), F.lit("")))  # reads no further than that line
    folder = F.regexp_replace(path, "/[^/]*$", "")
    below = F.regexp_replace(F.regexp_extract(folder, "^.*?sources/(.*)$", 1), "/", ".")
    return F.when(first.startswith("package "), trimmed(F.regexp_replace(F.substring(first, 9, 1 << 30), ";$", ""))).otherwise(below)


def package_prefix(package: Column) -> Column:
    """The part of a package that names its owner: two or three words."""
    words = F.split(package, r"\.")
    n = F.when(words[0].isin("androidx", "org", "io"), 2).otherwise(3)
    return F.array_join(F.slice(words, 1, n), ".")


def encrypted_strings(content: Column) -> Column:
    """Signs of encrypted strings."""
    return reduce(lambda a, b: a | b, [content.rlike(p) for p in fixed.STRING_ENCRYPTION])


def class_counts(files: DataFrame) -> DataFrame:
    """Files, files with an obfuscated name, obfuscated methods, and names of two letters at most, of (path, content)."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    bad = F.size(F.filter(F.regexp_extract_all("content", F.lit(fixed.METHOD), F.lit(1)), obfuscated))
    return files.agg(F.count("*").alias("n_classes"), F.count_if(obfuscated(name)).alias("n_obfuscated"), F.sum(bad).cast("long").alias("n_methods"), F.count_if(F.length(name) <= 2).alias("n_short"))


def languages(files: DataFrame) -> DataFrame:
    """has_java and has_kotlin of (path, ...)."""
    has = lambda ext: F.coalesce(F.bool_or(F.col("path").endswith(ext)), F.lit(False))
    return files.agg(has(".java").alias("has_java"), has(".kt").alias("has_kotlin"))


def undeclared_names(lines: DataFrame) -> DataFrame:
    """(path, name, line_no): arrays of a file that are assigned to and nowhere declared, with their first use."""
    kinds = "(?:int|long|short|byte|float|double|char|boolean|String|Object)"
    declared = lines.select("path", F.explode(F.regexp_extract_all("line", F.lit(rf"{kinds}(?:\s*\[\s*\]\s*|\s+)(\w+)\s*="), F.lit(1))).alias("name"))
    used = lines.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(\w+)\s*\[\s*\w+\s*\]\s*="), F.lit(1))).alias("name"))
    return used.join(declared, ["path", "name"], "left_anti").groupBy("path", "name").agg(F.min("line_no").alias("line_no"))


def lost_methods(files: DataFrame) -> DataFrame:
    """(name, n_args): the distinct calls of methods that a decompiler has lost, ten arguments at most.

    Calls of the second kind count one argument more than they have, as calls of the first kind do for their number.
    """
    short, named = fixed.LOST_CALLS
    several = lambda pattern, *groups: F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])).alias("x")
    calls = files.select(several(short, 1, 3)).select(F.col("x.g1").alias("name"), F.col("x.g3").alias("args"))
    calls = calls.unionByName(files.select(several(named, 1, 2)).select(F.col("x.g1").alias("name"), F.col("x.g2").alias("args")))
    blank, n = trimmed(F.col("args")) == "", F.size(F.split("args", ",", -1)) + 1
    return calls.select("name", F.when(blank, 0).otherwise(F.least(n, F.lit(10))).alias("n_args")).distinct()


def literal_type(expression: Column) -> Column:
    """The type of an argument, guessed from how it is written."""
    made = trimmed(F.substring_index(F.substring(expression, 5, 1 << 30), "(", 1))
    return (
        F.when(expression.rlike(r"^\d+\z"), "int").when(expression.rlike(r"^\d+L\z"), "long").when(expression.rlike(r"^\d+\.\d+\z"), "double").when(expression.rlike(r"^\d+\.\d+f\z"), "float")
        .when(expression.isin("true", "false"), "boolean").when(expression.startswith('"'), "String").when(expression.startswith("new "), made).otherwise("Object")
    )
