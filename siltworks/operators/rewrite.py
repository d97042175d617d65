"""Rewrite rules over whole files (column expressions) and line sequences (windows and grouped functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators import sequences
from siltworks.operators.extract import evaluated_once, trimmed


#: A whole word, or what the match before has left of one: (\w+) at the start of a pattern, tried once for each word.
_WORD = r"(?:(?<!\w)|\G)(\w++)"


def unknown_types(content: Column) -> Column:
    """`??` declarations become Object; other statements with it a comment."""
    x = F.regexp_replace(content, r"\?\?\s+(\w+)\s*;", r"Object $1;")
    x = F.regexp_replace(x, r"\?\?\s+(\w+)\s*=\s*([^;]+);", r"Object $1 = $2;")
    return F.regexp_replace(x, r"(?m)^\s*\?\?\s*[^;]*;?\s*$", "// JADX FIX: removed unknown type")


def malformed_calls(content: Column) -> Column:
    x = F.regexp_replace(content, r"\(\s*,\s*\)", "()")
    return F.regexp_replace(F.regexp_replace(x, r"\(\s*,", "(null,"), r",\s*\)", ")")


def int_booleans(content: Column) -> Column:
    made = content
    for op, word, new in (("==", "true", "!= 0"), ("==", "false", "== 0"), ("!=", "true", "== 0"), ("!=", "false", "!= 0")):
        made = F.regexp_replace(made, rf"{_WORD}\s*+{op}\s*+{word}", f"$1 {new}")
    return F.when(content.contains("true") | content.contains("false"), made).otherwise(content)


def missing_imports(content: Column) -> Column:
    """Imports of well-known classes that a file with a package mentions but doesn't import, in their order."""
    each = []
    for name, path in fixed.WELL_KNOWN:
        wild = path.rpartition(".")[0] + ".*"
        each.append(F.when(content.contains(name) & ~content.contains(f"import {path}") & ~content.contains("import android.graphics.*") & ~content.contains(f"import {wild}"), F.lit(f"import {path};")))
    return F.when(content.contains("package "), F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def insert_imports(content: Column) -> Column:
    """content with missing_imports() after the semicolon of its package; at the start if there is none."""
    added = missing_imports(content)
    end = F.position(F.lit(";"), content, F.position(F.lit("package "), content))
    whole = F.concat(F.substring(content, F.lit(1), end), F.lit("\n\n"), F.array_join(added, "\n"), F.substring(content, end + 1, F.length(content)))
    return F.when(F.size(added) > 0, whole).otherwise(content)


def cast_bitwise(content: Column) -> Column:
    """Sums and products of masked values, assigned, get an int cast."""
    return F.regexp_replace(content, _WORD + r"\s*+=\s*+(\(\w+\s*[&|]\s*\d+\)\s*[+\-*/]\s*\(\w+\s*[&|]\s*\d+\));", "$1 = (int)($2);")


#: Default of a constant by its type, the last for all other types. Fixed values.
CONSTANTS = (("String", '""'), ("int|long|short|byte", "0"), ("float", "0.0f"), ("double", "0.0"), ("boolean", "false"), ("char", r"'\\0'"), (r"\w+", "null"))


def interface_fields(content: Column) -> Column:
    """Constants without a value get a default, in files that mention an interface."""
    made = content
    for kind, value in CONSTANTS:
        made = F.regexp_replace(made, rf"(public\s+)?static\s+final\s+({kind})\s+(\w+)\s*;", f"$1static final $2 $3 = {value};")
    return F.when(content.contains("public interface ") | content.contains("\ninterface "), made).otherwise(content)


def int_ternaries(content: Column) -> Column:
    """Comparisons with true in ternaries of 1 and 0; after int_booleans() none is left."""
    x = F.regexp_replace(content, _WORD + r"\s*+=\s*+(\w+)\s*==\s*true\s*\?\s*1\s*:\s*0", "$1 = ($2 != 0) ? 1 : 0")
    return F.regexp_replace(x, r"\(int\)\s*\(\s*(\w+)\s*==\s*true\s*\?\s*1\s*:\s*0\s*\)", "(($1 != 0) ? 1 : 0)")


_LITERALS = r"""(?s)"(?:\\.|[^"\\])*+(?:"|\\?\z)|'(?:\\.|[^'\\])*+(?:'|\\?\z)|//[^\n]*+|/\*.*?(?:\*/|\z)"""


def brace_balance(content: Column) -> Column:
    """Opening minus closing braces outside of strings, characters and comments."""
    code = F.regexp_replace(content, _LITERALS, "")
    return F.length(F.replace(code, F.lit("}"), F.lit(""))) - F.length(F.replace(code, F.lit("{"), F.lit("")))


def close_braces(content: Column) -> Column:
    n = brace_balance(content)
    return F.when(n > 0, F.concat(F.regexp_replace(content, r"\s+\z", ""), F.lit("\n"), F.repeat(F.lit("}\n"), n))).otherwise(content)


def invalid_patterns(content: Column) -> Column:
    """Matches of the invalid patterns and of the compiler's words."""
    total = F.lit(0)
    for p in fixed.INVALID:
        total = total + F.regexp_count(content, F.lit(p))
    for words in fixed.INVALID_COUNTED:
        total = total + F.regexp_count(content, F.lit(words))
    return total


def is_invalid(content: Column) -> Column:
    found = F.lit(False)
    for p in fixed.INVALID:
        found = found | content.rlike(p)
    for words in fixed.INVALID_SHOWN:
        found = found | content.contains(words)
    return found


def unreachable(lines: DataFrame) -> DataFrame:
    """lines with dead: after a return or throw statement, up to a line that starts a new branch or block end.

    The last line before (in order) that either ends or resumes the flow decides, which a running last() gives.
    """
    t = trimmed(F.col("line"))
    ends = (t.startswith("return ") | t.startswith("return;") | t.startswith("throw ")) & t.endswith(";")
    resumes = t.rlike(r"^(?:\}|else|case |default:|catch|finally)")
    event = F.when(ends, "end").when(resumes, "resume")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(F.col("_event"), ignorenulls=True).over(before), F.lit("resume"))
    return lines.withColumn("_event", event).withColumn("dead", (state == "end") & ~resumes & (t != "") & ~t.startswith("//")).drop("_event")


_STRINGS = r"""\"(?:\\.|[^\"\\])*+(?:\"|\\?\z)|'(?:\\.|[^'\\])*+(?:'|\\?\z)"""


def is_method(line: Column) -> Column:
    """Whether a line declares a method."""
    t = trimmed(line)
    ruled_out = F.lit(False)
    for w in fixed.TYPE_WORDS:
        ruled_out = ruled_out | t.startswith(w) | t.contains(f" {w}")
    return ~ruled_out & t.rlike(fixed.METHOD_DECLARATION)


def method_spans(lines: DataFrame, most: int = sequences.METHOD_REACH) -> DataFrame:
    """(path, line_no, end_no) of methods: the first line, at most `most` further, at which their braces are closed.

    Strings end with their line and comments count; a method may end on its own line.
    """
    code = F.regexp_replace("line", _STRINGS, "")
    depth = F.length(F.regexp_replace(code, r"[^{]", "")) - F.length(F.regexp_replace(code, r"[^}]", ""))
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lines.withColumn("_d", depth).withColumn("_sum", F.sum("_d").over(run))
    starts = summed.filter(is_method(F.col("line"))).select("path", "line_no", (F.col("_sum") - F.col("_d")).alias("_base"))
    ends = summed.select(F.col("path").alias("_p"), F.col("line_no").alias("end_no"), "_sum")
    met = starts.join(ends, (F.col("path") == F.col("_p")) & (F.col("end_no") >= F.col("line_no")) & (F.col("end_no") <= F.col("line_no") + most) & (F.col("_sum") == F.col("_base")))
    return met.groupBy("path", "line_no").agg(F.min("end_no").alias("end_no"))


def _lines(f):
    return lambda content: sequences.column(f, content)


#: The passes over a file, in their order.
PASSES = (
    unknown_types, cast_bitwise, _lines(sequences.unreachable), malformed_calls, insert_imports, _lines(sequences.incomplete_calls), interface_fields,
    _lines(sequences.interface_static_blocks), _lines(sequences.orphaned_code), int_booleans, int_ternaries, _lines(sequences.undeclared_arrays), close_braces,
)


def fix_files(files: DataFrame) -> DataFrame:
    """files (path, content) with fixed (the content after all passes) and n_fixes (passes that changed it)."""
    out = files.withColumn("fixed", F.col("content")).withColumn("n_fixes", F.lit(0))
    for f in PASSES:  # a pass hands on one text and a number, not the texts of the passes before
        made = out.withColumn("_new", f(F.col("fixed")))
        out = made.select(*files.columns, F.col("_new").alias("fixed"), (F.col("n_fixes") + (F.col("fixed") != F.col("_new")).cast("int")).alias("n_fixes"))
    return out


def changed_only(files: DataFrame) -> DataFrame:
    """(path, content) of the files of fix_files() whose content changed: what is written, to a new place."""
    return files.filter("fixed <> content").select("path", F.col("fixed").alias("content"))


def degrade(files: DataFrame, threshold: int = fixed.INVALID_FILE) -> DataFrame:
    """(path, content, n_stubbed and files' other columns) of the files below the threshold of invalid patterns, with broken methods stubbed."""
    note = sequences.STUB_NOTES[0].split(" - ")[0]
    counted = evaluated_once(files, "_n", invalid_patterns(F.col("content")))
    kept = counted.filter(F.col("_n") < threshold).withColumn("_new", sequences.column(sequences.stub_methods, F.col("content")))
    others = [c for c in files.columns if c not in ("path", "content")]
    return kept.select("path", F.col("_new").alias("content"), *others, (F.regexp_count("_new", F.lit(note)) - F.regexp_count("content", F.lit(note))).alias("n_stubbed"))
