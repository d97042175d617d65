"""Queries over the rewrites of source files, with the DuckDB SQL that gives the same rows where SQL can express them.

Those without SQL follow the lines of a file with state; tests hold them against hand-made files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators import extract, rewrite, sequences, stubs
from siltworks.plans import corpus
from siltworks.plans.catalog import _INVALID, _SRC, QUERIES, _lines, _register, _rewrite, _values, query

_g = lambda x, p, new: f"regexp_replace({x}, '{p}', '{new}', 'g')"
_BITWISE = _g("content", r"(\w+)\s*=\s*(\(\w+\s*[&|]\s*\d+\)\s*[+\-*/]\s*\(\w+\s*[&|]\s*\d+\));", r"\1 = (int)(\2);")
_FIELDS = "content"
for _kind, _value in (("String", '""'), ("int|long|short|byte", "0"), ("float", "0.0f"), ("double", "0.0"), ("boolean", "false"), ("char", r"''\\0''"), (r"\w+", "null")):
    _FIELDS = _g(_FIELDS, rf"(public\s+)?static\s+final\s+({_kind})\s+(\w+)\s*;", rf"\1static final \2 \3 = {_value};")
_TERNARY = _g(_g("content", r"(\w+)\s*=\s*(\w+)\s*==\s*true\s*\?\s*1\s*:\s*0", r"\1 = (\2 != 0) ? 1 : 0"), r"\(int\)\s*\(\s*(\w+)\s*==\s*true\s*\?\s*1\s*:\s*0\s*\)", r"((\1 != 0) ? 1 : 0)")
_register("rewrite_bitwise_cast", rewrite.cast_bitwise, _BITWISE)
_register("rewrite_interface_fields", rewrite.interface_fields, f"CASE WHEN contains(content, 'public interface ') OR contains(content, chr(10) || 'interface ') THEN {_FIELDS} ELSE content END")
_register("rewrite_ternary", rewrite.int_ternaries, _TERNARY)
for _name, _pass in (
    ("interface_static_block", sequences.interface_static_blocks), ("orphaned_code", lambda t: sequences.orphaned_code(sequences.interface_static_blocks(t))), ("incomplete_call", sequences.incomplete_calls),
    ("array_declarations", sequences.undeclared_arrays), ("method_stubbing", sequences.stub_methods), ("unreachable_rewrite", sequences.unreachable),
):
    QUERIES[_name] = _rewrite(lambda content, f=_pass: sequences.column(f, content))


@query(f"{_SRC}, wanted(ord, name, import) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.WELL_KNOWN)])})," + r"""
needed AS (SELECT path, content, string_agg('import ' || import || ';', chr(10) ORDER BY ord) AS added FROM corpus, wanted
 WHERE contains(content, 'package ') AND contains(content, name) AND NOT contains(content, 'import ' || import) AND NOT contains(content, 'import android.graphics.*')
 AND NOT contains(content, 'import ' || regexp_replace(import, '\.[^.]*$', '') || '.*') GROUP BY path, content),
cut AS (SELECT *, CASE WHEN instr(substr(content, instr(content, 'package ')), ';') = 0 THEN 0 ELSE instr(content, 'package ') - 1 + instr(substr(content, instr(content, 'package ')), ';') END AS e FROM needed)
SELECT path, substr(content, 1, e) || chr(10) || chr(10) || added || substr(content, e + 1) AS content FROM cut
UNION ALL SELECT path, content FROM corpus WHERE path NOT IN (SELECT path FROM needed)""")
def imports_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", rewrite.insert_imports(F.col("content")).alias("content"))


_KINDS = "(?:int|long|short|byte|float|double|char|boolean|String|Object)"


@query(rf"""{_SRC}, declared AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '{_KINDS}(?:\s*\[\s*\]\s*|\s+)(\w+)\s*=', 1)) AS name FROM lines),
used AS (SELECT path, line_no, unnest(regexp_extract_all(line, '(\w+)\s*\[\s*\w+\s*\]\s*=', 1)) AS name FROM lines)
SELECT path, name, min(line_no) AS line_no FROM used u WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.path = u.path AND d.name = u.name) GROUP BY path, name""")
def undeclared_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.undeclared_names(_lines(spark, sf_dir))


# DuckDB has no lookbehind: the character before is matched along, which is the same where two calls never touch.
_LOST = r"""calls AS (SELECT regexp_extract(c, '([a-z]{2,3})\s*\(', 1) AS name, regexp_extract(c, '\(\s*\d+\s*,([^)]+)\)', 1) AS args
 FROM (SELECT unnest(regexp_extract_all(content, '(?:^|[^.\w])[a-z]{2,3}\s*\(\s*\d+\s*,[^)]+\)')) AS c FROM corpus)
 UNION ALL SELECT regexp_extract(c, '(mo?\d+\w*)\s*\(', 1), regexp_extract(c, '\(([^)]*)\)', 1) FROM (SELECT unnest(regexp_extract_all(content, '(?:^|[^.\w])mo?\d+\w*\s*\([^)]*\)')) AS c FROM corpus)),
lost AS (SELECT DISTINCT name, CAST(CASE WHEN trim(args) = '' THEN 0 ELSE least(len(string_split(args, ',')) + 1, 10) END AS INTEGER) AS n_args FROM calls)"""


@query(f"{_SRC}, {_LOST} SELECT name, n_args FROM lost")
def missing_method_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lost_methods(corpus.corpus(spark, sf_dir))


@query(f"""{_SRC}, {_LOST}, texts AS (SELECT *, '    public static Object ' || name || '(' || array_to_string(list_transform(range(0, n_args), lambda i: 'Object arg' || i), ', ') || ') ' || chr(123) || chr(10)
 || '        throw new UnsupportedOperationException("Stub method: ' || name || '");' || chr(10) || '    ' || chr(125) || chr(10) || chr(10) AS t FROM lost)
SELECT count(*) AS n, '{stubs.LOST_HEAD}' || string_agg(t, '' ORDER BY name, n_args) || chr(125) || chr(10) AS content FROM texts HAVING count(*) > 0""")
def lost_method_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs.lost_method_class(extract.lost_methods(corpus.corpus(spark, sf_dir)))


@query(f"{_SRC} SELECT path, {' OR '.join(f"regexp_matches(content, '{p}')" for p in fixed.INVALID)} OR {' OR '.join(f"contains(content, '{w}')" for w in fixed.INVALID_SHOWN)} AS invalid FROM corpus")
def invalid_file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", rewrite.is_invalid(F.col("content")).alias("invalid"))


def fixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over every Java file."""
    return rewrite.fix_files(corpus.corpus(spark, sf_dir).filter(F.col("path").endswith(".java"))).select("path", F.col("fixed").alias("content"), "n_fixes")


def degraded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below the threshold with their broken methods stubbed, after all passes."""
    done = fixed_files(spark, sf_dir).select("path", "content")
    return rewrite.degrade(done)


@query(f"{_SRC} SELECT count(*) FILTER (n < {fixed.INVALID_FILE}) AS kept, count(*) FILTER (n >= {fixed.INVALID_FILE}) AS dropped FROM (SELECT {_INVALID} AS n FROM corpus)")
def problem_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rewrite.invalid_patterns(F.col("content"))
    return corpus.corpus(spark, sf_dir).agg(F.count_if(n < fixed.INVALID_FILE).alias("kept"), F.count_if(n >= fixed.INVALID_FILE).alias("dropped"))


_BASE = r"regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')"


@query(rf"""{_SRC} SELECT count(*) AS n_classes, count(*) FILTER (regexp_matches({_BASE}, '{fixed.OBFUSCATED}')) AS n_obfuscated,
 CAST(sum(len(list_filter(regexp_extract_all(content, '{fixed.METHOD}', 1), lambda m: regexp_matches(m, '{fixed.OBFUSCATED}')))) AS BIGINT) AS n_methods, count(*) FILTER (len({_BASE}) <= 2) AS n_short FROM corpus""")
def obfuscated_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.class_counts(corpus.corpus(spark, sf_dir))


@query(f"{_SRC} SELECT bool_or(path LIKE '%.java') AS has_java, bool_or(path LIKE '%.kt') AS has_kotlin FROM corpus")
def source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.languages(corpus.corpus(spark, sf_dir))


@query(f"{_SRC} SELECT path FROM corpus WHERE {' OR '.join(f"regexp_matches(content, '{p}')" for p in fixed.STRING_ENCRYPTION)}")
def string_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).filter(extract.encrypted_strings(F.col("content"))).select("path")


for _f in (fixed_files, degraded_files):
    QUERIES[_f.__name__] = _f
