"""Queries by name, with the DuckDB SQL that gives the same rows.

Source-code queries run on the corpus of siltworks.plans.corpus, the others on the driver's tables as stand-in inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import fixed, resources
from siltworks.operators import extract, facts, organize, report, resolve, rewrite
from siltworks.plans import corpus
from siltworks.session import table
from siltworks.sources.files import lines_of, zip_route

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(corpus.corpus(spark, sf_dir))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_SRC = "WITH " + corpus.SQL
_DIM = f"dim(ord, prefix, group_id, artifact_id, version) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.LIBRARIES)])})"
_AX = f"ax(ord, prefix, group_id, artifact_id, version) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.ANDROIDX)])})"
_IMPORTS = r"""imports AS (SELECT path, line_no, regexp_replace(CASE WHEN path LIKE '%.kt' THEN trim(split_part(trim(line)[8:], ' as ', 1))
 ELSE trim(regexp_replace(regexp_replace(trim(line)[8:], '^static ', ''), ';$', '')) END, '\.\*$', '') AS import FROM lines WHERE trim(line) LIKE 'import %')"""
_PACKAGES = """packages AS (SELECT path, line_no, CASE WHEN path LIKE '%.kt' THEN trim(trim(line)[9:]) ELSE trim(regexp_replace(trim(line)[9:], ';$', '')) END AS package FROM lines WHERE trim(line) LIKE 'package %')"""
_ALL_PACKAGES = r"""all_packages AS (SELECT package, min(struct_pack(path := path, line_no := line_no)) AS place FROM (
 SELECT package, path, line_no FROM packages UNION ALL SELECT regexp_extract(import, '^(.*)\.', 1), path, line_no FROM imports WHERE contains(import, '.')) GROUP BY package)"""
_CATEGORY = f"""CASE WHEN package LIKE 'android.%' OR package LIKE 'java.%' OR package LIKE 'javax.%' THEN 'platform' WHEN package LIKE 'androidx.%' THEN 'androidx'
 WHEN package LIKE 'com.google.android.gms%' OR package LIKE 'com.google.firebase%' THEN 'google'
 WHEN {' OR '.join(f"starts_with(package, '{p}')" for p in fixed.THIRD_PARTY)} THEN 'third_party' ELSE 'app' END"""
_LIBRARY_HITS = """library_hits AS (SELECT * FROM (SELECT i.import, i.place, d.*, row_number() OVER (PARTITION BY i.import ORDER BY i.import <> d.prefix, d.ord) AS n
 FROM (SELECT import, min(struct_pack(path := path, line_no := line_no)) AS place FROM imports GROUP BY import) i JOIN dim d ON starts_with(i.import, d.prefix)) WHERE n = 1)"""
_AX_HITS = f"""ax_hits AS (SELECT * FROM (SELECT p.package, p.place, d.*, row_number() OVER (PARTITION BY p.package ORDER BY d.ord) AS n
 FROM all_packages p JOIN ax d ON starts_with(p.package, d.prefix) WHERE {_CATEGORY} = 'androidx') WHERE n = 1)"""
_GOOGLE = f"google(ord, prefix, group_id, artifact_id, version, confidence) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.GOOGLE)])})"
_STAGED = f"""{_SRC}, {_IMPORTS}, {_PACKAGES}, {_ALL_PACKAGES}, {_DIM}, {_AX}, {_GOOGLE}, {_LIBRARY_HITS}, {_AX_HITS},
google_hits AS (SELECT * FROM (SELECT p.package, p.place, d.*, row_number() OVER (PARTITION BY p.package ORDER BY d.ord) AS n FROM all_packages p JOIN google d ON starts_with(p.package, d.prefix) WHERE {_CATEGORY} = 'google') WHERE n = 1),
third_hits AS (SELECT * FROM (SELECT p.package, p.place, d.*, row_number() OVER (PARTITION BY p.package ORDER BY p.package <> d.prefix, d.ord) AS n FROM all_packages p JOIN dim d ON starts_with(p.package, d.prefix) WHERE {_CATEGORY} = 'third_party') WHERE n = 1),
staged AS (SELECT group_id || ':' || artifact_id AS coordinate, version, CAST(0.95 AS FLOAT) AS confidence, 0 AS stage, place FROM ax_hits
 UNION ALL SELECT group_id || ':' || artifact_id, version, CAST(confidence AS FLOAT), 1, place FROM google_hits
 UNION ALL SELECT group_id || ':' || artifact_id, version, CAST(0.85 AS FLOAT), 2, place FROM third_hits
 UNION ALL SELECT group_id || ':' || artifact_id, version, CAST(0.85 AS FLOAT), 3, place FROM library_hits)"""
_UNKNOWN = f"""{_STAGED}, known AS (SELECT DISTINCT split_part(coordinate, ':', 1) AS known FROM staged UNION SELECT unnest({list(fixed.PLATFORM)})),
unknown AS (SELECT regexp_extract(import, '([^.]*)$', 1) AS name, min(struct_pack(path := path, line_no := line_no)) AS place FROM imports i WHERE NOT EXISTS (SELECT 1 FROM known k WHERE starts_with(i.import, k.known)) GROUP BY 1),
top AS (SELECT name, place FROM unknown ORDER BY place, name LIMIT 15)"""
_FITS = f"""NOT ({' OR '.join(f"starts_with(group_id, '{g}')" for g in fixed.GROUP_BLACKLIST)}) AND ({' OR '.join(f"starts_with(group_id, '{g}')" for g in fixed.GROUP_WHITELIST)} OR NOT ({' OR '.join(f"contains(group_id, '{w}')" for w in fixed.GROUP_WORDS)}))"""
_FOUND = f"""{_UNKNOWN}, lookup(name, ord, group_id, artifact_id, version) AS (VALUES {_values(list(corpus.LOOKUP))}),
looked AS (SELECT * FROM (SELECT l.*, top.place, row_number() OVER (PARTITION BY l.name ORDER BY l.ord) AS n FROM lookup l JOIN top USING (name) WHERE {_FITS}) WHERE n = 1)"""
_WRITTEN = """(SELECT coordinate, arg_max(version, (stage, place, version)) AS version, arg_max(confidence, (stage, place, version)) AS confidence,
 min(stage) AS first_stage, arg_min(place, (stage, place)) AS place FROM {} GROUP BY coordinate)"""
_CORE = f"""SELECT '{':'.join(fixed.MATERIAL[:2])}' AS coordinate, '{fixed.MATERIAL[2]}' AS version
 WHERE EXISTS (SELECT 1 FROM {{0}} WHERE coordinate LIKE '%appcompat%') AND NOT EXISTS (SELECT 1 FROM {{0}} WHERE coordinate = '{':'.join(fixed.MATERIAL[:2])}')
 AND EXISTS (SELECT 1 FROM all_packages WHERE package LIKE 'androidx.%')"""
_RESOLVED = f"""{_FOUND},
every_stage AS (SELECT * FROM staged UNION ALL SELECT group_id || ':' || artifact_id, version, CAST(0.75 AS FLOAT), 4, place FROM looked),
written AS {_WRITTEN.format("every_stage")},
resolved AS (SELECT coordinate, version, confidence, first_stage, place.path AS path, place.line_no AS line_no FROM written
 UNION ALL SELECT coordinate, version, CAST(0.9 AS FLOAT), 5, NULL, NULL FROM ({_CORE.format("written")}))"""


def _summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(imports, packages), distinct, with their first places: the corpus is read once for both."""
    found = facts.summary(corpus.corpus(spark, sf_dir), ("package", "import"))
    return facts.named(found, "import"), facts.named(found, "package")


def _all_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared packages and those of imports."""
    return facts.facts(corpus.corpus(spark, sf_dir), ("package", "import")).filter("kind = 'package'").select(F.col("name").alias("package")).distinct()


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(spark, *_summary(spark, sf_dir), corpus.lookup(spark))


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(imports, dependencies found without a lookup)."""
    imports, packages = _summary(spark, sf_dir)
    return imports, resolve.hits(spark, imports, packages)


@query(_RESOLVED + " SELECT coordinate, version, confidence, first_stage FROM resolved")
def dependency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.in_order(_resolved(spark, sf_dir)).select("coordinate", "version", "confidence", "first_stage")


@query(_RESOLVED + " SELECT coordinate, row_number() OVER (ORDER BY confidence DESC, first_stage, path, line_no, coordinate) AS position FROM resolved")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the report: a few hundred rows at most, however large the tree."""
    place = Window.orderBy(F.desc("confidence"), "first_stage", "path", "line_no", "coordinate")
    return _resolved(spark, sf_dir).select("coordinate", F.row_number().over(place).cast("long").alias("position"))


@query(_RESOLVED + " SELECT count(*) AS n_libraries, count(*) FILTER (confidence >= CAST(0.8 AS FLOAT)) AS n_sure FROM resolved")
def dependency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.statistics(_resolved(spark, sf_dir))


@query(_FOUND + " SELECT name, group_id, artifact_id, version FROM looked")
def static_lookup_first_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.look_up(resolve.first_unknown(spark, *_known(spark, sf_dir)), corpus.lookup(spark))


@query(_RESOLVED + " SELECT CASE WHEN confidence >= CAST(0.8 AS FLOAT) THEN 'high' WHEN confidence >= CAST(0.6 AS FLOAT) THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM resolved GROUP BY 1")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy(resolve.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query(_RESOLVED + " SELECT coordinate, version FROM resolved WHERE confidence >= CAST(0.85 AS FLOAT)")
def build_dependency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter(F.col("confidence") >= F.lit(0.85).cast("float")).select("coordinate", "version")


@query(f"{_RESOLVED} SELECT coordinate, version FROM written UNION ALL {_CORE.format('written')}")
def conditional_put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports, packages = _summary(spark, sf_dir)
    every = resolve.last_written(resolve.staged(spark, imports, packages, corpus.lookup(spark))).select("coordinate", "version")
    return report.put_if_absent(every, "appcompat", ":".join(fixed.MATERIAL[:2]), fixed.MATERIAL[2], packages)


@query(f"{_SRC}, {_IMPORTS} SELECT DISTINCT import FROM imports")
def import_extract_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(_lines(spark, sf_dir)).select("import").distinct()


@query(f"{_SRC}, {_PACKAGES} SELECT path, line_no, package FROM packages")
def package_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.packages(_lines(spark, sf_dir))


_CLASS = f"CASE WHEN path LIKE '%.kt' THEN regexp_extract(line, '{fixed.KOTLIN_CLASS}', 2) ELSE regexp_extract(line, '{fixed.CLASS}', 1) END"


@query(rf"{_SRC} SELECT path, line_no, {_CLASS} AS class FROM lines WHERE {_CLASS} <> ''")
def class_decl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classes(_lines(spark, sf_dir))


@query(rf"{_SRC} SELECT path, line_no, unnest(regexp_extract_all(line, '{fixed.METHOD}', 1)) AS method FROM lines")
def method_name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.methods(_lines(spark, sf_dir))


@query(f"{_SRC}, {_IMPORTS}, {_PACKAGES}, {_ALL_PACKAGES} SELECT {_CATEGORY} AS category, count(*) AS n FROM all_packages GROUP BY 1")
def package_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _all_packages(spark, sf_dir)
    return every.groupBy(extract.category(F.col("package")).alias("category")).agg(F.count("*").alias("n"))


@query(f"{_SRC}, {_IMPORTS}, {_DIM}, {_LIBRARY_HITS} SELECT import, prefix, group_id, artifact_id FROM library_hits")
def prefix_join_exact_then_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_match(extract.imports(_lines(spark, sf_dir)), "import", resolve.dimension(spark, fixed.LIBRARIES), True).select("import", "prefix", "group_id", "artifact_id")


@query(f"{_SRC}, {_IMPORTS}, {_PACKAGES}, {_ALL_PACKAGES}, {_AX}, {_AX_HITS} SELECT package, prefix, artifact_id FROM ax_hits")
def prefix_join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _all_packages(spark, sf_dir).filter(extract.category(F.col("package")) == "androidx")
    return resolve.first_match(every, "package", resolve.dimension(spark, fixed.ANDROIDX)).select("package", "prefix", "artifact_id")


@query(_UNKNOWN + " SELECT name, place.path AS path, place.line_no AS line_no FROM unknown")
def unknown_imports_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unknown_imports(spark, *_known(spark, sf_dir))


@query(_UNKNOWN + " SELECT name FROM top")
def unknown_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_unknown(spark, *_known(spark, sf_dir)).select("name")


def _below(column: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"({column} = '{p}' OR starts_with({column}, '{p}.'))" for p in prefixes) + ")"


@query(f"{_SRC}, {_IMPORTS} SELECT path, import FROM imports WHERE {_below('import', fixed.SDK_PACKAGES)}")
def sdk_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.under_prefixes(extract.imports(_lines(spark, sf_dir)).select("path", "import"), "import", organize.prefix_table(spark, fixed.SDK_PACKAGES), True)


_LIBRARY = rf"""({_below('package', fixed.LIBRARY_PACKAGES)} OR regexp_matches(package, '^[a-z]$') OR (regexp_matches(package, '^p\d+') AND
 (regexp_matches(regexp_replace(package, '^p\d+', ''), '^(j\$|j$)') OR {' OR '.join(f"contains(lower(regexp_replace(package, '^p[0-9]+', '')), '{w}')" for w in fixed.LIBRARY_WORDS)})))"""


@query(f"{_SRC}, {_PACKAGES} SELECT path, package FROM packages WHERE NOT {_LIBRARY}")
def library_exclusion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = extract.packages(_lines(spark, sf_dir)).select("path", "package")
    return extract.under_prefixes(named, "package", organize.prefix_table(spark, fixed.LIBRARY_PACKAGES), False).filter(~extract.library_package(F.col("package")))


_TOKENS = r"tokens AS (SELECT source, unnest(regexp_extract_all(text, '\pL[\pL0-9_]*')) AS token FROM documents)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}0-9_]*"), F.lit(0))).alias("token"))


@query(f"WITH {_TOKENS} SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(token, '{fixed.OBFUSCATED}')) AS bad FROM tokens GROUP BY source")
def obfuscated_name_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(extract.obfuscated(F.col("token"))).alias("bad"))


@query(f"""WITH {_TOKENS}, counted AS (SELECT source, CAST(CAST(count(*) FILTER (regexp_matches(token, '{fixed.OBFUSCATED}')) AS DOUBLE) / count(*) AS FLOAT) AS r FROM tokens GROUP BY source)
SELECT source, CASE WHEN CAST(r AS DOUBLE) < 0.1 THEN 'NONE' WHEN CAST(r AS DOUBLE) < 0.3 THEN 'LIGHT' WHEN CAST(r AS DOUBLE) < 0.6 THEN 'MODERATE' ELSE 'HEAVY' END AS level FROM counted""")
def obfuscation_level_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = obfuscated_name_flag(spark, sf_dir)
    return counts.select("source", extract.obfuscation_level(F.col("bad"), F.col("n")).alias("level"))


@query("""WITH d AS (SELECT CAST(len(string_split(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/')) AS INTEGER) AS depth FROM pages),
h AS (SELECT depth, count(*) AS n FROM d GROUP BY depth)
SELECT depth, n, (SELECT coalesce(sum(n) FILTER (depth <= 2), 0) > 3 * coalesce(sum(n) FILTER (depth > 2), 0) FROM h) AS flattened FROM h""")
def depth_histogram_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.size(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "/"))
    return report.depth_histogram(table(spark, sf_dir, "pages").select(depth.alias("depth")))


_BARE = "NOT contains(content, '// ') AND NOT contains(content, '/* ')"


@query(f"{_SRC}, s AS (SELECT content FROM corpus WHERE path LIKE '%.java' ORDER BY path LIMIT 20) SELECT count(*) AS n, count(*) FILTER ({_BARE}) AS absent, count(*) FILTER ({_BARE}) > count(*) * 0.8 AS flagged FROM s")
def sampled_comment_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = corpus.corpus(spark, sf_dir).filter(F.col("path").endswith(".java")).orderBy("path").limit(20)
    absent = F.count_if(~F.col("content").contains("// ") & ~F.col("content").contains("/* "))
    return sample.agg(F.count("*").alias("n"), absent.alias("absent"), (absent > F.count("*") * F.lit(0.8)).alias("flagged"))


@query(rf"{_SRC}, c AS (SELECT path, {_CLASS} AS class FROM lines) SELECT path, class, regexp_matches(class, '^I[A-Z]|(Listener|Callback|Handler|Observer)$') AS is_interface FROM c WHERE class <> ''")
def interface_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classes(_lines(spark, sf_dir)).select("path", "class", F.col("class").rlike("^I[A-Z]|(?:Listener|Callback|Handler|Observer)$").alias("is_interface"))


_MARKED = "(" + " OR ".join(f"contains(content, '{m}')" for m in fixed.ERROR_MARKERS) + ")"


@query(f"{_SRC} SELECT path, {_MARKED} AS failed FROM corpus")
def error_marker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", report.error_marker(F.col("content")).alias("failed"))


def _rewrite(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: corpus.corpus(spark, sf_dir).select("path", f(F.col("content")).alias("content"))


def _register(name: str, f: Callable, sql: str) -> None:
    QUERIES[name] = _rewrite(f)
    ORACLE_SQL[name] = f"{_SRC} SELECT path, {sql} AS content FROM corpus"


_r = lambda x, p, new: f"regexp_replace({x}, '{p}', '{new}', 'g')"
_UNKNOWN_TYPES = f"regexp_replace({_r(_r('content', r'\?\?\s+(\w+)\s*;', r'Object \1;'), r'\?\?\s+(\w+)\s*=\s*([^;]+);', r'Object \1 = \2;')}, '(?m)^\\s*\\?\\?\\s*[^;]*;?\\s*$', '// JADX FIX: removed unknown type', 'g')"
_CALLS = _r(_r(_r("content", r"\(\s*,\s*\)", "()"), r"\(\s*,", "(null,"), r",\s*\)", ")")
_BOOL = "content"
for _op, _word, _new in (("==", "true", "!= 0"), ("==", "false", "== 0"), ("!=", "true", "== 0"), ("!=", "false", "!= 0")):
    _BOOL = _r(_BOOL, rf"(\w+)\s*{_op}\s*{_word}", rf"\1 {_new}")
_CODE = r"""regexp_replace(content, '(?s)"(\\.|[^"\\])*("|\\?\z)|''(\\.|[^''\\])*(''|\\?\z)|//[^\n]*|/\*.*?(\*/|\z)', '', 'g')"""
_BALANCE = f"(len(regexp_replace({_CODE}, '[^{{]', '', 'g')) - len(regexp_replace({_CODE}, '[^}}]', '', 'g')))"
_register("rewrite_unknown_type", rewrite.unknown_types, _UNKNOWN_TYPES)
_register("rewrite_malformed_calls", rewrite.malformed_calls, _CALLS)
_register("rewrite_int_boolean", rewrite.int_booleans, _BOOL)
_register("closing_brace_repair", rewrite.close_braces, f"CASE WHEN {_BALANCE} > 0 THEN regexp_replace(content, '\\s+\\z', '') || chr(10) || repeat(chr(125) || chr(10), CAST({_BALANCE} AS BIGINT)) ELSE content END")


@query(f"{_SRC} SELECT path, CAST({_BALANCE} AS BIGINT) AS balance FROM corpus")
def brace_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", rewrite.brace_balance(F.col("content")).cast("long").alias("balance"))


@query(f"{_SRC}, wanted(ord, name, import) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.WELL_KNOWN)])})" + r"""
SELECT path, 'import ' || import || ';' AS added FROM corpus, wanted WHERE contains(content, 'package ') AND contains(content, name) AND NOT contains(content, 'import ' || import)
 AND NOT contains(content, 'import android.graphics.*') AND NOT contains(content, 'import ' || regexp_replace(import, '\.[^.]*$', '') || '.*')""")
def missing_imports_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", F.explode(rewrite.missing_imports(F.col("content"))).alias("added"))


_INVALID = " + ".join([*(f"len(regexp_extract_all(content, '{p}'))" for p in fixed.INVALID), *(f"len(regexp_extract_all(content, '{w}'))" for w in fixed.INVALID_COUNTED)])


@query(f"{_SRC} SELECT path, CAST({_INVALID} AS BIGINT) AS n FROM corpus")
def invalid_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", rewrite.invalid_patterns(F.col("content")).cast("long").alias("n"))


@query(f"{_SRC} SELECT path FROM corpus WHERE {_INVALID} < {fixed.INVALID_FILE}")
def drop_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).filter(rewrite.invalid_patterns(F.col("content")) < fixed.INVALID_FILE).select("path")


@query(f"""{_SRC}, e AS (SELECT *, trim(line) AS t, CASE WHEN regexp_matches(trim(line), '^(return |return;|throw )') AND trim(line) LIKE '%;' THEN 'end'
 WHEN regexp_matches(trim(line), '^([}}]|else|case |default:|catch|finally)') THEN 'resume' END AS event FROM lines),
s AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM e)
SELECT path, line_no, line FROM s WHERE state = 'end' AND NOT regexp_matches(t, '^([}}]|else|case |default:|catch|finally)') AND t <> '' AND t NOT LIKE '//%'""")
def unreachable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.unreachable(_lines(spark, sf_dir)).filter("dead").select("path", "line_no", "line")


_LINE_CODE = r"""regexp_replace(line, '"(\\.|[^"\\])*("|\\?$)|''(\\.|[^''\\])*(''|\\?$)', '', 'g')"""
_LINE_BALANCE = f"(len(regexp_replace({_LINE_CODE}, '[^{{]', '', 'g')) - len(regexp_replace({_LINE_CODE}, '[^}}]', '', 'g')))"
_METHOD = f"""(regexp_matches(a.t, '{fixed.METHOD_DECLARATION}') AND NOT ({' OR '.join(f"starts_with(a.t, '{w}') OR contains(a.t, ' {w}')" for w in fixed.TYPE_WORDS)}))"""


@query(rf"""{_SRC}, d AS (SELECT *, trim(line) AS t, {_LINE_BALANCE} AS d FROM lines),
s AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY line_no) AS run FROM d)
SELECT a.path, a.line_no, min(b.line_no) AS end_no FROM s a JOIN s b ON a.path = b.path AND b.line_no >= a.line_no AND b.line_no <= a.line_no + 501 AND b.run = a.run - a.d
WHERE {_METHOD} GROUP BY a.path, a.line_no""")
def method_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.method_spans(_lines(spark, sf_dir))


_PATHS = "paths AS (SELECT p_partkey AS k, concat('res/', CASE p_partkey % 6 WHEN 0 THEN 'values-ko' WHEN 1 THEN 'drawable-hdpi-v4' WHEN 2 THEN 'layout' WHEN 3 THEN 'Mipmap-xhdpi' WHEN 4 THEN 'odd' ELSE 'xml' END, '/', replace(p_name, ' ', '-'), CASE WHEN p_partkey % 2 = 0 THEN '.xml' ELSE '.9.png' END) AS path FROM part)"
_TYPES = list(resources.TYPES)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _PATHS[_PATHS.index("concat(") : _PATHS.rindex(" AS path")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(expr).alias("path"))


_KIND = "lower(string_split(string_split(path, '/')[2], '-')[1])"


@query(f"WITH {_PATHS} SELECT CASE WHEN list_contains({_TYPES}, {_KIND}) THEN upper({_KIND}) ELSE 'UNKNOWN' END AS type, count(*) AS n FROM paths GROUP BY 1")
def resource_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(resources.resource_type(F.split("path", "/")[1]).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {_PATHS} SELECT k, array_to_string(string_split(string_split(path, '/')[2], '-')[2:], ',') AS qualifiers FROM paths")
def resource_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("k", F.array_join(resources.qualifiers(F.split("path", "/")[1]), ",").alias("qualifiers"))


@query(rf"""WITH {_PATHS}, f AS (SELECT k, regexp_extract(path, '[^/]*$') AS name FROM paths), s AS (SELECT k, name,
 regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '\.[^.]*$', '')), '[^a-z0-9_]', '_', 'g'), '^[_0-9]+', ''), '_+', '_', 'g') AS base FROM f)
SELECT k, CASE WHEN base = '' THEN 'res_' ELSE base END || regexp_extract(name, '\.[^.]+$') AS name FROM s""")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("k", resources.sanitized(F.substring_index("path", "/", -1)).alias("name"))


_ENTRIES = """entries AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'classes.dex' WHEN 1 THEN concat('classes', p_partkey, '.dex') WHEN 2 THEN concat('lib/arm64-v8a/lib', p_partkey, '.so')
 WHEN 3 THEN concat('lib/x86/lib', p_partkey, '.so') WHEN 4 THEN 'lib/x.so' WHEN 5 THEN concat('assets/a/', p_partkey) WHEN 6 THEN 'AndroidManifest.xml' ELSE 'META-INF/x' END AS entry FROM part)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_ENTRIES[_ENTRIES.index("CASE p_") : _ENTRIES.rindex(" AS entry")]).alias("entry"))


@query(f"""WITH {_ENTRIES}, r AS (SELECT CASE WHEN entry LIKE '%.dex' THEN 'dex' WHEN regexp_matches(entry, '^lib/[^/]*/.*\\.so$') THEN 'native' WHEN entry LIKE 'assets/%' THEN 'assets'
 WHEN entry = 'AndroidManifest.xml' OR entry = 'resources.arsc' OR entry LIKE 'res/%' THEN 'resources' END AS route FROM entries) SELECT route, count(*) AS n FROM r WHERE route IS NOT NULL GROUP BY route""")
def zip_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select(zip_route("entry").alias("route")).filter("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {_ENTRIES} SELECT string_split(entry, '/')[2] AS abi, count(*) AS n, min(entry) AS first FROM entries WHERE regexp_matches(entry, '^lib/[^/]*/.*\\.so$') GROUP BY 1")
def native_libs_by_abi(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = _entries(spark, sf_dir).filter(zip_route("entry") == "native")
    return native.groupBy(F.split("entry", "/")[1].alias("abi")).agg(F.count("*").alias("n"), F.min("entry").alias("first"))


@query(f"WITH {_ENTRIES} SELECT entry, CASE WHEN entry = 'classes.dex' THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(entry, '^classes([0-9]+)\\.dex$', 1) AS INTEGER), 2147483647) END AS ordinal FROM entries WHERE entry LIKE '%.dex'")
def dex_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    dex = _entries(spark, sf_dir).filter(F.col("entry").endswith(".dex"))
    return dex.select("entry", resources.dex_ordinal(F.col("entry")).alias("ordinal")).orderBy("ordinal")


_LOG = """log AS (SELECT p_partkey AS line_no, CASE p_partkey % 5 WHEN 0 THEN concat('src/a b/F', p_partkey % 9, '.java:', p_partkey % 50, ': error: cannot find symbol') WHEN 1 THEN 'processing ERROR ...'
 WHEN 2 THEN concat('INFO - loaded ', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '  classes' ELSE ' classes' END) WHEN 3 THEN CASE p_partkey % 4 WHEN 0 THEN 'ERROR - Method generation error in com.acme.Kit' WHEN 1 THEN 'ERROR - in class: com.acme.Box' WHEN 2 THEN 'ERROR in a/B.class here' ELSE 'ERROR' END ELSE 'WARN - Can''t process method com.acme.Box' END AS line FROM part)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _LOG[_LOG.index("CASE p_") : _LOG.rindex(" AS line")].replace("Can''t", "Can\\'t")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.expr(expr).alias("line"))


_ERROR = r"(.+\.java):(\d+): error: (.+)"


@query(rf"""WITH {_LOG} SELECT DISTINCT regexp_extract(regexp_extract(line, '{_ERROR}', 1), '[^/]*$') || ':' || regexp_extract(line, '{_ERROR}', 2) || ' - ' || regexp_extract(line, '{_ERROR}', 3) AS error
 FROM log WHERE regexp_matches(line, '{_ERROR}')""")
def compile_log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.compile_errors(_log(spark, sf_dir))


_KINDS = """kinds AS (SELECT *, CASE WHEN contains(line, 'processing') THEN 'progress' WHEN contains(line, 'INFO') AND contains(line, 'classes') THEN 'classes'
 WHEN contains(line, 'ERROR') THEN 'error' WHEN contains(line, 'WARN') AND contains(line, 'Can''t process') THEN 'skipped' END AS kind FROM log)"""


@query(rf"""WITH {_LOG}, {_KINDS} SELECT count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind IN ('error', 'skipped')) AS failed,
 arg_max(TRY_CAST(regexp_extract(line, '(\d+)\s+classes', 1) AS INTEGER), line_no) FILTER (kind = 'classes' AND regexp_matches(line, '\d+\s+classes')) AS classes FROM kinds""")
def decompile_log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_counters(_log(spark, sf_dir))


@query(rf"""WITH {_LOG}, {_KINDS} SELECT line_no, CASE WHEN regexp_matches(line, 'class:\s*\S+') THEN regexp_extract(line, 'class:\s*(\S+)', 1) WHEN regexp_matches(line, 'Method\s+\S+') THEN regexp_extract(line, 'Method\s+(\S+)', 1)
 WHEN regexp_matches(line, '\S+\.class') THEN regexp_extract(line, '(\S+\.class)', 1) ELSE 'Unknown' END AS class, line AS message FROM kinds WHERE kind = 'error'""")
def decompile_log_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_errors(_log(spark, sf_dir))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query(f"WITH {_DIM} SELECT ord, prefix, group_id, artifact_id, version FROM dim")
def json_dim_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.json_dimension(spark, fixed.LIBRARIES)


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN concat('com.acme.A', c_custkey % 40) WHEN c_custkey % 4 = 1 THEN concat('com.acme.A', c_custkey % 40) WHEN c_custkey % 4 = 2 THEN 'https://x.y' ELSE 'plain' END AS name FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM c WHERE name <> '' AND NOT starts_with(name, 'http') AND contains(name, '.')) SELECT k, name, k % 2 = 0 AS exported FROM n WHERE n = 1""")
def manifest_components_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE WHEN c_custkey % 4 < 2 THEN concat('com.acme.A', c_custkey % 40) WHEN c_custkey % 4 = 2 THEN 'https://x.y' ELSE 'plain' END")
    xml = F.concat(F.lit('<activity name="'), name, F.lit('" exported="'), (F.col("c_custkey") % 2 == 0).cast("string"), F.lit('"/>'))
    return resources.components(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), xml.alias("xml")))
