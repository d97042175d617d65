"""Queries over packaged trees: target paths, stubs, manifests, build files and resources, each with its DuckDB SQL.

Manifests, resource files and outputs of tools are derived from the driver's tables, as these hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import fixed, resources
from siltworks.operators import extract, manifest, organize, report, resolve, stubs, usage
from siltworks.plans import corpus
from siltworks.plans.catalog import _ALL_PACKAGES, _ENTRIES, _IMPORTS, _LIBRARY, _MARKED, _PACKAGES, _PATHS, _RESOLVED, _SRC, _TYPES, _all_packages, _below, _entries, _lines, _paths, _resolved, query
from siltworks.session import materialised, table
from siltworks.sources import files

_FIRST = r"""code AS (SELECT path, arg_min(trim(line), line_no) AS t FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(//|/\*|\*)') GROUP BY path),
named AS (SELECT c.path, content, CASE WHEN t LIKE 'package %' THEN trim(regexp_replace(t[9:], ';$', '')) ELSE replace(regexp_extract(regexp_replace(c.path, '/[^/]*$', ''), '^.*?sources/(.*)$', 1), '/', '.') END AS package
 FROM corpus c LEFT JOIN code USING (path))"""


@query(f"{_SRC}, {_FIRST} SELECT path, package FROM named")
def first_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", extract.first_package(F.col("content"), F.col("path")).alias("package"))


_TARGETS = f"""targets AS (SELECT path, package, content, CASE WHEN path LIKE '%.kt' THEN 'kotlin' ELSE 'java' END || '/' || CASE WHEN package = '' THEN '' ELSE replace(package, '.', '/') || '/' END || regexp_extract(path, '[^/]*$') AS target
 FROM named WHERE NOT {_LIBRARY})"""


@query(f"""{_SRC}, {_FIRST}, {_TARGETS} SELECT target, max(path) AS path, arg_max(package, path) AS package, arg_max(CASE WHEN path LIKE '%.kt' THEN 'KOTLIN' ELSE 'JAVA' END, path) AS language,
 arg_max({_MARKED}, path) AS has_errors FROM targets GROUP BY target""")
def organized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.organize(corpus.corpus(spark, sf_dir), "java", "kotlin")


@query(f"""{_SRC}, {_FIRST} SELECT count(*) FILTER (NOT lib AND path NOT LIKE '%.kt') AS n_java, count(*) FILTER (NOT lib AND path LIKE '%.kt') AS n_kotlin, count(*) FILTER (NOT lib AND {_MARKED}) AS n_errors, count(*) FILTER (lib) AS n_skipped
 FROM (SELECT *, {_LIBRARY} AS lib FROM named)""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.counts(corpus.corpus(spark, sf_dir))


@query(rf"{_SRC} SELECT path FROM corpus WHERE NOT regexp_matches(path, '(^|/)(BuildConfig\.java|R\.java|R\$[^/]*.java)$')")
def without_generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.without_generated(corpus.corpus(spark, sf_dir)).select("path")


@query(f"{_SRC}, {_IMPORTS}, {_PACKAGES}, {_ALL_PACKAGES} SELECT DISTINCT array_to_string(string_split(package, '.')[1:CASE WHEN string_split(package, '.')[1] IN ('androidx', 'org', 'io') THEN 2 ELSE 3 END], '.') AS prefix FROM all_packages")
def package_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_packages(spark, sf_dir).select(extract.package_prefix(F.col("package")).alias("prefix")).distinct()


_REFS = rf"""found AS (SELECT path, unnest(regexp_extract_all(content, '{fixed.SDK_IMPORT}', 1)) AS full_name, 0 AS kind FROM corpus
 UNION ALL SELECT path, unnest(regexp_extract_all(content, '{fixed.SDK_WILDCARD}', 1)), 1 FROM corpus UNION ALL SELECT path, unnest(regexp_extract_all(content, '{fixed.QUALIFIED}')), 2 FROM corpus),
split AS (SELECT path, kind, CASE kind WHEN 1 THEN full_name ELSE regexp_extract(full_name, '^(.*)\.', 1) END AS package, CASE kind WHEN 1 THEN 'PackageInfo' ELSE regexp_extract(full_name, '[^.]*$') END AS class,
 CASE kind WHEN 2 THEN regexp_extract(full_name, '^(.*)\.', 1) ELSE full_name END AS tested FROM found WHERE kind <> 0 OR contains(full_name, '.')),
refs AS (SELECT DISTINCT path, package, class, kind = 0 AND regexp_matches(class, '{fixed.INTERFACE_NAME}') AS is_interface, kind FROM split WHERE {_below('tested', fixed.SDK_PACKAGES)}),
stubs AS (SELECT package, class, arg_min(is_interface, struct_pack(path := path, kind := kind)) AS is_interface FROM refs GROUP BY package, class)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs.classes(stubs.references(corpus.corpus(spark, sf_dir)))


@query(f"{_SRC}, {_REFS} SELECT path, package, class, is_interface, kind FROM refs")
def sdk_reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs.references(corpus.corpus(spark, sf_dir))


@query(f"{_SRC}, {_REFS} SELECT package, class, is_interface FROM stubs")
def stub_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)


@query(f"{_SRC}, {_REFS} SELECT count(DISTINCT package) AS n_packages, count(*) FILTER (NOT is_interface) AS n_classes, count(*) FILTER (is_interface) AS n_interfaces FROM stubs")
def stub_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs.totals(_classes(spark, sf_dir))


_STUB = (
    f"CASE WHEN is_interface THEN CASE {' '.join(f"WHEN class LIKE '%{end}' THEN '{stubs.template('interface', m)}'" for end, m in stubs.INTERFACE_MEMBERS)} END "
    f"ELSE '{stubs.template('class', stubs.CLASS_MEMBERS)}' END"
)


@query(f"{_SRC}, {_REFS} SELECT replace(package, '.', '/') || '/' || class || '.java' AS path, replace(replace({_STUB}, '{{package}}', package), '{{class}}', class) AS content FROM stubs")
def stub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs.stub_files(_classes(spark, sf_dir))


_IMPORTED = rf"""imported AS (SELECT path, full_name, regexp_extract(full_name, '[^.]*$') AS name, pos FROM (SELECT path, unnest(regexp_extract_all(content, '{fixed.USAGE_IMPORT}', 1)) AS full_name, generate_subscripts(regexp_extract_all(content, '{fixed.USAGE_IMPORT}', 1), 1) AS pos FROM corpus)),
names AS (SELECT path, name, arg_max(full_name, pos) AS full_name FROM imported GROUP BY path, name)"""


@query(f"{_SRC}, {_IMPORTED} SELECT path, name, full_name FROM names")
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.import_map(corpus.corpus(spark, sf_dir))


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_TYPE = rf"""CASE WHEN regexp_full_match(a, '\d+') THEN 'int' WHEN regexp_full_match(a, '\d+L') THEN 'long' WHEN regexp_full_match(a, '\d+\.\d+') THEN 'double' WHEN regexp_full_match(a, '\d+\.\d+f') THEN 'float' WHEN a IN ('true', 'false') THEN 'boolean'
 WHEN starts_with(a, '"') THEN 'String' WHEN starts_with(a, 'new ') THEN trim(string_split(a[5:], '(')[1]) ELSE 'Object' END"""
_USED = rf"""java AS (SELECT * FROM corpus WHERE path LIKE '%.java'),
made AS (SELECT path, unnest(regexp_extract_all(content, '{fixed.NEW_INSTANCE}', 1)) AS name, unnest(regexp_extract_all(content, '{fixed.NEW_INSTANCE}', 2)) AS arguments FROM java),
kept AS (SELECT path, {_STRIP.format('name')} AS name FROM (SELECT path, unnest(string_split(names, ',')) AS name FROM (SELECT path, unnest(regexp_extract_all(content, '{fixed.IMPLEMENTS}', 1)) AS names FROM java))),
uses AS (SELECT path, name, array_to_string(list_transform(list_filter(list_transform(string_split(arguments, ','), lambda a: {_STRIP.format('a')}), lambda a: a <> ''), lambda a: {_TYPE}), ',') AS types FROM made UNION ALL SELECT path, name, NULL FROM kept),
whole AS (SELECT CASE WHEN contains(u.name, '.') THEN u.name ELSE n.full_name END AS full_name, types FROM uses u LEFT JOIN names n USING (path, name)),
used AS (SELECT regexp_extract(full_name, '^(.*)\.', 1) AS package, regexp_extract(full_name, '[^.]*$') AS class, bool_or(types IS NULL) AS is_interface, coalesce(string_agg(DISTINCT types, '|' ORDER BY types), '') AS constructors
 FROM whole WHERE full_name IS NOT NULL AND {_below('full_name', fixed.SDK_PACKAGES)} GROUP BY ALL)"""


@query(f"{_SRC}, {_IMPORTED}, {_USED} SELECT package, class, is_interface, constructors FROM used")
def class_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array_join(F.array_sort(F.transform("constructors", lambda t: F.array_join(t, ","))), "|")
    return usage.usages(corpus.corpus(spark, sf_dir)).withColumn("constructors", lists)


_LEVELS = "levels AS (SELECT c_custkey AS k, CAST(18 + c_custkey % 20 AS INTEGER) AS sdk, concat('com.acme.app', c_custkey % 9, '.', c_mktsegment) AS package FROM customer)"


@query(f"""WITH {_LEVELS} SELECT k, greatest(sdk, 34) AS compile_sdk, greatest(sdk, 34) AS target_sdk, greatest(sdk, 21) AS min_sdk, CAST(CASE WHEN sdk >= 34 THEN 17 ELSE 11 END AS INTEGER) AS java_version,
 CASE sdk {' '.join(f"WHEN {i} THEN '{n}'" for i, n in fixed.SDK_NAMES.items())} ELSE 'API ' || sdk END AS sdk_name, regexp_extract(package, '[^.]*$') AS project, upper(regexp_extract(package, '[^.]*$')[1]) || regexp_extract(package, '[^.]*$')[2:] AS label FROM levels""")
def build_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (F.lit(18) + k % 20).cast("int").alias("sdk"), F.concat(F.lit("com.acme.app"), (k % 9).cast("string"), F.lit("."), "c_mktsegment").alias("package"))
    made = [v.alias(n) for n, v in manifest.build_defaults(F.col("sdk"), F.col("sdk")).items()]
    return rows.select("k", *made, manifest.sdk_name(F.col("sdk")).alias("sdk_name"), manifest.project_name(F.col("package")).alias("project"), manifest.label(F.col("package")).alias("label"))


_FLAGS = ", ".join([*(f"bool_or(contains(split_part(coordinate, ':', {i}), '{w}')) AS {w}" for i, w in ((1, "compose"), (2, "hilt"), (1, "firebase"), (2, "crashlytics"))), *(f"bool_or(split_part(coordinate, ':', 2) = '{a}') AS {a}" for a in ("retrofit", "gson", "okhttp", "glide"))])


@query(f"{_RESOLVED} SELECT {_FLAGS} FROM resolved")
def dependency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.dependency_flags(_resolved(spark, sf_dir))


@query(f"""{_SRC} SELECT bool_or(contains(content, 'Binding.inflate') OR contains(content, 'databinding.')) AS view_binding, bool_or(contains(content, 'DataBindingUtil') OR contains(content, '@BindingAdapter')) AS data_binding,
 bool_or(path LIKE '%.kt') AS kotlin FROM corpus""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.source_flags(corpus.corpus(spark, sf_dir))


@query(f"""{_RESOLVED}, flags AS (SELECT {_FLAGS}, (SELECT bool_or(path LIKE '%.kt') FROM corpus) AS kotlin FROM resolved),
one AS (SELECT string_agg('    implementation ''' || coordinate || ':' || version || '''' || CASE WHEN confidence < CAST(0.9 AS FLOAT) THEN ' // Confidence: ' || CAST(round(confidence * 100) AS INTEGER) || '%' ELSE '' END, chr(10) ORDER BY confidence DESC, first_stage, path, line_no, coordinate) AS found
 FROM resolved WHERE confidence >= CAST(0.85 AS FLOAT))
SELECT 'plugins ' || chr(123) || chr(10) || '    id ''com.android.application'' version ''8.2.0''' || chr(10) || {' || '.join(f"CASE WHEN {f} THEN '    id ''{p}'' version ''{v}''' || chr(10) ELSE '' END" for f, p, v in manifest.PLUGINS)} || chr(125) || chr(10) AS plugins,
 'dependencies ' || chr(123) || chr(10) || '    // Core Android libraries' || chr(10) || CASE WHEN kotlin THEN '    implementation ''{fixed.CORE_KOTLIN}''' ELSE '    implementation ''{fixed.CORE_JAVA}''' END || chr(10)
 || {' || '.join(f"'    implementation ''{c}''' || chr(10)" for c in fixed.CORE)} || chr(10) || '    // Detected third-party libraries' || chr(10) || found || chr(10) || chr(125) || chr(10) AS dependencies FROM flags, one""")
def build_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = materialised(_resolved(spark, sf_dir))
    found = resolved.filter(F.col("confidence") >= F.lit(0.85).cast("float"))
    order = F.struct((-F.col("confidence")).alias("c"), "first_stage", "path", "line_no", "coordinate", "version", "confidence")
    # One row each: flags of dependencies, flags of sources, the list of a build's dependencies.
    flags = manifest.dependency_flags(resolved).crossJoin(manifest.source_flags(corpus.corpus(spark, sf_dir)).select("kotlin")).select(F.struct("*").alias("flags"))
    rows = flags.crossJoin(found.agg(F.array_sort(F.collect_list(order)).alias("detected")))
    return rows.select(manifest.plugin_lines(F.col("flags")).alias("plugins"), manifest.dependency_lines(manifest.core_dependencies(F.col("flags.kotlin")), F.col("detected")).alias("dependencies"))


_PARTS = "parts AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat('g', p_partkey, ':a:1.', p_size) WHEN 1 THEN concat('g:a', p_size) WHEN 2 THEN 'alone' ELSE 'a:b:c:d' END AS text FROM part)"


@query(f"""WITH {_PARTS} SELECT k, split_part(text, ':', 1) AS group_id, split_part(text, ':', 2) AS artifact_id, CASE WHEN len(string_split(text, ':')) = 3 THEN split_part(text, ':', 3) ELSE 'latest.release' END AS version
 FROM parts WHERE len(string_split(text, ':')) IN (2, 3)""")
def parsed_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _PARTS[_PARTS.index("CASE") : _PARTS.rindex(" AS text")]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), resolve.parse_coordinate(F.expr(expr)).alias("c"))
    return rows.filter("c IS NOT NULL").select("k", "c.*")


_OUTPUT = "outputs AS (SELECT p_partkey AS k, concat('x ', CASE p_partkey % 6 WHEN 0 THEN 'SDK location not found' WHEN 1 THEN 'the minimum supported Gradle version is 8' WHEN 2 THEN 'Unsupported class file major version 65' WHEN 3 THEN 'Could not find a:b' WHEN 4 THEN 'Could not find x; SDK location not found' ELSE 'odd' END) AS output FROM part)"


@query(f"WITH {_OUTPUT} SELECT k, CASE {' '.join(f"WHEN contains(output, '{w}') THEN '{a}'" for w, a in fixed.SYNC_ADVICE)} ELSE '{'|'.join(fixed.SYNC_DEFAULTS)}' END AS advice FROM outputs")
def sync_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _OUTPUT[_OUTPUT.index("concat(") : _OUTPUT.rindex(" AS output")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(report.advice(F.expr(expr)), "|").alias("advice"))


@query(f"""WITH {_ENTRIES}, e AS (SELECT k % 10 AS archive, entry FROM entries) SELECT archive, count(*) FILTER (entry LIKE '%.dex') AS n_dex, count(*) FILTER (entry LIKE '%.dex') > 1 AS is_multidex,
 coalesce(string_agg(entry, ',' ORDER BY entry) FILTER (entry LIKE '%.so'), '') AS native FROM e GROUP BY archive""")
def archive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).select((F.col("k") % 10).alias("archive"), F.col("entry").alias("entry_name"))
    return manifest.archive_facts(rows).withColumn("native", F.array_join("native", ","))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path LIKE 'res/%' AND path NOT LIKE '%/'")
def zip_resource_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.zip_resources(_paths(spark, sf_dir).withColumnRenamed("path", "entry_name")).select(F.col("entry_name").alias("path"))


_TREE = "regexp_replace(path, '^res/', '')"
_TREE_KIND = f"CASE WHEN list_contains({_TYPES}, lower(string_split(string_split({_TREE}, '/')[1], '-')[1])) THEN upper(string_split(string_split({_TREE}, '/')[1], '-')[1]) ELSE 'UNKNOWN' END"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("k", F.regexp_replace("path", "^res/", "").alias("path"))


@query(f"WITH {_PATHS} SELECT k, {_TREE} AS path, {_TREE_KIND} AS type, array_to_string(string_split(string_split({_TREE}, '/')[1], '-')[2:], ',') AS qualifiers FROM paths")
def resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.resource_rows(_tree(spark, sf_dir)).withColumn("qualifiers", F.array_join("qualifiers", ","))


@query(f"WITH {_PATHS}, t AS (SELECT {_TREE_KIND} AS type FROM paths) SELECT CASE WHEN type = 'LAYOUT' THEN 'layouts' WHEN type IN ('DRAWABLE', 'MIPMAP') THEN 'drawables' WHEN type = 'VALUES' THEN 'values' ELSE 'others' END AS class, count(*) AS n FROM t GROUP BY 1")
def resource_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.resource_rows(_tree(spark, sf_dir)).groupBy(resources.resource_class(F.col("type")).alias("class")).agg(F.count("*").alias("n"))


_ICONS = "icons AS (SELECT concat('mipmap-', p_partkey % 50, '/', CASE p_partkey % 3 WHEN 0 THEN 'ic_launcher.png' WHEN 1 THEN CASE WHEN p_partkey % 50 < 40 THEN 'ic_launcher_round.xml' ELSE 'more.xml' END ELSE 'other.png' END) AS path FROM part WHERE p_partkey % 7 < 3)"


@query(rf"""WITH {_ICONS}, s AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS base FROM icons)
SELECT folder FROM s GROUP BY folder HAVING bool_or(base = 'ic_launcher') AND NOT bool_or(base = 'ic_launcher_round')""")
def missing_round_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _ICONS[_ICONS.index("concat(") : _ICONS.rindex(" AS path")]
    return organize.missing_twins(table(spark, sf_dir, "part").filter("p_partkey % 7 < 3").select(F.expr(expr).alias("path")))


# Texts whose bytes are the file's; chr(65279) is a byte order mark.
_XML = """xml AS (SELECT concat(CASE WHEN p_partkey = 2 THEN 'values/public' ELSE concat('layout/My-File', CAST(floor(p_partkey / 2) AS INT)) END, CASE WHEN p_partkey % 10 = 9 THEN '.png' WHEN p_partkey % 2 = 0 THEN '.xml' ELSE '.XML.xml' END) AS path,
 CASE p_partkey % 8 WHEN 0 THEN concat(chr(65279), '<?xml version="1.0"?><a/>') WHEN 1 THEN 'junk <?xml version="1.0"?><b/>' WHEN 2 THEN 'note <c/>' WHEN 3 THEN 'no markup' WHEN 4 THEN '  <d/>'
 WHEN 5 THEN '<?xml version="1.0"?> <?xml version="1.1"?><e/>' WHEN 6 THEN concat(chr(7), chr(8), '<f/>') ELSE '' END AS text FROM part)"""


@query(rf"""WITH {_XML}, n AS (SELECT *, regexp_extract(path, '^(.*/)', 1) || CASE WHEN b = '' THEN 'res_' ELSE b END || regexp_extract(path, '\.[^./]+$') AS target FROM (SELECT *,
 regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')), '[^a-z0-9_]', '_', 'g'), '^[_0-9]+', ''), '_+', '_', 'g') AS b FROM xml WHERE path <> 'values/public.xml')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CAST(path <> target AS INT), path, text) AS rn FROM n) WHERE rn = 1),
c AS (SELECT target, regexp_replace(text, '^' || chr(65279), '') AS t FROM f),
d AS (SELECT target, CASE WHEN instr(t, '<?xml') > 1 THEN substr(t, instr(t, '<?xml')) WHEN instr(t, '<?xml') = 0 AND instr(t, '<') > 1 THEN substr(t, instr(t, '<')) ELSE t END AS t FROM c)
SELECT target AS path, CASE WHEN target LIKE '%.xml' AND regexp_matches(t, '^\s*<') AND contains(t, '>') THEN regexp_replace(regexp_replace(t, '^[\x00-\x08\x0B\x0C\x0E-\x1F]+', ''), '<\?xml[^?]*\?>\s*<\?xml', '<?xml') END AS content,
 target NOT LIKE '%.xml' OR (regexp_matches(t, '^\s*<') AND contains(t, '>')) AS kept FROM d""")
def cleaned_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, text = _XML[_XML.index("concat(CASE") : _XML.index(" AS path")], _XML[_XML.index("CASE p_partkey % 8") : _XML.rindex(" AS text")]
    text = text.replace("chr(65279)", "decode(unhex('EFBBBF'), 'UTF-8')")
    return resources.cleaned_xml(table(spark, sf_dir, "part").select(F.expr(path).alias("path"), F.expr(text).cast("binary").alias("content")))


_FACTS = "facts AS (SELECT c_custkey AS k, concat('com.acme.app', c_custkey % 9) AS package, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS code, c_custkey % 4 = 0 AS bare, c_custkey % 2 = 0 AS exported FROM customer)"


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, xml) from the customers: some without versions or components, some with repeated and invalid names."""
    xml = """concat('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.acme.app', c_custkey % 9, '"', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(' android:versionCode="', CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE string(c_custkey) END, '" android:versionName="2.', c_custkey % 5, '"') END, '>',
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('<uses-sdk android:minSdkVersion="', 19 + c_custkey % 9, '" android:targetSdkVersion="33"/><uses-permission android:name="p.A"/><uses-permission android:name="p.B"/><uses-permission android:name="p.A"/>',
 '<application android:name="App"><activity android:name=".Main" android:exported="', c_custkey % 2 = 0, '"><intent-filter><action android:name="MAIN"/><category android:name="LAUNCHER"/><data android:scheme="app"/></intent-filter></activity>',
 '<activity android:name=".Main"/><activity android:name="http://a.b"/><service android:name="plain"/><receiver android:name="com.acme.R', c_custkey % 5, '" android:exported="true"/></application>') END, '</manifest>')"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr(xml).alias("xml"))


@query(f"""WITH {_FACTS} SELECT k, package, CASE WHEN bare THEN 1 ELSE coalesce(TRY_CAST(code AS INTEGER), 1) END AS version_code, CASE WHEN bare THEN '1.0' ELSE concat('2.', k % 5) END AS version_name,
 CAST(CASE WHEN bare THEN 21 ELSE 19 + k % 9 END AS INTEGER) AS min_sdk, CAST(CASE WHEN bare THEN 34 ELSE 33 END AS INTEGER) AS target_sdk, CASE WHEN bare THEN NULL ELSE 'App' END AS application, CASE WHEN bare THEN '' ELSE 'p.A,p.B,p.A' END AS permissions,
 CAST(CASE WHEN bare THEN 0 ELSE 3 END AS INTEGER) AS n_activities, CASE WHEN bare THEN NULL ELSE exported END AS exported, CASE WHEN bare THEN NULL ELSE 'MAIN' END AS action, CASE WHEN bare THEN NULL ELSE 'app' END AS scheme FROM facts""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("activities", F.lit(0))
    chosen = F.get(first["filters"], F.lit(0))
    return manifest.parse(_manifests(spark, sf_dir)).select(
        "k", "package", "version_code", "version_name", "min_sdk", "target_sdk", "application", F.array_join("permissions", ",").alias("permissions"), F.size("activities").alias("n_activities"),
        first["exported"].alias("exported"), F.get(chosen["actions"], F.lit(0)).alias("action"), F.get(chosen["data"], F.lit(0))["scheme"].alias("scheme"),
    )


@query(f"""WITH {_FACTS} SELECT k, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<manifest xmlns:android="http://schemas.android.com/apk/res/android">' || chr(10) || chr(10)
 || CASE WHEN bare THEN '' ELSE '    <uses-permission android:name="p.A" />' || chr(10) || '    <uses-permission android:name="p.B" />' || chr(10) || chr(10) END
 || '    <application' || chr(10) || {' || '.join(f"""'        android:{a}="{v}"' || chr(10)""" for a, v in manifest.APPLICATION)} || '        android:theme="@style/Theme.AppCompat.Light.DarkActionBar">' || chr(10)
 || CASE WHEN bare THEN '' ELSE concat_ws(chr(10), '', '        <activity', '            android:name=".Main"', '            android:exported="' || CAST(exported AS VARCHAR) || '">', '            <intent-filter>', '                <action android:name="MAIN" />',
  '                <category android:name="LAUNCHER" />', '            </intent-filter>', '        </activity>', '', '        <receiver', '            android:name="com.acme.R' || (k % 5) || '"', '            android:exported="true" />') || chr(10) END
 || '    </application>' || chr(10) || '</manifest>' || chr(10) AS text FROM facts""")
def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.parse(_manifests(spark, sf_dir))
    return rows.select("k", manifest.manifest_text(F.struct("permissions", "activities", "services", "receivers")).alias("text"))


@query(f"{_RESOLVED} SELECT coordinate, version, confidence FROM resolved ORDER BY confidence DESC, coordinate LIMIT {fixed.SHOWN['unresolved']}")
def shown_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.shown(_resolved(spark, sf_dir).select("coordinate", "version", "confidence"), "unresolved", F.desc("confidence"), "coordinate")


@query(f"{_SRC} SELECT path, substr(content, 1, {fixed.SHOWN_OUTPUT}) AS shown FROM corpus")
def shown_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, sf_dir).select("path", report.shown_output(F.col("content")).alias("shown"))


_README = f"""WITH f AS (SELECT c_custkey AS k, CAST(18 + c_custkey % 20 AS INTEGER) AS sdk, c_custkey % 3 = 0 AS obfuscated, c_custkey % 4 AS n, c_custkey % 5 AS libs FROM customer),
g AS (SELECT *, CASE sdk {' '.join(f"WHEN {i} THEN '{n}'" for i, n in fixed.SDK_NAMES.items())} ELSE 'API ' || sdk END AS level FROM f)
SELECT k, '# app' || k || repeat(chr(10), 2) || concat_ws(chr(10), '## Project Information', '', '| Property | Value |', '|----------|-------|', '| Package Name | `com.acme.app' || k || '` |', '| Version Name | 2.' || n || ' |', '| Version Code | ' || k || ' |',
 '| Min SDK | ' || sdk || ' (Android ' || level || ') |', '| Target SDK | ' || sdk || ' (Android ' || level || ') |', '', '## Generation Details', '', '- **Generated on**: 2024-01-01', '- **Source APK**: a.apk', '- **APK Size**: ' || k || '.5 MB', '- **Total Classes**: ' || k,
 '- **Decompilation Success Rate**: 95%', '', '## Detected Dependencies', '', n || ' dependencies were automatically detected:', '', '### Core Libraries', '- `{fixed.CORE_JAVA}`', {', '.join(f"'- `{c}`'" for c in fixed.CORE)}, '', '### Third-party Libraries')
 || CASE WHEN n > 0 THEN chr(10) || array_to_string(list_transform(range(0, n), lambda i: '- `g:a' || i || ':1.' || i || '` (' || (85 + 5 * i) || '% confidence)'), chr(10)) ELSE '' END || repeat(chr(10), 2) || '## Known Issues'
 || CASE WHEN obfuscated THEN repeat(chr(10), 2) || '### Obfuscation Detected' || repeat(chr(10), 2) || 'Class and method names of the source may be unclear.' ELSE '' END
 || CASE WHEN libs > 0 THEN repeat(chr(10), 2) || '- **x86**: ' || libs || ' libraries' ELSE '' END
 || repeat(chr(10), 2) || '### Potential Compilation Errors' || repeat(chr(10), 2) || 'Code may fail to compile where dependencies weren''t detected or decompilation is incomplete.' || chr(10) AS text FROM g"""


@query(_README)
def readme_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    facts = {
        "project": F.concat(F.lit("app"), k.cast("string")), "package": F.concat(F.lit("com.acme.app"), k.cast("string")), "version_name": F.concat(F.lit("2."), (k % 4).cast("string")), "version_code": k,
        "min_sdk": (k % 20 + 18).cast("int"), "target_sdk": (k % 20 + 18).cast("int"), "generated": F.lit("2024-01-01"), "source": F.lit("a.apk"), "size_mb": k + 0.5, "n_classes": k, "success": F.lit(95), "obfuscated": k % 3 == 0,
    }
    detected = F.expr("transform(filter(sequence(0, 3), i -> i < c_custkey % 4), i -> struct(concat('g:a', i) AS coordinate, concat('1.', i) AS version, CAST(0.85 + 0.05 * i AS float) AS confidence))")
    native = F.expr("filter(array(struct('x86' AS abi, c_custkey % 5 AS n)), x -> x.n > 0)")
    row = F.struct(*[v.alias(n) for n, v in facts.items()])
    return table(spark, sf_dir, "customer").select(k.alias("k"), manifest.readme_text(row, manifest.core_dependencies(F.lit(False)), detected, native).alias("text"))
