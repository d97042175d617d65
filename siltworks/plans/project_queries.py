"""Queries over whole projects: their checks, and logs that arrive in pieces. Projects and outputs are derived from the part table."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators import facts, organize, report, resolve, snapshots
from siltworks.plans import corpus
from siltworks.plans.catalog import _IMPORTS, _KINDS, _LOG, _RESOLVED, _SRC, _log, _resolved, _values, query
from siltworks.session import shared_folder, table
from siltworks.sources import files
from siltworks.streaming import logs

_NL = "chr(10)"
_FILES = (*fixed.PROJECT_FILES[:2], f"{fixed.PROJECT_FILES[2]}/p/F.java", *fixed.PROJECT_FILES[3:], *fixed.WRAPPER_FILES, "README.md")
_PATH = "CASE WHEN p_size % 9 <> 1 THEN CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_FILES)) + " END END"
_STEP = "CASE p_partkey % 8 WHEN 1 THEN 'sync' WHEN 2 THEN 'dependencies' WHEN 3 THEN 'compile' END"


def _output(k: str) -> str:
    cases = (
        f"concat('x error one', {_NL}, 'FAILED two', {_NL}, 'fine', {_NL}, 'Error three', {_NL}, 'it failed again')", f"concat('Could not find a:b', {_NL}, 'ok', {_NL}, 'Could not resolve c')", "'SDK location not found'",
        "repeat('a long output ', 60)", f"concat('src/A.java:3: error: bad', {_NL}, 'src/A.java:3: error: bad', {_NL}, 'B.java:7: error: worse', {_NL})",
    )
    return f"CASE ({k}) % 6 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " ELSE '' END"


_PROJECTS = f"""tree AS (SELECT p_partkey // 8 AS project, {_PATH} AS path FROM part),
runs AS (SELECT p_partkey // 8 AS project, {_STEP} AS step, p_size % 3 <> 0 AS ok, {_output('p_size')} AS stdout, {_output('p_size + p_partkey')} AS stderr FROM part WHERE p_partkey % 8 IN (1, 2, 3)),
projects AS (SELECT DISTINCT project FROM tree),
said AS (SELECT p.project, {', '.join(f"coalesce(bool_or(r.ok) FILTER (step = '{s}'), false) AS {s}_ok, coalesce(max(r.stdout) FILTER (step = '{s}'), '') AS {s}_out, coalesce(max(r.stderr) FILTER (step = '{s}'), '') AS {s}_err" for s in ("sync", "dependencies", "compile"))}
 FROM projects p LEFT JOIN runs r USING (project) GROUP BY p.project),
need(n, name) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(fixed.PROJECT_FILES))}),
lacking AS (SELECT p.project, string_agg(n.name, ', ' ORDER BY n.n) AS names FROM projects p, need n
 WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.project = p.project AND (t.path = n.name OR starts_with(t.path, n.name || '/'))) GROUP BY p.project),
wrapped AS (SELECT project, coalesce(bool_or(path = '{fixed.WRAPPER_FILES[0]}'), false) AND coalesce(bool_or(path = '{fixed.WRAPPER_FILES[1]}'), false) AS ok FROM tree GROUP BY project)"""
_ADVICE = "CASE " + " ".join(f"WHEN contains(sync_err, '{w}') THEN '{a}'" for w, a in fixed.SYNC_ADVICE) + f" ELSE '{'|'.join(fixed.SYNC_DEFAULTS)}' END"
_met = lambda text, pattern, n: f"array_to_string(list_filter(string_split({text}, {_NL}), lambda x: regexp_matches(x, '{pattern}'))[1:{n}], {_NL})"
_JAVA = r"(.+\.java):(\d+): error: (.+)"
_ERRORS = rf"list_transform(list_filter(string_split(compile_err || compile_out, {_NL}), lambda x: regexp_matches(x, '{_JAVA}')), lambda x: regexp_extract(regexp_extract(x, '{_JAVA}', 1), '[^/]*$') || ':' || regexp_extract(x, '{_JAVA}', 2) || ' - ' || regexp_extract(x, '{_JAVA}', 3))"
_quoted = lambda texts: "'" + "|".join(texts).replace("'", "''") + "'"
_CHECKS = f"""{_PROJECTS}, errors AS (SELECT project, {_ERRORS} AS every FROM said),
checks AS (
 SELECT project, 0 AS ord, names IS NULL AS passed, 'Missing files: ' || names AS bad, NULL AS why, {_quoted(fixed.STRUCTURE_ADVICE)} AS todo FROM projects LEFT JOIN lacking USING (project)
 UNION ALL SELECT project, 1, ok, 'Gradle wrapper not found', NULL, {_quoted(fixed.WRAPPER_ADVICE)} FROM wrapped
 UNION ALL SELECT project, 2, sync_ok, 'Gradle sync failed', coalesce(nullif({_met("sync_err", "(?i)error|failed", fixed.SHOWN["sync_errors"])}, ''), sync_err[1:{fixed.SHOWN_OUTPUT}]), {_ADVICE} FROM said
 UNION ALL SELECT project, 3, dependencies_ok AND NOT regexp_matches(dependencies_out, '{fixed.UNRESOLVED}'), CASE WHEN dependencies_ok THEN 'Some dependencies could not be resolved' ELSE 'Failed to check dependencies' END,
  CASE WHEN dependencies_ok THEN {_met("dependencies_out", "FAILED|Could not", fixed.SHOWN["unresolved"])} ELSE dependencies_err[1:{fixed.SHOWN_OUTPUT}] END, CASE WHEN dependencies_ok THEN {_quoted(fixed.UNRESOLVED_ADVICE)} ELSE '' END FROM said
 UNION ALL SELECT project, 4, compile_ok, 'Compilation errors found: ' || len(list_distinct(every)) || ' errors', array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i)[1:{fixed.SHOWN["compile_errors"]}], {_NL}), {_quoted(fixed.COMPILE_ADVICE)} FROM said JOIN errors USING (project)),
named(ord, step, good) AS (VALUES {', '.join(f"({i}, '{n}', '{m}')" for i, (n, m) in enumerate(fixed.CHECKS))})"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("project", F.floor(F.col("p_partkey") / 8))
    files = part.select("project", F.expr(_PATH).alias("path"))
    runs = part.filter("p_partkey % 8 IN (1, 2, 3)").select("project", F.expr(_STEP).alias("step"), F.expr("p_size % 3 <> 0").alias("ok"), F.expr(_output("p_size")).alias("stdout"), F.expr(_output("p_size + p_partkey")).alias("stderr"))
    return report.project_checks(files, runs)


@query(f"""WITH {_CHECKS} SELECT project, ord, step, passed, CASE WHEN passed THEN good ELSE bad END AS message, CASE WHEN NOT passed THEN why END AS details, CASE WHEN passed THEN '' ELSE todo END AS suggestions
 FROM checks JOIN named USING (ord)""")
def project_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).withColumn("suggestions", F.array_join("suggestions", "|"))


@query(f"WITH {_CHECKS} SELECT project, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) >= count(*) - 1 AS buildable FROM checks GROUP BY project")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.check_summary(_checks(spark, sf_dir))


#: Logs that the derived log is dealt to, least and most lines of a piece, pieces that a log has between these, and pieces a batch.
LOGS, PIECE, LONGEST, PIECES, BATCH = 5, 100, 50_000, 40, 8


def piece_lines(lines: int) -> int:
    """Lines of a piece: a batch costs seconds whatever is in it, so longer logs come in longer pieces, not in more of them."""
    return min(LONGEST, max(PIECE, math.ceil(lines / (LOGS * PIECES))))


@query(rf"""WITH {_LOG}, {_KINDS} SELECT concat('log', line_no % {LOGS}) AS log, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind IN ('error', 'skipped')) AS failed,
 coalesce(arg_max(TRY_CAST(regexp_extract(line, '(\d+)\s+classes', 1) AS INTEGER), line_no) FILTER (kind = 'classes' AND regexp_matches(line, '\d+\s+classes')), 0) AS classes FROM kinds GROUP BY 1 HAVING count(kind) > 0""")
def streamed_log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counters of each of five logs that a stream reads piece by piece, BATCH pieces at a time."""
    home = os.path.join(shared_folder(spark), f"logs-{os.urandom(8).hex()}")
    log = _log(spark, sf_dir)
    size = LOGS * piece_lines(log.count())
    dealt = log.select(F.concat(F.lit("log"), F.col("line_no") % LOGS).alias("log"), F.floor(F.col("line_no") / size).alias("piece"), "line_no", "line")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n")
    organize.write_files(dealt.groupBy("log", "piece").agg(body.alias("content")).select(F.concat_ws(".", "log", "piece").alias("path"), "content"), f"{home}/in")
    told = logs.counters(logs.pieces(spark, f"{home}/in", BATCH))
    keep = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{home}/told")
    stream = told.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(keep).trigger(availableNow=True)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), LOGS)))  # each has a store and a worker in each batch, and a log is in one of them
    try:
        running = stream.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    running.awaitTermination()
    last = Window.partitionBy("log").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{home}/told").withColumn("n", F.row_number().over(last)).filter("n = 1").select("log", "errors", "failed", F.coalesce("classes", F.lit(0)).alias("classes"))


_TIER = "CASE WHEN confidence >= CAST(0.8 AS FLOAT) THEN 'high' WHEN confidence >= CAST(0.6 AS FLOAT) THEN 'medium' ELSE 'low' END"


@query(f"""{_RESOLVED} SELECT {_TIER} AS tier, CAST(row_number() OVER (PARTITION BY {_TIER} ORDER BY confidence DESC, first_stage, path, line_no, coordinate) AS INTEGER) AS position,
 coordinate || ':' || version || CASE WHEN {_TIER} = 'high' THEN '' ELSE ' (' || CAST(trunc(confidence * CAST(100 AS FLOAT)) AS INTEGER) || '%)' END AS text FROM resolved""")
def dependency_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers of the report, the low one included."""
    return resolve.listing(_resolved(spark, sf_dir), every=True)


_SIGNED = f"library(ord, group_id, artifact_id, signature) AS (VALUES {_values([(i, g, a, s) for i, (p, g, a, _) in enumerate(fixed.LIBRARIES) for s in (p, p + '.app')])})"


@query(f"""{_SRC}, {_IMPORTS}, {_SIGNED}, met AS (SELECT i.import AS class, l.*, row_number() OVER (PARTITION BY i.import ORDER BY l.ord) AS n FROM (SELECT DISTINCT import FROM imports) i JOIN library l ON starts_with(i.import, l.signature))
SELECT class, group_id, artifact_id FROM met WHERE n = 1""")
def signature_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported classes by the first library with a signature that starts them."""
    classes = facts.facts(corpus.corpus(spark, sf_dir), ("import",)).select(F.col("name").alias("class"))
    library = resolve._values(spark, [(i, g, a, p) for i, (p, g, a, _) in enumerate(fixed.LIBRARIES)], "ord, group_id, artifact_id, prefix")
    return resolve.by_signature(classes, library.select("ord", "group_id", "artifact_id", F.array("prefix", F.concat("prefix", F.lit(".app"))).alias("classSignatures")))


_SEARCH = [(g, a, k, f"{k}.{len(a)}") for _, g, a, _ in fixed.LIBRARIES for k in (1, 0) if len(a) % 3]


@query(f"""{_RESOLVED}, search(group_id, artifact_id, ord, version) AS (VALUES {_values(_SEARCH)})
SELECT coordinate, coalesce((SELECT arg_min(s.version, s.ord) FROM search s WHERE s.group_id || ':' || s.artifact_id = coordinate), '') AS latest FROM resolved""")
def latest_version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a search has first for each dependency; empty where it has none."""
    search = resolve._values(spark, _SEARCH, "group_id, artifact_id, ord, version")
    return resolve.latest_versions(_resolved(spark, sf_dir).select("coordinate"), search).select("coordinate", F.coalesce("latest", F.lit("")).alias("latest"))


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, n_name AS name, 'org.' || lower(replace(n_name, ' ', '')) AS groupId, CAST(n_regionkey % 3 AS INTEGER) AS n_signatures FROM nation""")
def library_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON dimension written to the shared folder and read as a library document; rows keep the document's order."""
    home = os.path.join(shared_folder(spark), f"libraries-{os.urandom(8).hex()}")
    signatures = F.transform(F.slice(F.array(F.lit("a.B"), F.lit("c.D")), 1, (F.col("n_regionkey") % 3).cast("int")), lambda x: F.concat("n_name", x))
    row = F.struct("n_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("org."), F.lower(F.replace("n_name", F.lit(" "), F.lit("")))).alias("groupId"), F.lit("a").alias("artifactId"), F.col("n_name").alias("packagePrefix"), signatures.alias("classSignatures"), F.lit("1").alias("latestVersion"))
    document = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("libraries"))).alias("content"))  # 25 rows at every size
    organize.write_files(document.select(F.lit("libraries.json").alias("path"), "content"), home)
    return files.library_dimension(spark, f"{home}/libraries.json").select("ord", "name", "groupId", F.size("classSignatures").alias("n_signatures"))


@query(f"SELECT {corpus.PATH} AS path, p_partkey % 10 = 3 AS rewritten FROM part WHERE p_partkey % 10 <> 4")
def snapshot_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a second run rewrites, where since the first one a tenth has changed and a tenth has gone."""
    home = os.path.join(shared_folder(spark), f"snapshot-{os.urandom(8).hex()}")
    rows = corpus.dealt_parts(spark, sf_dir).select("p_partkey", F.expr(corpus.PATH).alias("path"), F.expr(corpus.CONTENT).alias("content"))
    before = F.when(F.col("p_partkey") % 10 == 3, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    snapshots.refresh(rows.select("path", before.alias("content")), home)
    snapshots.refresh(rows.filter("p_partkey % 10 <> 4").select("path", "content"), home)
    run = snapshots.current(spark, home)
    return snapshots.index(spark, home, run).select("path", (F.col("run") == run).alias("rewritten"))
