"""Histograms, log scans, checks and conditional upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed


def put_if_absent(rows: DataFrame, word: str, coordinate: str, version: str, androidx: DataFrame | None = None) -> DataFrame:
    """rows (coordinate, version) and one more if some coordinate holds `word` and none is `coordinate`.

    androidx: packages; if given, nothing is added unless one of them is below androidx.
    """
    seen = rows.agg(F.bool_or(F.col("coordinate").contains(word)).alias("wanted"), F.bool_or(F.col("coordinate") == coordinate).alias("there"))
    added = seen.filter("wanted AND NOT there").select(F.lit(coordinate).alias("coordinate"), F.lit(version).alias("version"))
    if androidx is not None:
        added = added.join(androidx.filter(F.col("package").startswith("androidx.")).agg(F.lit("androidx").alias("_seen"), F.count("*").alias("_n")).filter("_n > 0"), F.col("_seen") == F.lit("androidx"), "left_semi")
    return rows.unionByName(added)


def depth_histogram(rows: DataFrame) -> DataFrame:
    """(depth, n, flattened): flattened if depths 1 and 2 hold over three times as many as the others."""
    counts = rows.groupBy("depth").agg(F.count("*").alias("n"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    flat = counts.agg((part(F.col("depth") <= 2) > 3 * part(F.col("depth") > 2)).alias("flattened"))
    return counts.join(F.broadcast(flat))


def error_marker(content: Column) -> Column:
    """Whether a decompiler has left one of its markers; unreadable contents (null) count."""
    return F.coalesce(reduce(lambda a, b: a | b, [content.contains(m) for m in fixed.ERROR_MARKERS]), F.lit(True))


def compile_errors(log: DataFrame) -> DataFrame:
    """The distinct `File.java:line - message` of a compiler's log, files without their folders."""
    pattern = r"(.+\.java):(\d+): error: (.+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return log.filter(F.col("line").rlike(pattern)).select(F.concat(F.substring_index(part(1), "/", -1), F.lit(":"), part(2), F.lit(" - "), part(3)).alias("error")).distinct()


def log_kind(line: Column) -> Column:
    """What a line of a decompiler's log tells; the first that applies."""
    return (
        F.when(line.contains("processing"), "progress").when(line.contains("INFO") & line.contains("classes"), "classes")
        .when(line.contains("ERROR"), "error").when(line.contains("WARN") & line.contains("Can't process"), "skipped")
    )


def log_class(line: Column) -> Column:
    """The class that a log line names, else Unknown."""
    return F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in fixed.LOG_CLASS], F.lit("Unknown"))


def log_errors(log: DataFrame) -> DataFrame:
    """(line_no, class, message) of a log's errors."""
    return log.filter(log_kind(F.col("line")) == "error").select("line_no", log_class(F.col("line")).alias("class"), F.col("line").alias("message"))


def reported_classes(line: Column) -> Column:
    """The number of classes that a log line reports, else null."""
    return F.when(log_kind(line) == "classes", F.regexp_extract(line, r"(\d+)\s+classes", 1).try_cast("int"))


def log_counters(log: DataFrame) -> DataFrame:
    """Counters of a decompiler's log: errors, failed (errors and skipped methods), and classes, the last number reported."""
    line = F.col("line")
    kind, classes = log_kind(line), reported_classes(line)
    return log.agg(
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind.isin("error", "skipped")).alias("failed"),
        F.max_by(classes, F.when(classes.isNotNull(), F.col("line_no"))).alias("classes"),
    )


def outcome(counters: DataFrame, successful: int) -> DataFrame:
    """counters with the outcome of a run that decompiled so many classes, and the methods that these hold by estimate.

    Where no number of classes was reported, there were the successful and the failed ones.
    """
    state = F.when(F.lit(successful) == 0, "failure").when(F.col("errors") == 0, "success").otherwise("partial")
    told = F.when(F.coalesce("classes", F.lit(0)) == 0, F.lit(successful) + F.col("failed")).otherwise(F.col("classes"))
    return counters.withColumns({"outcome": state, "total_classes": F.greatest(told, F.lit(successful)), "total_methods": F.lit(successful * 10)})


def advice(output: Column) -> Column:
    """What to do about a failed sync: by the first known cause, else the defaults."""
    found = None
    for words, text in fixed.SYNC_ADVICE:
        found = (F if found is None else found).when(output.contains(words), F.array(F.lit(text)))
    return found.otherwise(F.array(*map(F.lit, fixed.SYNC_DEFAULTS)))


def _text_lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def _first_lines(text: Column, pattern: str, n: int) -> Column:
    return F.array_join(F.slice(F.filter(_text_lines(text), lambda x: x.rlike(pattern)), 1, n), "\n")


def output_errors(output: Column) -> Column:
    """The distinct errors of a compiler's output, as compile_errors() has them, in their order."""
    pattern = r"(.+\.java):(\d+): error: (.+)"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    met = F.filter(_text_lines(output), lambda x: x.rlike(pattern))
    return F.array_distinct(F.transform(met, lambda x: F.concat(F.substring_index(part(x, 1), "/", -1), F.lit(":"), part(x, 2), F.lit(" - "), part(x, 3))))


def project_checks(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, ord, step, passed, message, details, suggestions): the five checks of every project.

    files: (project, path). runs: (project, step, ok, stdout, stderr), what the tools said of the steps `sync`,
    `dependencies` and `compile`; a step without a run has failed and said nothing. One shuffle by project does all.
    """
    there = lambda p: F.coalesce(F.bool_or((F.col("path") == p) | F.col("path").startswith(f"{p}/")), F.lit(False))
    said = lambda step: F.max(F.when(F.col("step") == step, F.struct("ok", "stdout", "stderr"))).alias(step)
    rows = files.select("project", "path").unionByName(runs.select("project", "step", "ok", "stdout", "stderr"), allowMissingColumns=True)
    flags = rows.groupBy("project").agg(*[there(p).alias(f"f{i}") for i, p in enumerate((*fixed.PROJECT_FILES, *fixed.WRAPPER_FILES))], *map(said, ("sync", "dependencies", "compile")))
    n = len(fixed.PROJECT_FILES)
    missing = F.concat_ws(", ", *[F.when(~F.col(f"f{i}"), p) for i, p in enumerate(fixed.PROJECT_FILES)])
    out = lambda step, name: F.coalesce(F.col(f"{step}.{name}"), F.lit(""))
    ok = lambda step: F.coalesce(F.col(f"{step}.ok"), F.lit(False))
    words = lambda *texts: F.array(*map(F.lit, texts)).cast("array<string>")
    sync_error = _first_lines(out("sync", "stderr"), "(?i)error|failed", fixed.SHOWN["sync_errors"])
    unresolved = out("dependencies", "stdout").rlike(fixed.UNRESOLVED)
    errors = output_errors(F.concat(out("compile", "stderr"), out("compile", "stdout")))

    def check(k: int, passed: Column, message: Column, details: Column | None, suggestions: Column) -> Column:
        name, good = fixed.CHECKS[k]
        return F.struct(
            F.lit(k).alias("ord"), F.lit(name).alias("step"), passed.alias("passed"), F.when(passed, good).otherwise(message).alias("message"),
            (F.lit(None).cast("string") if details is None else F.when(~passed, details)).alias("details"), F.when(passed, words()).otherwise(suggestions).alias("suggestions"),
        )

    checks = F.array(
        check(0, missing == "", F.concat(F.lit("Missing files: "), missing), None, words(*fixed.STRUCTURE_ADVICE)),
        check(1, F.col(f"f{n}") & F.col(f"f{n + 1}"), F.lit("Gradle wrapper not found"), None, words(*fixed.WRAPPER_ADVICE)),
        check(2, ok("sync"), F.lit("Gradle sync failed"), F.when(sync_error != "", sync_error).otherwise(shown_output(out("sync", "stderr"))), advice(out("sync", "stderr"))),
        check(
            3, ok("dependencies") & ~unresolved, F.when(ok("dependencies"), "Some dependencies could not be resolved").otherwise("Failed to check dependencies"),
            F.when(ok("dependencies"), _first_lines(out("dependencies", "stdout"), "FAILED|Could not", fixed.SHOWN["unresolved"])).otherwise(shown_output(out("dependencies", "stderr"))),
            F.when(ok("dependencies"), words(*fixed.UNRESOLVED_ADVICE)).otherwise(words()),
        ),
        check(4, ok("compile"), F.concat(F.lit("Compilation errors found: "), F.size(errors).cast("string"), F.lit(" errors")), F.array_join(F.slice(errors, 1, fixed.SHOWN["compile_errors"]), "\n"), words(*fixed.COMPILE_ADVICE)),
    )
    return flags.select("project", F.explode(checks).alias("c")).select("project", "c.*")


def check_summary(checks: DataFrame) -> DataFrame:
    """(project, total, passed, buildable): buildable with one failed check at most."""
    counted = checks.groupBy("project").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return counted.withColumn("buildable", F.col("passed") >= F.col("total") - 1)


def shown(rows: DataFrame, kind: str, *order: str | Column, every: bool = False) -> DataFrame:
    """The rows of a report that are shown: the first ones by `order`, as many as its kind has; all of them on demand."""
    ordered = rows.orderBy(*order)
    return ordered if every else ordered.limit(fixed.SHOWN[kind])


def shown_output(output: Column) -> Column:
    """The start of a failed run's output that is shown."""
    return F.substring(output, 1, fixed.SHOWN_OUTPUT)
