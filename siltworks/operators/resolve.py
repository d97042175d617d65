"""Dependency resolution: a prefix index joined by equality, last-writer upserts, lookups and tiers.

`startsWith` against a set of prefixes is an equi-join: a name is cut at each length that the prefixes have, and the
cuts are joined with the prefixes. All stages of a resolution are one such join, over the distinct names of the tree.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators.extract import category
from siltworks.session import materialised


class Prefixes(NamedTuple):
    """Rows with a column `prefix`, and the lengths that it has."""

    rows: DataFrame
    lengths: tuple[int, ...]


def _lengths(prefixes) -> tuple[int, ...]:
    return tuple(sorted({len(p) for p in prefixes}))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few hundred rows at most, written into the plan."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(map(value, r))})" for r in rows) + f" AS t({names})")


def dimension(spark: SparkSession, rows: tuple[tuple[str, str, str, str], ...]) -> Prefixes:
    """(ord, prefix, group_id, artifact_id, version)."""
    return Prefixes(F.broadcast(_values(spark, [(i, *r) for i, r in enumerate(rows)], "ord, prefix, group_id, artifact_id, version")), _lengths(r[0] for r in rows))


def indexed(rows: DataFrame, prefix: str) -> Prefixes:
    """An index of a table; its distinct lengths, no more than the longest prefix has letters, are read at once."""
    named = rows.withColumn("prefix", F.col(prefix)).filter("prefix IS NOT NULL")
    return Prefixes(named, tuple(sorted(r[0] for r in named.select(F.length("prefix")).distinct().collect())))


def starting(names: DataFrame, column: str, index: Prefixes, *keys: str, how: str = "inner") -> DataFrame:
    """names with the rows of the index (and of the same keys) whose prefix they start with."""
    name = F.col(column)
    fit = F.filter(F.array(*map(F.lit, index.lengths)), lambda n: n <= F.length(name))
    cut = names.withColumn("prefix", F.explode(F.transform(fit, lambda n: F.substring(name, F.lit(1), n))))
    return cut.join(index.rows, ["prefix", *keys], how)


def first_match(names: DataFrame, column: str, index: Prefixes, exact_first: bool = False) -> DataFrame:
    """Each distinct name with the first row (by ord) of the index whose prefix it starts with; an equal one first if asked."""
    joined = starting(names.select(column).distinct(), column, index)
    order = F.struct(F.when(F.col(column) == F.col("prefix"), 0).otherwise(1) if exact_first else F.lit(0), "ord")
    best = joined.groupBy(column).agg(F.min_by(F.struct("ord", "prefix", "group_id", "artifact_id", "version"), order).alias("hit"))
    return best.select(column, "hit.*")


#: Stages of a resolution, in their order, and the confidences of those that have one.
ANDROIDX, GOOGLE, THIRD_PARTY, IMPORTS, LOOKUP, CORE = range(6)
SURE = {ANDROIDX: 0.95, THIRD_PARTY: 0.85, IMPORTS: 0.85, LOOKUP: 0.75, CORE: 0.9}


def known_dimension(spark: SparkSession) -> Prefixes:
    """(stage, ord, prefix, group_id, artifact_id, version, confidence) of the stages that need no lookup."""
    rows = [(stage, i, *r, SURE[stage]) for stage, dim in ((ANDROIDX, fixed.ANDROIDX), (THIRD_PARTY, fixed.LIBRARIES), (IMPORTS, fixed.LIBRARIES)) for i, r in enumerate(dim)]
    rows += [(GOOGLE, i, *r) for i, r in enumerate(fixed.GOOGLE)]
    return Prefixes(F.broadcast(_values(spark, rows, "stage, ord, prefix, group_id, artifact_id, version, confidence")), _lengths(r[2] for r in rows))


def _placed(rows: DataFrame) -> Column:
    """The place of a row: path and line_no, where it has them."""
    return F.struct("path", "line_no") if "path" in rows.columns else F.lit(None).cast("struct<path:string,line_no:int>")


def hits(spark: SparkSession, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(coordinate, version, confidence, stage, at): what the stages that need no lookup find, one row a name.

    AndroidX and Google rows come from the packages of these categories alone, and the library pass over packages from
    the third-party ones; imports take that pass whatever their category. A name's place is its first one.
    """
    kind = category(F.col("package"))
    stage = F.when(kind == "androidx", ANDROIDX).when(kind == "google", GOOGLE).when(kind == "third_party", THIRD_PARTY)
    names = packages.select(stage.alias("stage"), F.col("package").alias("name"), _placed(packages).alias("at")).filter("stage IS NOT NULL")
    names = names.unionByName(imports.select(F.lit(IMPORTS).alias("stage"), F.col("import").alias("name"), _placed(imports).alias("at")))
    met = starting(names.groupBy("stage", "name").agg(F.min("at").alias("at")), "name", known_dimension(spark), "stage")
    # Library stages take an equal prefix before the first one.
    order = F.struct(F.when((F.col("stage") >= THIRD_PARTY) & (F.col("name") == F.col("prefix")), 0).otherwise(1), "ord")
    best = met.groupBy("stage", "name", "at").agg(F.min_by(F.struct("group_id", "artifact_id", "version", "confidence"), order).alias("hit"))
    return best.select(F.concat_ws(":", "hit.group_id", "hit.artifact_id").alias("coordinate"), "hit.version", F.col("hit.confidence").cast("float").alias("confidence"), "stage", "at")


def last_written(rows: DataFrame) -> DataFrame:
    """(coordinate, version, confidence, first_stage, at) of (coordinate, version, confidence, stage, at, [weak]) rows.

    The last row by stage and place has the value, the first one the position. Weak rows count only without others.
    """
    weak = F.col("weak") if "weak" in rows.columns else F.lit(False)
    value = F.max_by(F.struct("version", "confidence"), F.struct(~weak, "stage", "at", "version"))
    return rows.groupBy("coordinate").agg(value.alias("last"), F.min(F.struct(weak.alias("weak"), "stage", "at")).alias("first")).select("coordinate", "last.version", "last.confidence", F.col("first.stage").alias("first_stage"), "first.at")


def upsert(stages: list[DataFrame]) -> DataFrame:
    """last_written() of a list of stages (group_id, artifact_id, version, confidence[, path, line_no])."""
    rows = [s.select(F.concat_ws(":", "group_id", "artifact_id").alias("coordinate"), "version", F.col("confidence").cast("float").alias("confidence"), F.lit(i).alias("stage"), _placed(s).alias("at")) for i, s in enumerate(stages)]
    return last_written(reduce(DataFrame.unionByName, rows))


def core_rows(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """The core library (coordinate, version, confidence, stage, at) that an appcompat row asks for where some package is AndroidX's."""
    group, artifact, version = fixed.MATERIAL
    asked = rows.select(F.col("coordinate").contains("appcompat").alias("asked"), F.lit(False).alias("used"))
    used = packages.select(F.lit(False).alias("asked"), (category(F.col("package")) == "androidx").alias("used"))
    both = asked.unionByName(used).agg(F.bool_or("asked").alias("asked"), F.bool_or("used").alias("used")).filter("asked AND used")
    place = F.lit(None).cast(rows.schema["at"].dataType)
    return both.select(F.lit(f"{group}:{artifact}").alias("coordinate"), F.lit(version).alias("version"), F.lit(SURE[CORE]).cast("float").alias("confidence"), F.lit(CORE).alias("stage"), place.alias("at"))


def staged(spark: SparkSession, imports: DataFrame, packages: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """(coordinate, version, confidence, stage, at) of all stages but the core library's."""
    rows = hits(spark, imports, packages)
    if lookup is not None:
        names = first_unknown(spark, imports, rows)
        found = look_up(names, lookup).join(names.withColumnRenamed("name", "of"), F.col("name") == F.col("of"))
        rows = rows.unionByName(found.select(F.concat_ws(":", "group_id", "artifact_id").alias("coordinate"), "version", F.lit(SURE[LOOKUP]).cast("float").alias("confidence"), F.lit(LOOKUP).alias("stage"), F.struct("path", "line_no").alias("at")))
    return rows


def resolve(spark: SparkSession, imports: DataFrame, packages: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """(coordinate, version, confidence, first_stage, path, line_no): dependencies of a corpus, with the place that first asks for them.

    Later stages win; the lookup of unknown names (confidence 0.75) is the last of them. Then comes a core library
    (confidence 0.9), unless an earlier stage has it.
    """
    rows = staged(spark, imports, packages, lookup)
    weak = core_rows(rows, packages)
    every = rows.withColumn("weak", F.lit(False)).unionByName(weak.withColumn("weak", F.lit(True)))
    return last_written(every).select("coordinate", "version", "confidence", "first_stage", "at.path", "at.line_no")


def in_order(resolved: DataFrame) -> DataFrame:
    """The surest first; others in the order in which they were first asked for."""
    return resolved.orderBy(F.desc("confidence"), "first_stage", "path", "line_no", "coordinate")


def known_groups(spark: SparkSession, found: DataFrame) -> Prefixes:
    """The platform's prefixes and the groups of the dependencies found."""
    groups = found.select(F.substring_index("coordinate", ":", 1).alias("prefix")).distinct()
    return indexed(materialised(groups.unionByName(_values(spark, [(p,) for p in fixed.PLATFORM], "prefix"))), "prefix")


def unknown_imports(spark: SparkSession, imports: DataFrame, found: DataFrame) -> DataFrame:
    """(name, path, line_no): simple names of imports below no platform prefix and no group of a dependency found, with their first place."""
    known = starting(imports.select("import").distinct(), "import", known_groups(spark, found), how="left_semi").select("import").distinct()
    left = imports.join(known, "import", "left_anti")
    first = left.groupBy(F.substring_index("import", ".", -1).alias("name")).agg(F.min(F.struct("path", "line_no")).alias("at"))
    return first.select("name", "at.path", "at.line_no")


def first_unknown(spark: SparkSession, imports: DataFrame, found: DataFrame, n: int = 15) -> DataFrame:
    """The first n names of unknown_imports(), by the place of their first import."""
    return unknown_imports(spark, imports, found).orderBy("path", "line_no", "name").limit(n)


def fits_platform(group: Column) -> Column:
    """Not of the groups ruled out, and of the groups allowed or without a word that rules others out."""
    any_of = lambda values, test: reduce(lambda a, b: a | b, [test(v) for v in values])
    return ~any_of(fixed.GROUP_BLACKLIST, group.startswith) & (any_of(fixed.GROUP_WHITELIST, group.startswith) | ~any_of(fixed.GROUP_WORDS, group.contains))


def look_up(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """The first fitting row (by ord) of lookup (name, ord, group_id, artifact_id, version) for each name; names without one go."""
    fit = lookup.filter(fits_platform(F.col("group_id"))).join(names.select("name").distinct(), "name")
    return fit.groupBy("name").agg(F.min_by(F.struct("group_id", "artifact_id", "version"), "ord").alias("hit")).select("name", "hit.*")


def by_signature(classes: DataFrame, library: DataFrame) -> DataFrame:
    """(class, group_id, artifact_id): the first library (by ord) of which a signature starts the class name.

    library: (ord, group_id, artifact_id, classSignatures), as sources.files.library_dimension() reads it.
    """
    signatures = library.select("ord", "group_id", "artifact_id", F.explode("classSignatures").alias("signature"))
    met = starting(classes.select("class").distinct(), "class", indexed(signatures, "signature"))
    return met.groupBy("class").agg(F.min_by(F.struct("group_id", "artifact_id"), "ord").alias("hit")).select("class", "hit.*")


def parse_coordinate(text: Column) -> Column:
    """(group_id, artifact_id, version) of g:a:v, or of g:a with the latest release; null for anything else."""
    parts = F.split(text, ":", -1)
    version = F.when(F.size(parts) == 3, F.get(parts, F.lit(2))).when(F.size(parts) == 2, "latest.release")
    return F.when(version.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("group_id"), F.get(parts, F.lit(1)).alias("artifact_id"), version.alias("version")))


def statistics(resolved: DataFrame) -> DataFrame:
    """Libraries found, and how many of them with a confidence of 0.8 at least."""
    return resolved.agg(F.count("*").alias("n_libraries"), F.count_if(F.col("confidence") >= F.lit(0.8).cast("float")).alias("n_sure"))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= F.lit(0.8).cast("float"), "high").when(confidence >= F.lit(0.6).cast("float"), "medium").otherwise("low")


def listing(resolved: DataFrame, every: bool = False) -> DataFrame:
    """(tier, position, text) of what a report lists: surest first, below the high tier with percents, the low tier on demand."""
    percent = (F.col("confidence") * F.lit(100).cast("float")).cast("int").cast("string")
    rows = resolved.withColumn("tier", tier(F.col("confidence"))).filter(F.lit(every) | (F.col("tier") != "low"))
    place = Window.partitionBy("tier").orderBy(F.desc("confidence"), "first_stage", "path", "line_no", "coordinate")
    text = F.concat("coordinate", F.lit(":"), "version", F.when(F.col("tier") == "high", "").otherwise(F.concat(F.lit(" ("), percent, F.lit("%)"))))
    return rows.select("tier", F.row_number().over(place).alias("position"), text.alias("text"))


def latest_versions(dependencies: DataFrame, search: DataFrame) -> DataFrame:
    """dependencies (coordinate, ...) with latest: the version that search (group_id, artifact_id, ord, version) has first; null without one."""
    known = search.groupBy(F.concat_ws(":", "group_id", "artifact_id").alias("coordinate")).agg(F.min_by("version", "ord").alias("latest"))
    return dependencies.join(known, "coordinate", "left")
