"""Where the files of a decompiled tree go: packages, library code, target paths, generated files."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import fixed
from siltworks.operators.extract import evaluated_once, first_package, library_package
from siltworks.operators.report import error_marker
from siltworks.sources import stores
from siltworks.sources.files import zip_route


def file_name() -> Column:
    return F.substring_index("path", "/", -1)


def prefix_table(spark: SparkSession, prefixes: tuple[str, ...]) -> DataFrame:
    """(prefix); at most a few hundred rows, written into the plan."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}')" for p in prefixes) + " AS t(prefix)")


def with_package(files: DataFrame) -> DataFrame:
    """files (path, content) with package, and is_library for known prefixes (whole words), renamed and one-letter packages."""
    named = evaluated_once(files, "package", first_package(F.col("content"), F.col("path")))
    known = F.col("package").rlike(rf"^(?:{'|'.join(re.escape(p) for p in fixed.LIBRARY_PACKAGES)})(?:\.|\z)")
    return named.withColumn("is_library", F.coalesce(known, F.lit(False)) | library_package(F.col("package")))


def organize(files: DataFrame, java: str = "java", kotlin: str = "java") -> DataFrame:
    """(target, path, package, language, has_errors): a file for each target path, the last path where several have one.

    Library code is left out; targets are folders by package below one root for each language.
    """
    own = with_package(files).filter(~F.col("is_library"))
    is_kotlin = F.col("path").endswith(".kt")
    folder = F.when(F.col("package") == "", "").otherwise(F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/")))
    target = F.concat(F.when(is_kotlin, kotlin).otherwise(java), F.lit("/"), folder, file_name())
    rows = own.select(target.alias("target"), F.struct("path", "package", F.when(is_kotlin, "KOTLIN").otherwise("JAVA").alias("language"), error_marker(F.col("content")).alias("has_errors")).alias("row"))
    return rows.groupBy("target").agg(F.max_by("row", "row.path").alias("row")).select("target", "row.*")


def counts(files: DataFrame) -> DataFrame:
    """Java and Kotlin files that stay, those of them with error markers, and library files left out."""
    rows = with_package(files)
    own, kotlin = ~F.col("is_library"), F.col("path").endswith(".kt")
    return rows.agg(F.count_if(own & ~kotlin).alias("n_java"), F.count_if(own & kotlin).alias("n_kotlin"), F.count_if(own & error_marker(F.col("content"))).alias("n_errors"), F.count_if(~own).alias("n_skipped"))


def is_generated() -> Column:
    """Whether a file is one that a build makes anew."""
    return file_name().isin("BuildConfig.java", "R.java") | file_name().rlike(r"^R\$.*.java\z")


def without_generated(files: DataFrame) -> DataFrame:
    return files.filter(~is_generated())


def missing_twins(paths: DataFrame, name: str = "ic_launcher", twin: str = "ic_launcher_round") -> DataFrame:
    """(folder): folders of paths that have a file called `name` (whatever its extension) but none called `twin`."""
    split = paths.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("base"))
    return split.groupBy("folder").agg(F.bool_or(F.col("base") == name).alias("one"), F.bool_or(F.col("base") == twin).alias("two")).filter("one AND NOT two").select("folder")


def write_files(files: DataFrame, root: str, mode: str = "append") -> None:
    """(path, content text or binary[, piece]) as files below root, in the folders that the paths name.

    The job's commit puts them there: until then, and if it fails, root is as it was. Pieces of one file follow each
    other in a partition, as the archive source gives them. Paths that would leave root are refused.
    """
    stores.register(files.sparkSession)
    columns = [c for c in ("path", "content", "piece") if c in files.columns]
    try:
        files.select(*columns).write.format("files").mode(mode).save(root)
    except PySparkException as e:
        if "paths must stay below the root" in str(e):
            raise ValueError("paths must stay below the root") from e
        raise


def extracted(entries: DataFrame) -> DataFrame:
    """(path, content, piece) of an archive source's entries, where they go: dex, native/<abi>, assets, or below their own names.

    Entries of no use are left out; of entries that share a path the last of the archive stays. Rows keep their order.
    """
    name = F.col("entry_name")
    route = zip_route(name)
    parts = F.split(name, "/")
    path = (
        F.when(route == "dex", F.concat(F.lit("dex/"), name)).when(route == "native", F.concat(F.lit("native/"), parts[1], F.lit("/"), F.element_at(parts, -1)))
        .when(route == "assets", name).when(route == "resources", name)
    )
    files = entries.filter("NOT is_dir").withColumn("path", path).filter("path IS NOT NULL")
    return files.select("archive", "entry_no", "path", "content", "piece")


def last_of_each(files: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of extracted() that no later entry of the archive replaces; names: the same without contents."""
    last = names.groupBy("archive", "path").agg(F.max("entry_no").alias("last"), F.min("entry_no").alias("first")).filter("first < last").select("archive", "path", "last")
    met = files.join(F.broadcast(last), ["archive", "path"], "left")  # entries whose path another one has
    return met.filter("last IS NULL OR entry_no = last").drop("last")


def write_by_abi(libraries: DataFrame, root: str) -> None:
    """(abi, name, content) as a table with a folder for each ABI."""
    libraries.write.partitionBy("abi").parquet(root)
