"""Scans of source trees, archives and JSON dimensions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import fixed


def source_files(spark: SparkSession, root: str, extensions: str = "{java,kt}") -> DataFrame:
    """(path, ext, content) of the files below root whose extension matches, case included."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{extensions}")
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.substring_index(path, ".", -1).alias("ext"), F.col("value").alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    r"""(path, line_no, line) from 0; lines end at \n, \r\n or \r."""
    return files.select("path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line_no", "line"))


def zip_entries(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(archive, entry_name, is_dir, content) of the archives below root; names that leave the archive's folder are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for x in archive.infolist():
                        if ".." not in x.filename.split("/") and not x.filename.startswith("/"):
                            out.append((path, x.filename, x.is_dir(), archive.read(x) if content and not x.is_dir() else None))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.binary()), strict=True)], names=["archive", "entry_name", "is_dir", "content"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").mapInArrow(run, "archive string, entry_name string, is_dir boolean, content binary")


def zip_route(entry_name: Column | str) -> Column:
    """Where an archive's entry goes: dex, native, assets or resources; null drops it."""
    name = F.col(entry_name) if isinstance(entry_name, str) else entry_name
    return (
        F.when(name.endswith(".dex"), "dex").when(name.rlike(r"^lib/[^/]*/.*\.so$"), "native").when(name.startswith("assets/") & ~name.endswith("/"), "assets")
        .when((name == "AndroidManifest.xml") | (name == "resources.arsc") | name.startswith("res/"), "resources")
    )


def library_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(ord, library fields) of a JSON document with a `libraries` array; the built-in rows where there is none to read.

    The document is small and its reading is tried at once, so that a broken one is known here.
    """
    fields = "name string, groupId string, artifactId string, packagePrefix string, classSignatures array<string>, latestVersion string"
    try:
        found = spark.read.schema(f"libraries array<struct<{fields}>>").json(path, multiLine=True).select(F.posexplode("libraries").alias("ord", "library")).select("ord", "library.*")
        if found.limit(1).count():
            return found
    except (AnalysisException, SparkRuntimeException):
        pass
    rows = [(i, n, g, a, p, [], v) for i, (n, g, a, p, v) in enumerate(fixed.BUILT_IN)]
    return spark.createDataFrame(rows, f"ord int, {fields}")


def named_files(spark: SparkSession, root: str, extension: str | None = None, pattern: str | None = None) -> DataFrame:
    """(path, length) of the files below root whose extension (in any case) or whose whole name (a regex) matches."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    if extension is not None:
        rows = rows.filter(F.lower(F.regexp_extract("path", r"[.]([^./]*)$", 1)) == extension.lower())
    if pattern is not None:
        rows = rows.filter(F.substring_index("path", "/", -1).rlike(rf"^(?:{pattern})\z"))
    return rows


def zip_resources(entries: DataFrame) -> DataFrame:
    """The resource files of zip_entries(), where no other tool has extracted them."""
    return entries.filter(F.col("entry_name").startswith("res/") & ~F.col("entry_name").endswith("/"))


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def source_folder(spark: SparkSession, root: str) -> str | None:
    """Where the Java sources below root lie: a project's own folder, root if it holds some, else the folder of the first by path."""
    own = f"{root}/{fixed.SOURCE_FOLDER}"
    if _exists(spark, own):
        return own
    if not _exists(spark, root):
        return None
    folder = F.regexp_replace("path", "/[^/]*$", "")
    here = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
    first = named_files(spark, root, pattern=r".*\.java").select(folder.alias("folder"), here.alias("depth"), "path").agg(F.min(F.struct("path", "folder")).alias("first"), F.min(F.struct("depth", "folder")).alias("top")).first()
    if first["first"] is None:
        return None
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    top = first["top"]["folder"]
    return root if spark._jvm.org.apache.hadoop.fs.Path(top).toUri().getPath() == base else first["first"]["folder"]


def is_project(spark: SparkSession, root: str) -> bool:
    """Whether root has a build script where a project has one."""
    return any(_exists(spark, f"{root}/{name}") for name in fixed.BUILD_SCRIPTS)
