"""Names, types and components of packaged resources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("anim", "animator", "color", "drawable", "font", "layout", "menu", "mipmap", "navigation", "raw", "values", "xml")


def resource_type(folder: Column) -> Column:
    kind = F.lower(F.substring_index(folder, "-", 1))
    return F.when(kind.isin(*TYPES), F.upper(kind)).otherwise("UNKNOWN")


def qualifiers(folder: Column) -> Column:
    parts = F.split(folder, "-")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def sanitized(name: Column) -> Column:
    """A resource file name of lower-case letters, digits and single underscores, not led by a digit or underscore."""
    base = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9_]", "_")
    base = F.regexp_replace(F.regexp_replace(base, "^[_0-9]+", ""), "_+", "_")
    return F.concat(F.when(base == "", "res_").otherwise(base), F.regexp_extract(name, r"\.[^.]+$", 0))


def resource_class(kind: Column) -> Column:
    """How a resource type is counted."""
    return F.when(kind == "LAYOUT", "layouts").when(kind.isin("DRAWABLE", "MIPMAP"), "drawables").when(kind == "VALUES", "values").otherwise("others")


def resource_rows(paths: DataFrame) -> DataFrame:
    """paths (path, ...) of a resource tree with type and qualifiers, both from the first folder."""
    folder = F.split("path", "/")[0]
    return paths.withColumns({"type": resource_type(folder), "qualifiers": qualifiers(folder)})


def cleaned_xml(files: DataFrame, data: bool = False) -> DataFrame:
    """(path, content, kept[, data]): resource files by their bytes, cleaned as text.

    values/public.xml goes; names are sanitised and, of files that then share one, the first by its old name stays;
    of .xml files a byte order mark, what precedes the document, control characters and a second declaration go, and
    those that are binary or no XML at all are not kept. Contents are null where a file isn't an .xml.
    data: the bytes to write too, those of the cleaned text or of a file that isn't an .xml.
    """
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.substring_index("path", "/", -1)
    named = files.filter(~F.col("path").rlike("(^|/)values/public\\.xml$")).withColumn("_to", F.concat(folder, sanitized(name)))
    # A file that has its name already comes first, as no other may replace it.
    first = Window.partitionBy("_to").orderBy((F.col("path") != F.col("_to")).cast("int"), "path")
    named = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    raw = F.hex(F.substring("content", 1, 4))
    bare = F.when(raw.startswith("EFBBBF"), F.substring("content", 4, 2147483647)).otherwise(F.col("content"))
    text = F.try_validate_utf8(bare.cast("string"))
    start, tag = F.instr(text, "<?xml"), F.instr(text, "<")
    cut = F.when(start > 1, F.substring(text, start, F.length(text))).when((start == 0) & (tag > 1), F.substring(text, tag, F.length(text))).otherwise(text)
    binary = raw.rlike("^0[03]00....$")
    ok = ~binary & F.regexp_replace(F.col("_cut"), r"^\s+", "").startswith("<") & F.col("_cut").contains(">") & ~F.col("_cut").contains("\0")
    plain = F.regexp_replace(F.col("_cut"), r"^[\x00-\x08\x0B\x0C\x0E-\x1F]+", "")
    once = F.when(F.regexp_count(plain, F.lit(r"<\?xml")) > 1, F.regexp_replace(plain, r"(?s)^(.*?)<\?xml[^?]*\?>\s*<\?xml", "$1<?xml")).otherwise(plain)
    xml = F.col("_to").endswith(".xml")
    out = named.withColumn("_cut", F.when(xml, cut))
    cleaned = F.when(xml & F.coalesce(ok, F.lit(False)), once)
    made = [F.when(xml, cleaned.cast("binary")).otherwise(F.col("content")).alias("data")] if data else []
    return out.select(F.col("_to").alias("path"), cleaned.alias("content"), F.when(xml, F.coalesce(ok, F.lit(False))).otherwise(True).alias("kept"), *made)


def dex_ordinal(name: Column) -> Column:
    number = F.regexp_extract(name, r"^classes([0-9]+)\.dex$", 1)
    return F.when(name == "classes.dex", 0).otherwise(F.coalesce(number.try_cast("int"), F.lit(2147483647)))


def json_dimension(spark: SparkSession, rows: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    """(ord, prefix, ...) from one JSON document with an array `libraries`."""
    doc = json.dumps({"libraries": [dict(zip(("prefix", "group_id", "artifact_id", "version"), r, strict=True)) for r in rows]})
    parsed = F.from_json(F.lit(doc), "libraries array<struct<prefix:string,group_id:string,artifact_id:string,version:string>>")
    return spark.range(1).select(F.posexplode(parsed["libraries"]).alias("ord", "x")).select("ord", "x.*")


def components(rows: DataFrame) -> DataFrame:
    """(k, name, exported) of component elements (k, xml): valid names, the first row of each."""
    name, exported = F.xpath_string("xml", F.lit("/*/@name")), F.xpath_string("xml", F.lit("/*/@exported"))
    named = rows.select("k", name.alias("name"), (exported == "true").alias("exported")).filter((F.col("name") != "") & ~F.col("name").startswith("http") & F.col("name").contains("."))
    return named.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("k"))).filter("_n = 1").drop("_n")


def size_mb(n_bytes: Column) -> Column:
    return n_bytes / F.lit(1048576.0)


def estimated_classes(dex_bytes: Column, n_dex: Column) -> Column:
    """A class for each two kilobytes, at least a hundred a file."""
    return F.greatest(F.floor(dex_bytes / 2048).cast("int"), (n_dex * 100).cast("int"))
