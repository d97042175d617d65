"""Queries over archives and written files. Each first packs the pages table into archives in the shared folder."""

from __future__ import annotations

import io
import os
import warnings
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import organize
from siltworks.plans.catalog import query
from siltworks.session import shared_folder, table
from siltworks.sources import files, stores

#: Pages in one archive.
BUNDLE = 64
_NAME = """CASE page_id % 6 WHEN 0 THEN concat('classes', page_id, '.dex') WHEN 1 THEN concat('lib/x86/', page_id % 4, '/lib', page_id % 8, '.so') WHEN 2 THEN concat('assets/a', page_id % 3, '/p', page_id, '.html')
 WHEN 3 THEN concat('res/raw/p', page_id, '.xml') WHEN 4 THEN concat('META-INF/p', page_id) ELSE concat('lib/x86/lib', page_id % 8, '.so') END"""
_PACKED = f"packed AS (SELECT page_id, concat('b', page_id // {BUNDLE}, '.apk') AS archive, {_NAME} AS entry_name, html FROM pages)"


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of the rows of a bundle, which are BUNDLE at most."""
    held = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        warnings.simplefilter("ignore")  # entries of one name are wanted here
        for r in rows.sort_values("page_id").itertuples():
            archive.writestr(r.entry_name, r.html or "")
    return pd.DataFrame({"path": [rows["archive"].iloc[0]], "content": [held.getvalue()]})


def archives(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the pages as archives."""
    folder = os.path.join(shared_folder(spark), f"archives-{os.urandom(8).hex()}")
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("b"), F.floor(F.col("page_id") / BUNDLE).cast("string"), F.lit(".apk")).alias("archive"), F.expr(_NAME).alias("entry_name"), "html")
    organize.write_files(named.groupBy("archive").applyInPandas(_zipped, "path string, content binary"), folder)
    return folder


def _entries(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    stores.register(spark)
    return spark.read.format("archive").options(**options).load(folder)


def _base(path: str) -> F.Column:
    return F.substring_index(path, "/", -1)


@query(f"WITH {_PACKED} SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS INTEGER) AS entry_no, entry_name, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS sha256 FROM packed")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its content, read in ranges of entries of at most 16 KB (packed), or larger ones where these would be too many tasks."""
    rows = _entries(spark, archives(spark, sf_dir), content="true", split=str(16 << 10))
    return rows.select(_base("archive").alias("archive"), "entry_no", "entry_name", "size", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_PACKED} SELECT archive, entry_name, octet_length(encode(coalesce(html, ''))) AS size FROM packed WHERE entry_name LIKE 'assets/%'")
def archive_names_below_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alone; the filter reaches the source."""
    return _entries(spark, archives(spark, sf_dir)).filter(F.col("entry_name").startswith("assets/")).select(_base("archive").alias("archive"), "entry_name", "size")


_ROUTED = """CASE WHEN entry_name LIKE '%.dex' THEN 'dex/' || entry_name WHEN entry_name LIKE 'lib/%' THEN 'native/x86/' || regexp_extract(entry_name, '[^/]*$') WHEN regexp_matches(entry_name, '^(assets|res)/') THEN entry_name END"""


@query(f"""WITH {_PACKED}, routed AS (SELECT replace(archive, '.apk', '') || '/' || {_ROUTED} AS path, page_id, html FROM packed)
SELECT path, max_by(octet_length(encode(coalesce(html, ''))), page_id) AS length FROM routed WHERE path IS NOT NULL GROUP BY path""")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extraction of all archives leaves on the store: entries of no use are gone, later ones have replaced earlier ones."""
    folder, target = archives(spark, sf_dir), os.path.join(shared_folder(spark), f"extracted-{os.urandom(8).hex()}")
    kept = organize.last_of_each(organize.extracted(_entries(spark, folder, content="true")), organize.extracted(_entries(spark, folder)))
    below = F.concat(F.regexp_replace(_base("archive"), r"\.apk$", ""), F.lit("/"), "path")
    organize.write_files(kept.withColumn("path", below), target)
    return files.named_files(spark, target).select(F.substring_index("path", f"{os.path.basename(target)}/", -1).alias("path"), "length")
