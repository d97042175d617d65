"""Whole runs over a source tree: what it depends on, and a project made of it.

Every result is a DataFrame; nothing runs until one is read or written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltworks.functions import resources
from siltworks.operators import extract, facts, manifest, organize, resolve, rewrite, stubs
from siltworks.session import materialised


def analyze(files: DataFrame, lookup: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dependencies, their tiers, statistics and report, obfuscation and languages of files (path, content).

    lookup: what searches for unknown class names find, as resolve.look_up() takes it.
    """
    spark, names = files.sparkSession, facts.summary(files)  # the only pass over the files
    packages = facts.named(names, "package")
    found = materialised(resolve.resolve(spark, facts.named(names, "import"), packages, lookup))
    counts = facts.class_counts(names)
    return {
        "dependencies": resolve.in_order(found),
        "tiers": found.groupBy(resolve.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n")),
        "statistics": resolve.statistics(found),
        "report": dependency_report(found),
        "obfuscation": counts.withColumn("level", extract.obfuscation_level(F.col("n_obfuscated"), F.col("n_classes"))),
        "categories": packages.groupBy(extract.category(F.col("package")).alias("category")).agg(F.count("*").alias("n")),
        "languages": facts.languages(names),
    }


def dependency_report(found: DataFrame) -> DataFrame:
    """(text): a build script's dependencies of the high tier, then those of the medium one, which ask to be verified."""
    row = F.struct((-F.col("confidence")).alias("c"), "first_stage", "path", "line_no", "coordinate", "version")
    line = lambda x: F.concat(F.lit("    implementation '"), x["coordinate"], F.lit(":"), x["version"], F.lit("'"))
    of = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(resolve.tier(F.col("confidence")) == name, row))), line), "\n")
    both = found.agg(of("high").alias("high"), of("medium").alias("medium"))
    medium = F.when(F.col("medium") != "", F.concat(F.lit("\n    // Medium confidence - verify manually\n"), "medium"))
    return both.select(F.concat_ws("\n", F.lit("dependencies {"), F.when(F.col("high") != "", F.col("high")), medium, F.lit("}")).alias("text"))


#: Where the files of each kind lie in a project.
MAIN, RES, ASSETS, NATIVE = "app/src/main/", "app/src/main/res/", "app/src/main/assets/", "app/src/main/jniLibs/"


def generate(files: DataFrame, manifests: DataFrame, resource_files: DataFrame, lookup: DataFrame | None = None, extracted: DataFrame | None = None, about: dict | None = None) -> dict[str, DataFrame]:
    """The files of a project, of sources (path, content), one manifest (xml) and resources (path, content binary).

    Sources lose library and generated code and move to their packages, Kotlin's to a folder of their own; then stubs
    of vendors' kits are added, and stubs and sources are rewritten; last, files over the threshold go and broken
    methods are stubbed. extracted: rows of organize.extracted(), whose native libraries and assets come along.
    about: what a README tells that isn't in the files: generated, source, size_mb, success. `files` of the result are
    all files of the project (path, content binary, kind, n_fixes, n_stubbed[, piece]).
    """
    placed = organize.organize(files, kotlin="kotlin").join(files.select("path", "content"), "path").select(F.col("target").alias("path"), "content")
    own = organize.without_generated(placed)
    made = stubs.stub_files(stubs.classes(stubs.references(own))).select(F.concat(F.lit("java/"), "path").alias("path"), "content")
    whole = own.unionByName(made.join(own.select("path"), "path", "left_anti"))
    fixed = rewrite.fix_files(whole)
    lost = stubs.lost_method_class(extract.lost_methods(whole)).select(F.lit("java/decompiler_stubs/DecompilerStubs.java").alias("path"), "content", F.lit(0).alias("n_fixes"))
    sources = rewrite.degrade(fixed.select("path", F.col("fixed").alias("content"), "n_fixes").unionByName(lost))
    analysis = analyze(files, lookup)
    found, parsed = analysis["dependencies"], manifest.parse(manifests)
    cleaned = resources.cleaned_xml(resource_files, data=True).filter("kept")
    sure = found.filter(F.col("confidence") >= F.lit(0.85).cast("float"))
    texts = project_texts(parsed, analysis, sure, manifest.source_flags(files), extracted, about or {})
    rows = [_kind(sources, MAIN, F.when(F.col("path").startswith("kotlin/"), "kotlin").otherwise("java")), _kind(cleaned.select("path", F.col("data").alias("content")), RES, F.lit("resource")), _kind(texts, "", F.lit("text"))]
    if extracted is not None:
        for folder, target, kind in (("native/", NATIVE, "native"), ("assets/", ASSETS, "asset")):
            below = extracted.filter(F.col("path").startswith(folder)).withColumn("path", F.substring("path", len(folder) + 1, 1 << 30))
            rows.append(_kind(below.select("path", "content", "piece"), target, F.lit(kind)))
    return {
        "sources": sources,
        "files": reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows),
        "counts": organize.counts(files),
        "resources": cleaned.drop("data"),
        "manifest": parsed.select(manifest.manifest_text(F.struct("permissions", "activities", "services", "receivers")).alias("text")),
        "defaults": parsed.select(*[v.alias(k) for k, v in manifest.build_defaults(F.col("target_sdk"), F.col("min_sdk")).items()], manifest.project_name(F.col("package")).alias("project")),
        "dependencies": sure,
        "flags": manifest.dependency_flags(found),
        "settings": parsed.select(manifest.settings_text(manifest.project_name(F.col("package"))).alias("text")),
        "texts": texts,
    }


def _kind(rows: DataFrame, folder: str, kind) -> DataFrame:
    count = lambda name: F.col(name) if name in rows.columns else F.lit(0)
    piece = ["piece"] if "piece" in rows.columns else []
    return rows.select(F.concat(F.lit(folder), "path").alias("path"), F.col("content").cast("binary").alias("content"), kind.alias("kind"), count("n_fixes").cast("int").alias("n_fixes"), count("n_stubbed").cast("int").alias("n_stubbed"), *piece)


def project_texts(parsed: DataFrame, analysis: dict[str, DataFrame], sure: DataFrame, source_flags: DataFrame, extracted: DataFrame | None, about: dict) -> DataFrame:
    """(path, content): the build files, manifest, keep rules, settings and README of a project.

    All that meets here is one row: the manifest, flags, counts, and lists of a build's dependencies and native libraries.
    """
    order = F.struct((-F.col("confidence")).alias("c"), "first_stage", "path", "line_no", "coordinate", "version", "confidence")
    detected = sure.agg(F.array_sort(F.collect_list(order)).alias("detected"))
    flags = manifest.dependency_flags(analysis["dependencies"]).crossJoin(source_flags).select(F.struct("*").alias("flags"))
    one = parsed.crossJoin(flags).crossJoin(detected).crossJoin(analysis["obfuscation"].select(F.col("n_classes"), (F.col("level") != "NONE").alias("obfuscated")))
    if extracted is None:
        one = one.withColumns({"multidex": F.lit(False), "native": F.lit(None).cast("array<struct<abi:string,n:bigint>>")})
    else:
        names = extracted.filter("piece = 0").groupBy(F.split("path", "/")[0].alias("top"), F.when(F.col("path").startswith("native/"), F.split("path", "/")[1]).alias("abi")).agg(F.count("*").alias("n"))
        facts_of = names.agg((F.coalesce(F.sum(F.when(F.col("top") == "dex", F.col("n"))), F.lit(0)) > 1).alias("multidex"), F.array_sort(F.collect_list(F.when(F.col("abi").isNotNull(), F.struct("abi", "n")))).alias("native"))
        one = one.crossJoin(facts_of)
    build = one.withColumns({k: v for k, v in manifest.build_defaults(F.col("target_sdk"), F.col("min_sdk")).items() if k == "java_version"})
    build = build.withColumns({"app": F.struct("package", "version_code", "version_name", "multidex", "java_version", *[v.alias(k) for k, v in manifest.build_defaults(F.col("target_sdk"), F.col("min_sdk")).items() if k != "java_version"])})
    core = manifest.core_dependencies(F.col("flags.kotlin"))
    project = manifest.project_name(F.col("package"))
    told = {"generated": "", "source": "", "size_mb": 0.0, "success": 100} | about
    readme = F.struct(project.alias("project"), "package", "version_name", "version_code", "min_sdk", "target_sdk", "n_classes", "obfuscated", *[F.lit(v).alias(k) for k, v in told.items()])
    texts = {
        "app/build.gradle": manifest.build_text(F.col("app"), F.col("flags"), core, F.col("detected")),
        "app/proguard-rules.pro": manifest.keep_rules(F.coalesce("application", F.concat("package", F.lit(".Application"))), F.col("flags")),
        "app/src/main/AndroidManifest.xml": manifest.manifest_text(F.struct("permissions", "activities", "services", "receivers")),
        "settings.gradle": manifest.settings_text(project),
        "gradle.properties": manifest.properties_text(),
        "README.md": manifest.readme_text(readme, core, F.col("detected"), F.col("native")),
    }
    return build.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), t.alias("content")) for p, t in texts.items()])).alias("x")).select("x.*")


def write_project(made: dict[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, int]:
    """Writes all files of generate() below root and gives the counts of that same pass: nothing is read for them."""
    seen = Observation()
    files = made["files"]
    kinds = ("java", "kotlin", "resource", "asset", "native", "text")
    first = F.coalesce(F.col("piece"), F.lit(0)) == 0 if "piece" in files.columns else F.lit(True)
    counted = files.observe(
        seen, F.count_if(first).alias("files"), *[F.count_if(first & (F.col("kind") == k)).alias(k) for k in kinds],
        F.count_if(F.col("n_fixes") > 0).alias("fixed_files"), F.coalesce(F.sum("n_fixes"), F.lit(0)).alias("fixes"), F.coalesce(F.sum("n_stubbed"), F.lit(0)).alias("stubbed_methods"),
    )
    organize.write_files(counted, root, mode)
    return {k: int(v) for k, v in seen.get.items()}
