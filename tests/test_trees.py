"""Organisation, stubs, manifests, resources and lookups on hand-made cases."""

import json

from pyspark.sql import functions as F

from siltworks.functions import resources
from siltworks.operators import extract, manifest, organize, report, resolve, stubs
from siltworks.sources import files
from siltworks.streaming import logs


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_first_package(spark):
    cases = {
        "package a.b;\nclass C": "a.b", "// x\n/* y\n * z\n */ \n\n  package a.b ;\n": "a.b", "import q;\npackage a;": "deep.in", "": "deep.in", "class D": "deep.in",
    }
    df = spark.createDataFrame([(f"/w/sources/deep/in/F{i}.java", t) for i, t in enumerate(cases)], "path string, content string")
    assert [r[0] for r in df.orderBy("path").select(extract.first_package(F.col("content"), F.col("path"))).collect()] == list(cases.values())
    assert spark.createDataFrame([("src/F.java", "class A")], "path string, content string").select(extract.first_package(F.col("content"), F.col("path"))).first()[0] == ""


def test_library_packages(spark):
    names = ["okhttp3", "okhttp3.x", "okhttp3x", "p024rx.a", "p1j$.time", "p12j", "p12jk", "pgson", "a", "ab", "com.acme", "androidx.core", "ai.x", "aim", "P1gson", "p9MyFlowKit"]
    df = spark.createDataFrame([(f"F{i}.java", f"package {n};") for i, n in enumerate(names)], "path string, content string")
    assert {r.package for r in organize.with_package(df).filter("is_library").collect()} == {"okhttp3", "okhttp3.x", "p024rx.a", "p1j$.time", "p12j", "a", "androidx.core", "ai.x", "p9MyFlowKit"}


def test_organize(spark):
    rows = [("z/A.java", "package a.b;"), ("y/A.java", "package a.b;\n// JADX WARN: x"), ("k/K.kt", "package a.b"), ("n/N.java", "class N"), ("l/L.java", "package okio;")]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r.target: (r.path, r.language, r.has_errors) for r in organize.organize(df, "java", "kotlin").collect()}
    assert got == {"java/a/b/A.java": ("z/A.java", "JAVA", False), "kotlin/a/b/K.kt": ("k/K.kt", "KOTLIN", False), "java/N.java": ("n/N.java", "JAVA", False)}
    assert tuple(organize.counts(df).first()) == (3, 1, 1, 1)
    made = spark.createDataFrame([(p, "") for p in ("a/R.java", "a/R$id.java", "a/BuildConfig.java", "a/Rx.java", "a/R$.kt", "a/XR.java")], "path string, content string")
    assert sorted(r.path for r in organize.without_generated(made).collect()) == ["a/R$.kt", "a/Rx.java", "a/XR.java"]


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b/X.java", "x\n"), ("Y.java", None)], "path string, content string")
    organize.write_files(df, str(tmp_path))
    assert (tmp_path / "a/b/X.java").read_text() == "x\n" and (tmp_path / "Y.java").read_text() == "" and len(list(tmp_path.rglob("*.*"))) == 2
    organize.write_by_abi(spark.createDataFrame([("x86", "liba.so", b"1")], "abi string, name string, content binary"), str(tmp_path / "jni"))
    assert (tmp_path / "jni" / "abi=x86").is_dir()
    try:
        organize.write_files(spark.createDataFrame([("../evil", "")], "path string, content string"), str(tmp_path))
        raise AssertionError
    except ValueError:
        pass


def test_markers_advice_and_logs(spark):
    marks = ["/* JADX WARN: a", "throw new UnsupportedOperationException()", "/* Code decompiled incorrectly", "Method not decompiled", "JADX ERROR", None]
    assert [one(spark, report.error_marker, m) for m in marks] == [True, True, True, False, False, True]
    assert one(spark, report.advice, "Could not find x: SDK location not found") == ["Set ANDROID_HOME environment variable"]
    assert len(one(spark, report.advice, "odd")) == 2
    lines = ["processing ERROR", "INFO 12  classes", "ERROR class: a.B", "WARN Can't process x", "INFO 7 classes", "ERROR INFO classes none"]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    counted = report.log_counters(log)
    assert tuple(counted.first()) == (1, 2, 7)
    assert [tuple(r)[:2] for r in report.log_errors(log).collect()] == [(2, "a.B")]
    assert [report.outcome(counted, n).first().outcome for n in (0, 5)] == ["failure", "partial"] and report.outcome(counted, 5).first().total_classes == 7
    found = report.compile_errors(spark.createDataFrame([("a b/F.java:3: error: x",), ("F.java:3: error: x",), ("F.java:3: warning",)], "line string"))
    assert [r[0] for r in found.collect()] == ["F.java:3 - x"]


def test_followed_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("processing\nERROR x\nERROR y\nother\n")
    stream = logs.follow(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("followed").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert dict(map(tuple, spark.table("followed").collect())) == {"progress": 1, "error": 2}


def test_stages_of_resolution(spark):
    imports = lambda *names: spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "path string, line_no int, import string")
    packages = lambda *names: spark.createDataFrame([(n,) for n in names], "package string")
    got = lambda i, p, **k: {r.coordinate: (round(r.confidence, 2), r.first_stage) for r in resolve.resolve(spark, i, p, **k).collect()}
    # Google's own stage is surer than the library pass, which names another artifact for the same import.
    assert got(imports("com.google.firebase.auth.Token"), packages("com.google.firebase.auth")) == {"com.google.firebase:firebase-auth": (0.95, 1), "com.google.firebase:firebase-common": (0.85, 3)}
    assert got(imports("x.Y"), packages("androidx.room")) == {"androidx.room:room-runtime": (0.95, 0)}
    assert got(imports("androidx.room.Database"), packages("androidx.room")) == {"androidx.room:room-runtime": (0.85, 0)}
    lookup = spark.createDataFrame([("Y", 0, "org.eclipse.y", "y", "1"), ("Y", 1, "io.y", "y", "2"), ("Z", 0, "my.swing", "z", "1")], "name string, ord int, group_id string, artifact_id string, version string")
    assert got(imports("x.Y", "x.Z", "kotlinx.q.Y"), packages("x"), lookup=lookup) == {"io.y:y": (0.75, 4)}


def test_unknown_names_by_place(spark):
    imports = spark.createDataFrame([("b", 0, "p.A"), ("a", 9, "q.B"), ("a", 2, "r.A"), ("a", 1, "java.util.List"), ("a", 0, "androidx.C")], "path string, line_no int, import string")
    found = spark.createDataFrame([("q:lib",)], "coordinate string")
    assert [r.name for r in resolve.first_unknown(spark, imports, found).collect()] == ["C", "A"]


def test_groups_that_fit(spark):
    groups = {"org.eclipse.x": False, "io.foo": True, "my.swing": False, "com.squareup.swing": True, "javafx.x": False, "org.apache.poi": False, "org.apache.commons.awt": True}
    assert {g: one(spark, resolve.fits_platform, g) for g in groups} == groups


def test_coordinates_and_signatures(spark, tmp_path):
    assert [one(spark, resolve.parse_coordinate, t) for t in ("a:b:1", "a:b", "a", "a:b:c:d")] == [("a", "b", "1"), ("a", "b", "latest.release"), None, None]
    doc = {"libraries": [{"name": n, "groupId": n, "artifactId": "a", "packagePrefix": n, "classSignatures": s, "latestVersion": "1"} for n, s in (("x", ["p.C"]), ("y", ["p", "q.D"]))]}
    (tmp_path / "libs.json").write_text(json.dumps(doc, indent=1))
    library = files.library_dimension(spark, str(tmp_path / "libs.json"))
    assert [tuple(r) for r in library.select("ord", "groupId", "classSignatures").orderBy("ord").collect()] == [(0, "x", ["p.C"]), (1, "y", ["p", "q.D"])]
    named = library.withColumnRenamed("groupId", "group_id").withColumnRenamed("artifactId", "artifact_id")
    classes = spark.createDataFrame([("p.C",), ("p.E",), ("q.D.F",), ("r",)], "class string")
    assert {r["class"]: r.group_id for r in resolve.by_signature(classes, named).collect()} == {"p.C": "x", "p.E": "y", "q.D.F": "y"}
    (tmp_path / "broken.json").write_text("{ no")
    for path in ("missing.json", "broken.json"):
        assert files.library_dimension(spark, str(tmp_path / path)).count() == 13


def test_references_and_stubs(spark):
    content = "import com.skt.sdk.AuthListener;\nimport static com.nice.A.b;\nimport com.visa.*;\nimport com.sktx.No;\nx = com.skt.sdk.AuthListener.go(com.tmx.Pay.y());"
    refs = stubs.references(spark.createDataFrame([("f", content)], "path string, content string"))
    assert sorted((r.package, r["class"], r.is_interface, r.kind) for r in refs.collect()) == [
        ("com.nice", "A", False, 2), ("com.nice.A", "b", False, 0), ("com.skt.sdk", "AuthListener", False, 2), ("com.skt.sdk", "AuthListener", True, 0), ("com.tmx", "Pay", False, 2), ("com.visa", "PackageInfo", False, 1),
    ]
    found = stubs.classes(refs)
    assert tuple(stubs.totals(found).first()) == (5, 4, 1)
    made = {r.path: r.content for r in stubs.stub_files(found).collect()}
    head = "package com.skt.sdk;\n\n/**\n * Auto-generated stub interface for SDK: com.skt.sdk.AuthListener\n * This stub allows compilation when the actual SDK is not included.\n */\n@SuppressWarnings(\"unused\")\npublic interface AuthListener {\n\n    /**\n"
    assert made["com/skt/sdk/AuthListener.java"].startswith(head) and made["com/skt/sdk/AuthListener.java"].endswith("    default void onError(Exception error) {}\n}\n\n")
    assert "    public Pay(android.content.Context context) {\n        // Stub constructor\n    }\n\n" in made["com/tmx/Pay.java"]
    enum = spark.range(1).select(stubs.stub_text(F.lit("p"), F.lit("E"), F.lit("enum"))).first()[0]
    assert "public enum E {\n    UNKNOWN;\n\n    /**\n" in enum and enum.endswith("        return 0;\n    }\n}\n\n")
    lost = stubs.lost_method_class(spark.createDataFrame([("b", 0), ("a", 2), ("a", 1)], "name string, n_args int")).first()
    assert lost.n == 3 and [x.strip() for x in lost.content.split("\n") if "static" in x] == ["public static Object a(Object arg0) {", "public static Object a(Object arg0, Object arg1) {", "public static Object b() {"]
    assert stubs.lost_method_class(spark.createDataFrame([], "name string, n_args int")).count() == 0


def test_manifest_of_odd_documents(spark):
    rows = spark.createDataFrame([(1, "<manifest/>"), (2, "no xml"), (3, None), (4, "<manifest><application>")], "k int, xml string")
    got = manifest.parse(rows).collect()
    assert [r.k for r in got] == [1]
    for r in got:
        assert (r.package, r.version_code, r.version_name, r.min_sdk, r.target_sdk, r.compile_sdk, r.permissions, r.activities) == ("unknown", 1, "1.0", 21, 34, 34, [], [])


def test_resource_names_and_cleaning(spark):
    names = {"foo": "foo", "foo.": "foo", "Icon.9.png": "icon_9.png", "__9a.XML": "a.XML", "9.png": "res_.png", "a--b.xml": "a_b.xml"}
    assert {n: one(spark, resources.sanitized, n) for n in names} == names
    raw = [
        ("values/public.xml", b"<a/>"), ("layout/a.xml", b"\xef\xbb\xbf<?xml version='1.0'?><a/>"), ("layout/b.xml", b"junk<?xml version='1.0'?><b/>"), ("layout/c.xml", b"\x03\x00\x08\x00bin"),
        ("layout/d.xml", b"\x03\x00\x08<a>"), ("layout/e.xml", b"  "), ("layout/f.xml", b"<a>\x00</a>"), ("layout/G.xml", b"<g1/>"), ("layout/g.xml", b"<g2/>"), ("raw/x.bin", b"\x00"), ("layout/h.xml", b"\x01<h/>"),
    ]
    got = {r.path: (r.content, r.kept) for r in resources.cleaned_xml(spark.createDataFrame(raw, "path string, content binary")).collect()}
    assert got == {
        "layout/a.xml": ("<?xml version='1.0'?><a/>", True), "layout/b.xml": ("<?xml version='1.0'?><b/>", True), "layout/c.xml": (None, False), "layout/d.xml": (None, False), "layout/e.xml": (None, False),
        "layout/f.xml": (None, False), "layout/g.xml": ("<g2/>", True), "raw/x.bin": (None, True), "layout/h.xml": ("<h/>", True),
    }


def test_files_by_name(spark, tmp_path):
    for n in ("a.JAVA", "b.java", "c.txt"):
        (tmp_path / n).write_text("x")
    base = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert base(files.named_files(spark, str(tmp_path), "java")) == ["a.JAVA", "b.java"]
    assert base(files.named_files(spark, str(tmp_path), pattern="[bc][.].*")) == ["b.java", "c.txt"] and files.named_files(spark, str(tmp_path)).count() == 3
    assert spark.range(1).select(resources.size_mb(F.lit(1572864)), resources.estimated_classes(F.lit(10_000_000), F.lit(2)), resources.estimated_classes(F.lit(10), F.lit(2))).first() == (1.5, 4882, 200)


def test_kotlin_forms(spark):
    rows = [("A.kt", "package a.b;"), ("A.kt", "import a.B as C"), ("A.kt", "data class D(val x: Int)"), ("A.kt", "object E"), ("A.java", "import static a.B.* ;"), ("A.java", "package a.b;")]
    lines = spark.createDataFrame([(p, i, x) for i, (p, x) in enumerate(rows)], "path string, line_no int, line string")
    assert [r.package for r in extract.packages(lines).orderBy("line_no").collect()] == ["a.b;", "a.b"]
    assert [r["import"] for r in extract.imports(lines).orderBy("line_no").collect()] == ["a.B", "a.B"]
    assert [r["class"] for r in extract.classes(lines).orderBy("line_no").collect()] == ["D", "E"]
    assert [one(spark, extract.package_prefix, p) for p in ("androidx.a.b", "com.a.b.c", "org.a.b", "x", "net.a.b.c")] == ["androidx.a", "com.a.b", "org.a", "x", "net.a.b"]


def test_whole_runs(spark):
    from siltworks.plans import pipelines

    rows = [
        ("s/A.java", "package com.acme;\nimport androidx.room.Database;\nimport com.skt.sdk.AuthListener;\nimport x.Y;\nclass A {\n  public int f() {\n    if (a == true) { x(y); }\n  }\n}\n"),
        ("s/B.java", "package okio;\nclass B {}"), ("s/R.java", "package com.acme;\nclass R {}"),
    ]
    files_ = spark.createDataFrame(rows, "path string, content string")
    lookup = spark.createDataFrame([("Y", 0, "io.y", "y", "2")], "name string, ord int, group_id string, artifact_id string, version string")
    found = pipelines.analyze(files_, lookup)
    assert [r.coordinate for r in found["dependencies"].collect()] == ["androidx.room:room-runtime", "io.y:y"]
    assert found["report"].first().text == "dependencies {\n    implementation 'androidx.room:room-runtime:2.6.1'\n\n    // Medium confidence - verify manually\n    implementation 'io.y:y:2'\n}"
    assert tuple(found["statistics"].first()) == (2, 1) and tuple(found["languages"].first()) == (True, False)
    manifests = spark.createDataFrame([("<manifest package='com.acme.demo'/>",)], "xml string")
    made = pipelines.generate(files_, manifests, spark.createDataFrame([("layout/A.xml", b"<a/>")], "path string, content binary"), lookup)
    sources = {r.path: r for r in made["sources"].collect()}
    assert set(sources) == {"java/com/acme/A.java", "java/com/skt/sdk/AuthListener.java"} and sources["java/com/acme/A.java"].n_stubbed == 1
    assert "return 0;" in sources["java/com/acme/A.java"].content and tuple(made["counts"].first()) == (2, 0, 0, 1)
    assert [r.path for r in made["resources"].collect()] == ["layout/a.xml"] and [r.coordinate for r in made["dependencies"].collect()] == ["androidx.room:room-runtime"]
    assert made["settings"].first().text.endswith("rootProject.name = \"demo\"\ninclude ':app'\n") and made["defaults"].first().project == "demo" and made["manifest"].count() == 1


def test_rules_types_and_versions(spark):
    flags = spark.createDataFrame([("a:gson",), ("b:x",)], "coordinate string")
    text = manifest.dependency_flags(flags).select(manifest.keep_rules(F.lit("p.App"), F.struct("*")).alias("t")).first().t
    assert text.startswith("# Keep Application class\n-keep class p.App { *; }\n\n# Gson\n") and "Retrofit" not in text and text.endswith("JsonDeserializer\n\n# General Android\n-dontwarn android.support.**\n-dontwarn androidx.**\n")
    kinds = {"1": "int", "2L": "long", "1.5": "double", "1.5f": "float", "true": "boolean", '"x"': "String", "null": "Object", "new Foo(1)": "Foo", "x": "Object"}
    assert {k: one(spark, extract.literal_type, k) for k in kinds} == kinds
    search = spark.createDataFrame([("a", "gson", 1, "2"), ("a", "gson", 0, "3")], "group_id string, artifact_id string, ord int, version string")
    assert dict(map(tuple, resolve.latest_versions(flags, search).collect())) == {"a:gson": "3", "b:x": None}
