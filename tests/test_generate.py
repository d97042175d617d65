"""A whole project written from sources, a manifest, resources and an archive, and the counts of that one pass."""

import os
import zipfile

from pyspark.sql import functions as F

from siltworks.operators import manifest, organize
from siltworks.plans import pipelines
from siltworks.sources import stores

SOURCES = [
    ("s/A.java", "package com.acme;\nimport androidx.appcompat.app.AppCompatActivity;\nclass A {\n  public int f() {\n    if (a == true) { x(y); }\n  }\n}\n"),
    ("s/K.kt", "package com.acme.ui\nclass K { val b = Binding.inflate(x) }\n"),
    ("s/B.java", "package okio;\nclass B {}"),
]


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_a_project_is_written_in_one_pass(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.apk", "w") as z:
        for name in ("classes.dex", "classes2.dex", "lib/x86/libn.so", "assets/a/b.bin"):
            z.writestr(name, os.urandom(5 << 20) if name.endswith("bin") else name)
    stores.register(spark)
    entries = organize.extracted(spark.read.format("archive").option("content", "true").load(str(tmp_path / "x.apk")))
    manifests = spark.createDataFrame([("<manifest package='com.acme.demo' android:versionCode='1234567' xmlns:android='x'><uses-sdk android:targetSdkVersion='33'/></manifest>",)], "xml string")
    resources = spark.createDataFrame([("layout/A b.xml", b"\xef\xbb\xbf<a/>"), ("raw/x.bin", b"\x00\x01"), ("layout/c.xml", b"no xml")], "path string, content binary")
    made = pipelines.generate(spark.createDataFrame(SOURCES, "path string, content string"), manifests, resources, extracted=entries, about={"source": "x.apk", "size_mb": 5.0, "success": 97})
    counts = pipelines.write_project(made, str(tmp_path / "out"))
    got = tree(tmp_path / "out")
    main = "app/src/main/"
    assert set(got) == {
        main + "java/com/acme/A.java", main + "kotlin/com/acme/ui/K.kt", main + "res/layout/a_b.xml", main + "res/raw/x.bin", main + "assets/a/b.bin", main + "jniLibs/x86/libn.so",
        main + "AndroidManifest.xml", "app/build.gradle", "app/proguard-rules.pro", "settings.gradle", "gradle.properties", "README.md",
    }
    fixes = made["sources"].agg(F.sum("n_fixes")).first()[0]  # a second run of the passes, which the counts do without
    assert counts == {"files": 12, "java": 1, "kotlin": 1, "resource": 2, "asset": 1, "native": 1, "text": 6, "fixed_files": 1, "fixes": fixes, "stubbed_methods": 1}
    assert got[main + "res/layout/a_b.xml"] == b"<a/>" and got[main + "res/raw/x.bin"] == b"\x00\x01" and len(got[main + "assets/a/b.bin"]) == 5 << 20 and got[main + "jniLibs/x86/libn.so"] == b"lib/x86/libn.so"
    build = got["app/build.gradle"].decode()
    assert "com.google.android.material:material:1.11.0' \n" not in build and "    // Detected third-party libraries\n    implementation 'androidx.appcompat:appcompat:1.6.1'" in build
    for text in ("id 'org.jetbrains.kotlin.android'", "    namespace 'com.acme.demo'\n    compileSdk 34\n", "        versionCode 1234567\n", "        multiDexEnabled true\n    }\n", "VERSION_11", "jvmTarget = '11'", "    buildFeatures {\n        viewBinding = true\n    }\n\n    packaging {", "multidex:2.0.1'\n\n    // Testing", "espresso-core:3.5.1'\n}\n"):
        assert text in build, text
    assert "-keep class com.acme.demo.Application { *; }" in got["app/proguard-rules.pro"].decode() and "x86" in got["README.md"].decode()


def test_build_script_without_anything(spark):
    row = F.struct(F.lit("p.q").alias("package"), *[F.lit(34).alias(n) for n in ("compile_sdk", "target_sdk")], F.lit(21).alias("min_sdk"), F.lit(1).alias("version_code"), F.lit("1.0").alias("version_name"), F.lit(17).alias("java_version"), F.lit(False).alias("multidex"))
    flags = F.struct(*[F.lit(False).alias(n) for n in ("kotlin", "hilt", "firebase", "crashlytics", "compose", "view_binding", "data_binding")])
    none = F.array().cast("array<struct<coordinate:string,version:string,confidence:float>>")
    text = spark.range(1).select(manifest.build_text(row, flags, manifest.core_dependencies(F.lit(False)), none)).first()[0]
    head, android, last = text.split("\n\nandroid {")[0], text.split("\n\nandroid {")[1].split("\n\ndependencies {")[0], text.split("\n\ndependencies {")[1]
    assert head == "plugins {\n    id 'com.android.application' version '8.2.0'\n}"
    assert "    compileOptions {\n        sourceCompatibility JavaVersion.VERSION_17\n        targetCompatibility JavaVersion.VERSION_17\n    }\n\n    packaging {" in android and "multiDex" not in android
    assert last.startswith("\n    // Core Android libraries\n    implementation 'androidx.core:core:1.12.0'\n") and "constraintlayout:2.1.4'\n\n\n\n    // Testing dependencies\n" in last
