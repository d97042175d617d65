"""Package manifests as rows, and the build files and manifest written from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import fixed

_NAMES = "array<struct<`_android:name`:string>>"
_FILTER = f"struct<action:{_NAMES},category:{_NAMES},data:array<struct<`_android:scheme`:string,`_android:host`:string,`_android:path`:string,`_android:mimeType`:string>>>"
_COMPONENT = f"array<struct<`_android:name`:string,`_android:exported`:string,`_android:launchMode`:string,`_android:authorities`:string,`intent-filter`:array<{_FILTER}>>>"
SCHEMA = (
    "`_package` string, `_android:versionCode` string, `_android:versionName` string, `uses-sdk` struct<`_android:minSdkVersion`:string,`_android:targetSdkVersion`:string>, "
    f"`uses-permission` {_NAMES}, `uses-feature` {_NAMES}, "
    f"application struct<`_android:name`:string,activity:{_COMPONENT},service:{_COMPONENT},receiver:{_COMPONENT},provider:{_COMPONENT}>, _corrupt_record string"
)
#: Values of attributes that are missing or no numbers. Fixed values.
DEFAULTS = {"package": "unknown", "version_code": 1, "version_name": "1.0", "min_sdk": 21, "target_sdk": 34}


def _list(items: Column, of) -> Column:
    return F.coalesce(F.transform(items, of), F.array())


def _names(items: Column) -> Column:
    return F.coalesce(F.filter(F.transform(items, lambda x: x["_android:name"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def _filters(items: Column) -> Column:
    data = lambda d: F.struct(*[d[f"_android:{a}"].alias(b) for a, b in (("scheme", "scheme"), ("host", "host"), ("path", "path"), ("mimeType", "mime_type"))])
    one = lambda f: F.struct(_names(f["action"]).alias("actions"), _names(f["category"]).alias("categories"), F.coalesce(F.transform(f["data"], data), F.array()).alias("data"))
    return F.coalesce(F.transform(items, one), F.array())


def _component(x: Column) -> Column:
    exported = F.lower(F.coalesce(x["_android:exported"], F.lit("false"))) == "true"
    return F.struct(F.coalesce(x["_android:name"], F.lit("")).alias("name"), exported.alias("exported"), x["_android:launchMode"].alias("launch_mode"), x["_android:authorities"].alias("authorities"), _filters(x["intent-filter"]).alias("filters"))


def parse(rows: DataFrame) -> DataFrame:
    """rows (..., xml) with the manifest's fields; what isn't there has its default, lists are empty.

    Rows whose text is null or no XML are left out.
    """
    m = F.col("_m")
    number = lambda c, d: F.coalesce(c.try_cast("int"), F.lit(DEFAULTS[d]))
    sdk, app = m["uses-sdk"], m["application"]
    parsed = rows.withColumn("_m", F.from_xml("xml", SCHEMA, {"attributePrefix": "_"})).filter("_m IS NOT NULL AND _m._corrupt_record IS NULL")
    fields = {
        "package": F.coalesce(m["_package"], F.lit(DEFAULTS["package"])),
        "version_code": number(m["_android:versionCode"], "version_code"),
        "version_name": F.coalesce(m["_android:versionName"], F.lit(DEFAULTS["version_name"])),
        "min_sdk": number(sdk["_android:minSdkVersion"], "min_sdk"),
        "target_sdk": number(sdk["_android:targetSdkVersion"], "target_sdk"),
        "compile_sdk": number(sdk["_android:targetSdkVersion"], "target_sdk"),
        "application": app["_android:name"],
        "permissions": _names(m["uses-permission"]),
        "features": _names(m["uses-feature"]),
        **{kind: F.coalesce(F.transform(app[one], _component), F.array()) for kind, one in (("activities", "activity"), ("services", "service"), ("receivers", "receiver"), ("providers", "provider"))},
    }
    return parsed.select(*rows.columns, *[v.alias(k) for k, v in fields.items()])


def archive_facts(entries: DataFrame) -> DataFrame:
    """(archive, n_dex, is_multidex, native) of archive entries (archive, entry_name)."""
    name = F.col("entry_name")
    native = F.sort_array(F.collect_list(F.when(name.endswith(".so"), name)))
    return entries.groupBy("archive").agg(F.count_if(name.endswith(".dex")).alias("n_dex"), native.alias("native")).select("archive", "n_dex", (F.col("n_dex") > 1).alias("is_multidex"), "native")


def is_component_name(name: Column) -> Column:
    return (name != "") & ~name.startswith("http://") & ~name.startswith("https://") & name.contains(".")


def first_by_name(items: Column) -> Column:
    """The valid components of a list, the first of each name."""
    valid = F.filter(items, lambda x: is_component_name(x["name"]))
    names = F.transform(valid, lambda x: x["name"])
    return F.filter(valid, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def sdk_name(sdk: Column) -> Column:
    known = F.create_map(*[x for k, v in fixed.SDK_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, sdk), F.concat(F.lit("API "), sdk.cast("string")))


def project_name(package: Column) -> Column:
    return F.substring_index(package, ".", -1)


def label(package: Column) -> Column:
    """The project's name with its first letter in upper case."""
    name = project_name(package)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def build_defaults(target: Column, least: Column) -> dict[str, Column]:
    """Versions that a build uses: at least 34 to compile and target, at least 21 to run, and Java's."""
    return {"compile_sdk": F.greatest(target, F.lit(34)), "target_sdk": F.greatest(target, F.lit(34)), "min_sdk": F.greatest(least, F.lit(21)), "java_version": F.when(target >= 34, 17).otherwise(11)}


def dependency_flags(dependencies: DataFrame) -> DataFrame:
    """What the dependencies (coordinate) turn on in a build."""
    group, artifact = F.substring_index("coordinate", ":", 1), F.get(F.split("coordinate", ":"), F.lit(1))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return dependencies.agg(
        any_of(group.contains("compose")).alias("compose"), any_of(artifact.contains("hilt")).alias("hilt"), any_of(group.contains("firebase")).alias("firebase"),
        any_of(artifact.contains("crashlytics")).alias("crashlytics"), *[any_of(artifact == a).alias(a) for a in ("retrofit", "gson", "okhttp", "glide")],
    )


def source_flags(files: DataFrame) -> DataFrame:
    """What the sources (path, content) turn on in a build."""
    has = lambda *words: F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [F.col("content").contains(w) for w in words])), F.lit(False))
    return files.agg(has("Binding.inflate", "databinding.").alias("view_binding"), has("DataBindingUtil", "@BindingAdapter").alias("data_binding"), F.coalesce(F.bool_or(F.col("path").endswith(".kt")), F.lit(False)).alias("kotlin"))


def core_dependencies(kotlin: Column) -> Column:
    """The dependencies of every build, in their order."""
    return F.concat(F.array(F.when(kotlin, fixed.CORE_KOTLIN).otherwise(fixed.CORE_JAVA)), F.array(*map(F.lit, fixed.CORE)))


def _lines(*parts: Column | str) -> Column:
    """Lines of a file; null ones are left out."""
    return F.concat(F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit("\n"))


def _blocks(items: Column, of) -> Column:
    """The lines that `of` makes of each item; null if there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, of), "\n"))


def manifest_text(row: Column) -> Column:
    """A manifest from the fields of parse(): distinct permissions, components of valid names once each."""
    leaf = lambda tag: lambda n: F.concat(F.lit(f"                <{tag} android:name=\""), n, F.lit('" />'))
    head = lambda tag, x: F.concat(F.lit(f'\n        <{tag}\n            android:name="'), x["name"], F.lit('"\n            android:exported="'), x["exported"].cast("string"))
    filtered = lambda f: F.concat_ws("\n", F.lit("            <intent-filter>"), _blocks(f["actions"], leaf("action")), _blocks(f["categories"], leaf("category")), F.lit("            </intent-filter>"))
    activity = lambda x: F.concat_ws("\n", F.concat(head("activity", x), F.lit('">')), _blocks(x["filters"], filtered), F.lit("        </activity>"))
    plain = lambda tag: lambda x: F.concat(head(tag, x), F.lit('" />'))
    permissions = F.array_distinct(row["permissions"])
    return _lines(
        '<?xml version="1.0" encoding="utf-8"?>', '<manifest xmlns:android="http://schemas.android.com/apk/res/android">', "",
        F.when(F.size(permissions) > 0, F.concat(_blocks(permissions, lambda p: F.concat(F.lit('    <uses-permission android:name="'), p, F.lit('" />'))), F.lit("\n"))),
        "    <application", *[f'        android:{k}="{v}"' for k, v in APPLICATION], '        android:theme="@style/Theme.AppCompat.Light.DarkActionBar">',
        _blocks(first_by_name(row["activities"]), activity), _blocks(first_by_name(row["services"]), plain("service")), _blocks(first_by_name(row["receivers"]), plain("receiver")),
        "    </application>", "</manifest>",
    )


#: Attributes of the application. Fixed values.
APPLICATION = (("allowBackup", "true"), ("icon", "@mipmap/ic_launcher"), ("label", "@string/app_name"), ("roundIcon", "@mipmap/ic_launcher_round"), ("supportsRtl", "true"))
#: Plugins of a build and the flag that each needs, in their order. Fixed values.
PLUGINS = (("kotlin", "org.jetbrains.kotlin.android", "1.9.21"), ("hilt", "com.google.dagger.hilt.android", "2.50"), ("firebase", "com.google.gms.google-services", "4.4.0"), ("crashlytics", "com.google.firebase.crashlytics", "2.9.9"))


def plugin_lines(flags: Column, agp: str = "8.2.0") -> Column:
    """The plugins block of a build script: the conditional lines of PLUGINS whose flag is set."""
    line = lambda p, v: f"    id '{p}' version '{v}'"
    return _lines("plugins {", line("com.android.application", agp), *[F.when(flags[f], line(p, v)) for f, p, v in PLUGINS], "}")


def dependency_lines(core: Column, detected: Column, *more: Column | str) -> Column:
    """The dependencies of a build script: core ones, then detected (coordinate, version, confidence) in their order, then more lines.

    Those of a confidence below 0.9 say so.
    """
    percent = lambda c: F.round(c * 100, 0).cast("int").cast("string")
    one = lambda d: F.concat(F.lit("    implementation '"), d["coordinate"], F.lit(":"), d["version"], F.lit("'"), F.when(d["confidence"] < F.lit(0.9).cast("float"), F.concat(F.lit(" // Confidence: "), percent(d["confidence"]), F.lit("%"))).otherwise(""))
    found = F.when(F.size(detected) > 0, F.concat(F.lit("    // Detected third-party libraries\n"), F.array_join(F.transform(detected, one), "\n")))
    return _lines("dependencies {", "    // Core Android libraries", F.array_join(F.transform(core, lambda d: F.concat(F.lit("    implementation '"), d, F.lit("'"))), "\n"), "", found, *more, "}")


#: Blocks of a build script that are the same in all, and the lines of the last dependencies. Fixed values.
DEFAULTS_END = ("", '        testInstrumentationRunner "androidx.test.runner.AndroidJUnitRunner"', "        vectorDrawables {", "            useSupportLibrary true", "        }")
BUILD_TYPES = (
    "    buildTypes {", "        release {", "            minifyEnabled false", "            proguardFiles getDefaultProguardFile('proguard-android-optimize.txt'), 'proguard-rules.pro'", "        }",
    "        debug {", "            minifyEnabled false", "            debuggable true", "        }", "    }", "",
)
ANDROID_END = (
    "    packaging {", "        resources {", "            excludes += '/META-INF/{AL2.0,LGPL2.1}'", "            excludes += '/META-INF/DEPENDENCIES'", "        }", "    }", "",
    "    lint {", "        abortOnError false", "        checkReleaseBuilds false", "    }", "}",
)
MULTIDEX = "    // MultiDex support\n    implementation 'androidx.multidex:multidex:2.0.1'"
TESTING = ("", "    // Testing dependencies", "    testImplementation 'junit:junit:4.13.2'", "    androidTestImplementation 'androidx.test.ext:junit:1.1.5'", "    androidTestImplementation 'androidx.test.espresso:espresso-core:3.5.1'")
#: Features of a build and the flag that each needs, in their order. Fixed values.
BUILD_FEATURES = (("view_binding", "viewBinding"), ("data_binding", "dataBinding"), ("compose", "compose"))


def android_lines(row: Column, flags: Column) -> Column:
    """The android block of a build script.

    row: package, compile_sdk, min_sdk, target_sdk, version_code, version_name, java_version, multidex. flags: kotlin,
    compose, view_binding, data_binding.
    """
    text = lambda name: row[name].cast("string")
    line = lambda head, name, end="": F.concat(F.lit(head), text(name), F.lit(end))
    features = F.concat_ws("\n", *[F.when(flags[f], f"        {name} = true") for f, name in BUILD_FEATURES])
    return _lines(
        "android {", line("    namespace '", "package", "'"), line("    compileSdk ", "compile_sdk"), "", "    defaultConfig {", line('        applicationId "', "package", '"'),
        line("        minSdk ", "min_sdk"), line("        targetSdk ", "target_sdk"), line("        versionCode ", "version_code"), line('        versionName "', "version_name", '"'), *DEFAULTS_END,
        F.when(row["multidex"], "        multiDexEnabled true"), "    }", "", *BUILD_TYPES,
        "    compileOptions {", line("        sourceCompatibility JavaVersion.VERSION_", "java_version"), line("        targetCompatibility JavaVersion.VERSION_", "java_version"), "    }", "",
        F.when(flags["kotlin"], F.concat(F.lit("    kotlinOptions {\n"), line("        jvmTarget = '", "java_version", "'\n    }\n"))),
        F.when(features != "", F.concat(F.lit("    buildFeatures {\n"), features, F.lit("\n    }\n"))),
        F.when(flags["compose"], "    composeOptions {\n        kotlinCompilerExtensionVersion '1.5.4'\n    }\n"), *ANDROID_END,
    )


def build_text(row: Column, flags: Column, core: Column, detected: Column) -> Column:
    """A whole build script of plugin_lines(), android_lines() and dependency_lines()."""
    dependencies = dependency_lines(core, detected, "", F.when(row["multidex"], MULTIDEX), *TESTING)
    return F.concat_ws("\n", plugin_lines(flags), android_lines(row, flags), dependencies)


#: The settings of a project with one module; the project's name follows. Fixed values.
SETTINGS = """pluginManagement {
    repositories {
        google()
        mavenCentral()
        gradlePluginPortal()
    }
}

dependencyResolutionManagement {
    repositoriesMode.set(RepositoriesMode.FAIL_ON_PROJECT_REPOS)
    repositories {
        google()
        mavenCentral()
        maven { url 'https://jitpack.io' }
    }
}

"""


def settings_text(name: Column) -> Column:
    return F.concat(F.lit(SETTINGS), F.lit('rootProject.name = "'), name, F.lit("\"\ninclude ':app'\n"))


#: Rules that a library needs to be kept, by the flag of dependency_flags(), in their order. Fixed values.
KEEP_RULES = (
    ("retrofit", ("# Retrofit", "-keepattributes Signature", "-keepattributes Exceptions", "-keepclasseswithmembers class * {", "    @retrofit2.http.* <methods>;", "}", "-keepclassmembers,allowshrinking,allowobfuscation interface * {", "    @retrofit2.http.* <methods>;", "}")),
    ("gson", ("# Gson", "-keepattributes Signature", "-keepattributes *Annotation*", "-keep class com.google.gson.** { *; }", *[f"-keep class * implements com.google.gson.{c}" for c in ("TypeAdapterFactory", "JsonSerializer", "JsonDeserializer")])),
    ("okhttp", ("# OkHttp", "-dontwarn okhttp3.**", "-dontwarn okio.**", "-keepnames class okhttp3.internal.publicsuffix.PublicSuffixDatabase")),
    ("glide", ("# Glide", "-keep public class * implements com.bumptech.glide.module.GlideModule", "-keep class * extends com.bumptech.glide.module.AppGlideModule {", "    <init>(...);", "}", "-keep public enum com.bumptech.glide.load.ImageHeaderParser$** {", "    **[] $VALUES;", "    public *;", "}")),
)


def keep_rules(application: Column, flags: Column) -> Column:
    """The rules that keep the application's class and, by the flags, libraries' classes; a blank line after each block."""
    blocks = [F.when(flags[f], F.lit("\n".join(lines) + "\n")) for f, lines in KEEP_RULES]
    return _lines("# Keep Application class", F.concat(F.lit("-keep class "), application, F.lit(" { *; }\n")), *blocks, "# General Android", "-dontwarn android.support.**", "-dontwarn androidx.**")


def properties_text() -> Column:
    """The settings of a build, a line each."""
    return F.lit("".join(f"{k}={v}\n" for k, v in fixed.PROPERTIES))


def readme_text(row: Column, core: Column, detected: Column, native: Column) -> Column:
    """What a project's README tells of it.

    row: project, package, version_name, version_code, min_sdk, target_sdk, generated, source, size_mb, n_classes,
    success (percent), obfuscated. core: coordinates. detected: (coordinate, version, confidence) in their order.
    native: (abi, n) of native libraries; empty or null without.
    """
    cell = lambda name, *value: F.concat(F.lit(f"| {name} | "), *value, F.lit(" |"))
    item = lambda name, *value: F.concat(F.lit(f"- **{name}**: "), *value)
    text = lambda name: row[name].cast("string")
    level = lambda name: (text(name), F.lit(" (Android "), sdk_name(row[name]), F.lit(")"))
    percent = lambda c: F.round(c * 100, 0).cast("int").cast("string")
    found = lambda d: F.concat(F.lit("- `"), d["coordinate"], F.lit(":"), d["version"], F.lit("` ("), percent(d["confidence"]), F.lit("% confidence)"))
    blocks = (
        F.concat(F.lit("# "), row["project"]),
        F.concat_ws(
            "\n", F.lit("## Project Information\n\n| Property | Value |\n|----------|-------|"), cell("Package Name", F.lit("`"), row["package"], F.lit("`")), cell("Version Name", row["version_name"]),
            cell("Version Code", text("version_code")), cell("Min SDK", *level("min_sdk")), cell("Target SDK", *level("target_sdk")),
        ),
        F.concat_ws(
            "\n", F.lit("## Generation Details\n"), item("Generated on", row["generated"]), item("Source APK", row["source"]), item("APK Size", F.format_string("%.1f", row["size_mb"]), F.lit(" MB")),
            item("Total Classes", text("n_classes")), item("Decompilation Success Rate", text("success"), F.lit("%")),
        ),
        F.concat(F.lit("## Detected Dependencies\n\n"), F.size(detected).cast("string"), F.lit(" dependencies were automatically detected:")),
        F.concat_ws("\n", F.lit("### Core Libraries"), _blocks(core, lambda d: F.concat(F.lit("- `"), d, F.lit("`")))),
        F.concat_ws("\n", F.lit("### Third-party Libraries"), _blocks(detected, found)),
        F.when(row["obfuscated"], F.lit("## Known Issues\n\n### Obfuscation Detected\n\nClass and method names of the source may be unclear.")).otherwise(F.lit("## Known Issues")),
        _blocks(native, lambda n: F.concat(F.lit("- **"), n["abi"], F.lit("**: "), n["n"].cast("string"), F.lit(" libraries"))),
        F.lit("### Potential Compilation Errors\n\nCode may fail to compile where dependencies weren't detected or decompilation is incomplete."),
    )
    return F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n"))
