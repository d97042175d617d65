"""The five checks of a project on cases written by hand."""

from siltworks.operators import report

WHOLE = ["app/build.gradle", "app/src/main/AndroidManifest.xml", "app/src/main/java/p/A.java", "settings.gradle", "gradle.properties", "gradlew", "gradle/wrapper/gradle-wrapper.properties"]


def checked(spark, files, runs):
    rows = report.project_checks(spark.createDataFrame(files, "project string, path string"), spark.createDataFrame(runs, "project string, step string, ok boolean, stdout string, stderr string"))
    return rows, {(r.project, r.ord): r for r in rows.collect()}


def test_checks_and_summary(spark):
    files = [("good", p) for p in WHOLE] + [("bad", p) for p in ("app/build.gradle", "app/src/main/javax", "gradlew")] + [("bad", None)]
    good = [("good", s, True, "fine", "") for s in ("sync", "dependencies", "compile")]
    errors = "a b/F.java:3: error: x\nF.java:3: error: x\nnoise\n" + "".join(f"G.java:{i}: error: y\n" for i in range(12))
    bad = [("bad", "sync", False, "", "Error one\nfine\nit FAILED\nerror 3\nerror 4"), ("bad", "dependencies", True, "a FAILED\nCould not resolve b\nok\n" + "Could not find c\n" * 5, ""), ("bad", "compile", False, "H.java:1: error: last", errors)]
    rows, got = checked(spark, files, good + bad)
    assert all(got["good", i].passed and got["good", i].details is None and got["good", i].suggestions == [] for i in range(5))
    assert got["bad", 0].message == "Missing files: app/src/main/AndroidManifest.xml, app/src/main/java, settings.gradle, gradle.properties"
    assert (got["bad", 1].passed, got["bad", 1].message, len(got["bad", 1].suggestions)) == (False, "Gradle wrapper not found", 2)
    assert got["bad", 2].details == "Error one\nit FAILED\nerror 3" and got["bad", 2].suggestions == ["Check build.gradle for syntax errors", "Verify Android SDK is installed"]
    assert got["bad", 3].details.split("\n") == ["a FAILED", "Could not resolve b"] + ["Could not find c"] * 3 and len(got["bad", 3].suggestions) == 3
    assert got["bad", 4].message == "Compilation errors found: 14 errors" and got["bad", 4].details.split("\n")[:2] == ["F.java:3 - x", "G.java:0 - y"] and len(got["bad", 4].details.split("\n")) == 10
    assert {tuple(r) for r in report.check_summary(rows).collect()} == {("good", 5, 5, True), ("bad", 5, 0, False)}


def test_runs_that_fail_silently_or_never_were(spark):
    rows, got = checked(spark, [("a", p) for p in WHOLE], [("a", "sync", False, "", "x" * 600), ("a", "dependencies", False, "", "no network")])
    assert got["a", 2].details == "x" * 500 and got["a", 3].message == "Failed to check dependencies" and got["a", 3].details == "no network" and got["a", 3].suggestions == []
    assert (got["a", 4].message, got["a", 4].details) == ("Compilation errors found: 0 errors", "") and report.check_summary(rows).first().buildable is False
    _, advised = checked(spark, [("a", "x")], [("a", "sync", False, "", "SDK location not found")])
    assert advised["a", 2].suggestions == ["Set ANDROID_HOME environment variable"]
    assert checked(spark, [], [])[1] == {}
