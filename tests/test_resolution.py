"""The prefix index, facts of one pass, and the stages, order and core library of a resolution."""

import pytest
from pyspark.sql import functions as F

from siltworks.operators import extract, facts, resolve
from siltworks.plans import catalog, pipelines, tree_queries  # noqa: F401 - adds its queries to the catalog
from siltworks.sources.files import lines_of

FILES = [
    ("b/One.java", "package androidx.appcompat.app;\nimport androidx.room.Database;\nimport static x.y.Z;\npublic class a {\nprivate int get(View v) {}\n}"),
    ("a/Two.kt", "package q.r\nimport okhttp3.OkHttpClient as C\nimport x.y.*\ndata class Two"),
    ("c/ab.java", ""),
    ("c/Null.java", None),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def imports(spark, *names):
    return spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "path string, line_no int, import string")


def packages(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "package string")


def resolved(*a, **k):
    return {r.coordinate: (r.version, round(r.confidence, 2), r.first_stage) for r in resolve.resolve(*a, **k).collect()}


def test_index_joins_by_equality_and_agrees_with_startswith(spark):
    names = ["a", "a.b", "ab", "a.bc", "", "é.x", "zz", None]
    prefixes = [("a", 0), ("a.b", 1), ("é", 2), ("zzz", 3), ("a.b", 4), (None, 5)]
    index = resolve.indexed(spark.createDataFrame(prefixes, "p string, ord int"), "p")
    assert index.lengths == (1, 3)
    met = resolve.starting(spark.createDataFrame([(n,) for n in names], "n string"), "n", index)
    assert sorted((r.n, r.ord) for r in met.collect()) == sorted((n, o) for n in names if n is not None for p, o in prefixes if p is not None and n.startswith(p))
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_no_prefixes_match_nothing(spark):
    index = resolve.indexed(spark.createDataFrame([], "p string, ord int"), "p")
    assert resolve.starting(packages(spark, "a"), "package", index).count() == 0


def test_core_library_comes_with_appcompat(spark):
    core = "com.google.android.material:material"
    one = packages(spark, "androidx.appcompat.app")
    assert resolved(spark, imports(spark), one) == {"androidx.appcompat:appcompat": ("1.6.1", 0.95, 0), core: ("1.11.0", 0.9, 5)}
    # An import alone names no package of AndroidX here, another package doesn't ask for it, and an earlier stage's row stays.
    assert core not in resolved(spark, imports(spark, "androidx.appcompat.app.X"), packages(spark, "q"))
    assert core not in resolved(spark, imports(spark), packages(spark, "androidx.room"))
    assert resolved(spark, imports(spark, "com.google.android.material.Button"), one)[core] == ("1.11.0", 0.85, 3)
    assert resolved(spark, imports(spark), packages(spark)) == {}


def test_later_places_write_over_earlier_ones_and_first_places_give_the_order(spark):
    place = "group_id string, artifact_id string, version string, confidence double, path string, line_no int"
    stages = [spark.createDataFrame(r, place) for r in ([("g", "a", "2", 0.9, "b", 0), ("g", "a", "1", 0.9, "a", 5), ("h", "c", "1", 0.9, "a", 7)], [("h", "c", "9", 0.5, "z", 1)])]
    got = {r.coordinate: (r.version, r.first_stage, tuple(r["at"])) for r in resolve.upsert(stages).collect()}
    assert got == {"g:a": ("2", 0, ("a", 5)), "h:c": ("9", 0, ("a", 7))}
    found = resolve.resolve(spark, spark.createDataFrame([("z", 0, "okio.A"), ("a", 3, "retrofit2.B"), ("a", 1, "io.reactivex.C")], "path string, line_no int, import string"), packages(spark))
    assert [(r.path, r.line_no) for r in resolve.in_order(found).collect()] == sorted((r.path, r.line_no) for r in found.collect())


def test_facts_equal_the_single_extractors(spark, files):
    lines, made = lines_of(files), facts.facts(files)
    of = lambda kind: sorted(map(tuple, made.filter(F.col("kind") == kind).select("path", "line_no", "name").collect()))
    assert of("import") == sorted(map(tuple, extract.imports(lines).collect()))
    assert of("class") == sorted(map(tuple, extract.classes(lines).collect()))
    every = extract.packages(lines).union(extract.imports(lines).select("path", "line_no", extract.package_of(F.col("import"))).filter(extract.package_of(F.col("import")) != ""))
    assert of("package") == sorted(map(tuple, every.collect()))
    assert len(of("file")) == len(FILES)


def test_summary_gives_counts_languages_and_first_places(spark, files):
    found = facts.summary(files)
    assert facts.class_counts(found).first().asDict() == {"n_classes": 4, "n_obfuscated": 1, "n_methods": 1, "n_short": 1} == extract.class_counts(files).first().asDict() | {"n_methods": 1}
    assert tuple(facts.languages(found).first()) == (True, True)
    empty = facts.summary(files.limit(0))
    assert tuple(facts.class_counts(empty).first())[:2] == (0, 0) and tuple(facts.languages(empty).first()) == (False, False)
    assert {r["import"]: (r.path, r.line_no) for r in facts.named(found, "import").collect()} == {"androidx.room.Database": ("b/One.java", 1), "x.y.Z": ("b/One.java", 2), "okhttp3.OkHttpClient": ("a/Two.kt", 1), "x.y": ("a/Two.kt", 2)}


@pytest.mark.parametrize("name", ["dependency_resolution", "build_script"])
def test_the_corpus_is_read_once_and_no_join_compares_all(spark, name):
    """The plan left after the names are written reads no table of the tree but where the query asks about its files."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("part.parquet") == (1 if name == "build_script" else 0)
    assert "BroadcastNestedLoopJoin" not in plan or name == "build_script"  # there: one row meets one row


def test_a_whole_analysis_has_the_core_library(spark, files):
    found = pipelines.analyze(files)
    assert [r.coordinate for r in found["dependencies"].collect()] == ["androidx.appcompat:appcompat", "com.google.android.material:material", "androidx.room:room-runtime", "com.squareup.okhttp3:okhttp"]
    assert "implementation 'com.google.android.material:material:1.11.0'" in found["report"].first().text
