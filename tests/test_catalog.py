"""Every catalog query against its SQL in DuckDB, and operators on cases the tables lack."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks.operators import extract, report, resolve, rewrite
from siltworks.plans import catalog, project_queries, rewrite_queries, store_queries, tree_queries  # noqa: F401
from siltworks.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_queries_without_sql_are_those_that_follow_lines():
    known = {"interface_static_block", "orphaned_code", "incomplete_call", "array_declarations", "method_stubbing", "unreachable_rewrite", "fixed_files", "degraded_files"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == known


@pytest.mark.parametrize(
    ("text", "balance"),
    [("{", 1), ('"{"', 0), ("'{' }", -1), ("// {\n{", 1), ("/* { */ }", -1), ('"unterminated {', 0), ("", 0), ('"\\"{"{', 1)],
)
def test_brace_balance(spark, text, balance):
    assert spark.createDataFrame([(text,)], "t string").select(rewrite.brace_balance(F.col("t"))).first()[0] == balance


@pytest.mark.parametrize(("bad", "total", "level"), [(1, 10, "LIGHT"), (3, 10, "MODERATE"), (6, 10, "HEAVY"), (0, 0, "NONE"), (9, 100, "NONE")])
def test_obfuscation_levels_at_the_edges(spark, bad, total, level):
    assert spark.range(1).select(extract.obfuscation_level(F.lit(bad), F.lit(total))).first()[0] == level


def test_later_stage_wins_even_if_less_sure(spark):
    stage = lambda v, c: spark.createDataFrame([("g", "a", v, c)], "group_id string, artifact_id string, version string, confidence double")
    assert [tuple(r)[:2] for r in resolve.upsert([stage("1", 0.95), stage("2", 0.75)]).collect()] == [("g:a", "2")]


def test_exact_match_before_first_prefix(spark):
    dim = resolve.dimension(spark, (("a", "g", "short", "1"), ("a.b", "g", "long", "1")))
    names = spark.createDataFrame([("a.b",), ("a.b.c",)], "n string")
    assert dict(resolve.first_match(names, "n", dim, True).select("n", "artifact_id").collect()) == {"a.b": "long", "a.b.c": "short"}


def test_unreachable_on_a_state_machine(spark):
    lines = ["a();", "return 1;", "dead();", "", "// note", "} else {", "live();", "throw x;", "dead();", "}"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    assert sorted(r[0] for r in rewrite.unreachable(df).filter("dead").select("line_no").collect()) == [2, 8]


def test_method_span_limit(spark):
    for inner, found in ((500, 1), (501, 0)):
        lines = ["public int f() {", *["x();"] * inner, "}"]
        df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
        assert rewrite.method_spans(df).count() == found


def test_source_files_and_zip_entries(spark, tmp_path):
    import zipfile

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "X.java").write_text("package a.b;\r\nimport c.D;\n")
    (tmp_path / "a" / "Y.JAVA").write_text("no")
    found = files.source_files(spark, str(tmp_path / "a"))
    assert found.count() == 1 and files.lines_of(found).count() == 3
    with zipfile.ZipFile(tmp_path / "x.apk", "w") as z:
        for name in ("classes.dex", "lib/x86/a.so", "../evil", "notes.txt"):
            z.writestr(name, "x")
    entries = files.zip_entries(spark, str(tmp_path / "x.apk"))
    assert sorted(r[0] for r in entries.select("entry_name").collect()) == ["classes.dex", "lib/x86/a.so", "notes.txt"]
    assert entries.filter(files.zip_route("entry_name").isNotNull()).count() == 2


def test_put_if_absent(spark):
    made = lambda *names: report.put_if_absent(spark.createDataFrame([(n, "1") for n in names], "coordinate string, version string"), "appcompat", "m:m", "2").count()
    assert (made("x:appcompat"), made("x:y"), made("x:appcompat", "m:m")) == (2, 1, 2)


def test_the_core_library_is_put_after_all_stages(spark):
    """conditional_put_if_absent holds what a resolution with its lookup finds, not the stages before it alone."""
    found = {tuple(r) for r in catalog.dependency_resolution(spark, SF).select("coordinate", "version").collect()}
    looked = {f"{r.group_id}:{r.artifact_id}" for r in catalog.static_lookup_first_doc(spark, SF).collect()}
    got = {tuple(r) for r in catalog.conditional_put_if_absent(spark, SF).collect()}
    assert looked and looked <= {c for c, _ in got} and got == found
