"""Steps that are to grow no faster than their input."""

import pytest
from pyspark.sql import functions as F

from siltworks.operators import extract, facts, organize, rewrite
from siltworks.plans import corpus
from siltworks.session import table

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_corpus_is_made_by_many_tasks(spark, monkeypatch):
    """The part table is one small file: its splits don't decide how many tasks make the texts."""
    assert table(spark, SF, "part").rdd.getNumPartitions() == 1
    made = corpus.corpus(spark, SF)
    assert made.rdd.getNumPartitions() == 4 and made.count() == made.select("path").distinct().count() == table(spark, SF, "part").count()
    monkeypatch.setattr(corpus, "TASK_FILES", 30)
    assert corpus.corpus(spark, SF).rdd.getNumPartitions() == 67


def test_only_lines_that_may_declare_reach_the_summary(spark):
    rows = [("a/A.java", "\n".join(["/* x */", "\t package a.b ; ", " import static x.y.Z.*;", "int important = 1;", "importer.go(); import no;", "class A {", "}", "import"])), ("b/B.kt", "import k.L as M\r\nval x = 1"), ("c/C.java", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    only = facts.facts(files, ("package", "import"))
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(only) == told(facts.facts(files).filter("kind IN ('package', 'import')")) and "Contains(line" in plan(only)
    assert {r.name for r in only.collect()} == {"a.b", "x.y.Z", "x.y", "k.L", "k"}
    assert told(facts.facts(files, ("file", "import"))) == told(facts.facts(files).filter("kind IN ('file', 'import')"))


TEXTS = (
    "", "  \n\t\n", "package a.b;", "\n  // note\r\n/* head\n * more\n */\npackage  c.d ;\nimport x;", "/* one */ package no;\nclass A", "*\r\r\rpackage e.f;", "import x;\npackage late;", "// only", "//\n//\n  package g;  ", "/ package h;\n",
    "\u0085\npackage i;", "// x\n" * 50_000 + "package deep;", "/", "package j.k;x\r\n",
)


def by_lines(content, path):
    """first_package() by its definition, all lines at once."""
    code = F.filter(F.transform(F.split(content, "\r\n|\n|\r"), extract.trimmed), lambda t: (t != "") & ~t.startswith("//") & ~t.startswith("/*") & ~t.startswith("*"))
    first = F.coalesce(F.get(code, F.lit(0)), F.lit(""))
    below = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/[^/]*$", ""), "^.*?sources/(.*)$", 1), "/", ".")
    return F.when(first.startswith("package "), extract.trimmed(F.regexp_replace(F.substring(first, 9, 1 << 30), ";$", ""))).otherwise(below)


def test_first_package_reads_no_further_than_its_line(spark):
    rows = [(f"out/sources/p{i}/A.java", t) for i, t in enumerate(TEXTS)] + [("sources/x/B.java", None)]
    got = spark.createDataFrame(rows, "path string, content string").select("path", extract.first_package(F.col("content"), F.col("path")).alias("a"), by_lines(F.col("content"), F.col("path")).alias("b")).collect()
    assert [(r.path, r.a) for r in got] == [(r.path, r.b) for r in got]


@pytest.mark.parametrize("made", [organize.with_package, organize.organize, organize.counts])
def test_packages_are_told_without_moving_contents(spark, made):
    """No join by package, which few packages of many files would make uneven, and one evaluation of it."""
    text = plan(made(corpus.corpus(spark, SF)))
    assert "Join" not in text and "Generate" in text


def test_whole_words_of_library_packages(spark):
    names = ["com.visa", "com.visa.x", "com.visax", "xcom.visa", "comXvisa.y", "okhttp3"]
    files = spark.createDataFrame([(f"{n}.java", f"package {n};") for n in names], "path string, content string")
    assert {r.package for r in organize.with_package(files).filter("is_library").collect()} <= {"com.visa", "com.visa.x", "okhttp3"}
    assert "okhttp3" in {r.package for r in organize.with_package(files).filter("is_library").collect()}


def test_a_threshold_reads_the_last_pass_once(spark):
    """The filter of degrade() isn't moved below the passes with their expressions in place of each mention of the text."""
    files = corpus.corpus(spark, SF).filter(F.col("path").endswith(".java"))
    fixed = rewrite.fix_files(files).select("path", F.col("fixed").alias("content"))
    marks = lambda df: plan(df).count("JADX FIX: removed unknown type") + plan(df).count(r"\s+\z")
    assert marks(rewrite.degrade(fixed)) <= 2 * marks(fixed)


def test_a_pass_hands_on_one_text(spark):
    """What goes through the Python passes doesn't get wider with each of them."""

    def widest(node):
        return max([node.output().size(), *(widest(node.children().apply(i)) for i in range(node.children().size()))])

    files = corpus.corpus(spark, SF).select("path", "content")
    assert widest(rewrite.fix_files(files)._jdf.queryExecution().optimizedPlan()) <= 7


def test_words_that_touch_are_rewritten_alike(spark):
    text = "x == truey == true; a!=falseb ==  false; true == n; m[0] == true; i = j == true ? 1 : 0"
    made = spark.createDataFrame([(text,)], "content string").select(rewrite.int_booleans(F.col("content")), rewrite.int_ternaries(F.col("content"))).first()
    assert made[0] == "x != 0y != 0; a != 0b == 0; true == n; m[0] == true; i = j != 0 ? 1 : 0"
    assert made[1] == text.replace("i = j == true ? 1 : 0", "i = (j != 0) ? 1 : 0")


def test_longer_logs_come_in_longer_pieces():
    """The batches of the streamed logs stay few as the table grows, until pieces have their greatest length."""
    from siltworks.plans import project_queries as q

    pieces = lambda lines: -(-lines // (q.LOGS * q.piece_lines(lines))) * q.LOGS
    assert q.piece_lines(2000) == 100 and pieces(2000) > 2 * q.BATCH
    assert all(pieces(n) <= (q.PIECES + 1) * q.LOGS for n in (20_000, 120_000, 1_200_000, 7_200_000)) and q.piece_lines(10**9) == q.LONGEST
