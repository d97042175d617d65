"""A second run over a tree rewrites what changed, and readers see one run or the next."""

import os

import pytest

from siltworks.operators import rewrite, snapshots

TREE = {"a/A.java": "class A { boolean f() { return x == true; } }\n", "b/B.java": "class B {\n", "c/C.java": "class C {}\n", "d/Empty.java": "", "e/Null.java": None}


def frame(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, content string")


def held(spark, home):
    return {r.path: (r.content, r.n_fixes) for r in snapshots.fixed_files(spark, home).collect()}


def whole(spark, tree):
    return {r.path: (r.fixed, r.n_fixes) for r in rewrite.fix_files(frame(spark, tree)).collect()}


def runs(home):
    return sorted(n for n in os.listdir(home) if n.startswith("run-"))


def test_runs_over_a_changing_tree(spark, tmp_path):
    home = str(tmp_path / "kept")
    assert snapshots.current(spark, home) is None
    first = snapshots.refresh(frame(spark, TREE), home)
    assert (first["changed"], first["removed"]) == (5, 0) and held(spark, home) == whole(spark, TREE)
    before = {d: os.listdir(d) for d, _, _ in os.walk(home)}
    assert snapshots.refresh(frame(spark, TREE), home) == {"changed": 0, "removed": 0, "fixes": 0}
    assert {d: os.listdir(d) for d, _, _ in os.walk(home)} == before  # nothing was written

    later = {k: v for k, v in TREE.items() if k != "c/C.java"} | {"b/B.java": "class B { int i = 1;\n", "f/New.java": "class N {}\n"}
    second = snapshots.refresh(frame(spark, later), home)
    assert (second["changed"], second["removed"]) == (2, 1) and held(spark, home) == whole(spark, later) and len(runs(home)) == 2
    last = spark.read.parquet(os.path.join(home, snapshots.current(spark, home), "files"))
    assert sorted(r.path for r in last.collect()) == ["b/B.java", "f/New.java"]

    back = snapshots.refresh(frame(spark, TREE), home)
    assert (back["changed"], back["removed"]) == (2, 1) and held(spark, home) == whole(spark, TREE)


def test_a_run_that_dies_before_the_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "kept")
    snapshots.refresh(frame(spark, TREE), home)
    kept = held(spark, home)

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(snapshots.organize, "write_files", dies)
    with pytest.raises(OSError):
        snapshots.refresh(frame(spark, TREE | {"a/A.java": "class A {}"}), home)
    assert held(spark, home) == kept
    monkeypatch.undo()
    assert snapshots.refresh(frame(spark, TREE | {"a/A.java": "class A {}"}), home)["changed"] == 1
    assert snapshots.refresh(frame(spark, {}), home)["removed"] == 5 and held(spark, home) == {}
