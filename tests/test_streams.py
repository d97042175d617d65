"""Counters of logs that arrive in pieces equal those of the whole logs."""

import random
import time

import pytest

from siltworks.operators import report
from siltworks.streaming import logs

LINES = ["processing A", "INFO 12  classes", "ERROR class: a.B", "WARN Can't process x", "INFO 7 classes", "INFO classes none", "other", "ERROR INFO classes 3", "INFO 99999999999 classes", ""]


def run(stream, state, name, **trigger):
    rows = []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda df, i: rows.extend(df.collect())).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
    return query, rows


@pytest.mark.parametrize("seed", [1, 2])
def test_counters_after_any_split_into_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    (tmp_path / "in").mkdir()
    whole = {name: [rnd.choice(LINES) for _ in range(40)] for name in ("a", "b")} | {"quiet": ["other"] * 3}
    parts = [(name, k, lines[k * 8 : k * 8 + 8]) for name, lines in whole.items() for k in range(5)]
    rnd.shuffle(parts)
    last = {}
    for at in range(0, len(parts), 4):  # a batch each; pieces of a log come in any order
        for name, k, lines in parts[at : at + 4]:
            if lines:
                (tmp_path / "in" / f"{name}.{k}").write_text("\n".join(lines) + "\n")
        query, rows = run(logs.counters(logs.pieces(spark, str(tmp_path / "in"))), str(tmp_path / "state"), f"counters{seed}{at}")
        query.awaitTermination(120)
        assert query.exception() is None
        last |= {r.log: (r.errors, r.failed, r.classes) for r in rows}
    for name in ("a", "b"):
        one = report.log_counters(spark.createDataFrame(list(enumerate(whole[name])), "line_no int, line string")).first()
        assert last[name] == (one.errors, one.failed, one.classes)
    assert "quiet" not in last  # no line of it tells anything


def test_a_quiet_log_ends_and_starts_anew(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.0").write_text("ERROR x\nINFO 5 classes\n")
    query, rows = run(logs.counters(logs.pieces(spark, str(tmp_path / "in")), quiet=1), str(tmp_path / "state"), "ending", processingTime="1 second")
    until = time.time() + 90
    while time.time() < until and not any(r.ended for r in rows):
        time.sleep(0.5)
    (tmp_path / "in" / "a.1").write_text("ERROR y\n")
    while time.time() < until and sum(not r.ended for r in rows) < 2:
        time.sleep(0.5)
    query.stop()
    told = [(r.errors, r.classes, r.outcome, r.ended) for r in rows]
    assert told[:2] == [(1, 5, "partial", False), (1, 5, "partial", True)] and (1, None, "failure", False) in told[2:]


def test_outcome_counts_failed_classes_where_none_are_reported(spark):
    of = lambda lines, n: report.outcome(report.log_counters(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")), n).first()
    assert of(["ERROR x", "WARN Can't process y"], 3).total_classes == 5
    assert of(["INFO 0 classes", "ERROR x"], 3).total_classes == 4
    assert of(["INFO 9 classes", "ERROR x"], 3).total_classes == 9 and of(["INFO 2 classes"], 3).total_classes == 3
