"""Decompilers' logs followed as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltworks.operators.report import log_kind, reported_classes

#: What is kept of a log, and what is told of it.
STATE = "errors long, failed long, classes int, classes_at long"
COUNTERS = "log string, errors long, failed long, classes int, outcome string, ended boolean"


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (kind, n): lines of each kind in the log files that arrive in a folder; other lines don't count.

    The state is one row a kind, whatever the length of the log.
    """
    lines = spark.readStream.schema("value string").text(folder)
    return lines.select(log_kind(F.col("value")).alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def pieces(spark: SparkSession, folder: str, a_batch: int = 1000) -> DataFrame:
    """A stream of (log, line_no, line) of files <log>.<number> that arrive in a folder, each a piece of its log; a_batch files at a time.

    line_no grows over the pieces of a log, whatever the order in which they arrive.
    """
    texts = spark.readStream.schema("value string").option("maxFilesPerTrigger", a_batch).text(folder, wholetext=True)
    name = F.substring_index("_metadata.file_path", "/", -1)
    whole = texts.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("log"), F.substring_index(name, ".", -1).cast("long").alias("piece"), F.posexplode(F.split(F.regexp_replace("value", r"(\r\n|\n|\r)\z", ""), "\r\n|\n|\r")).alias("at", "line"))
    return whole.select("log", (F.col("piece") * F.lit(1 << 32) + F.col("at")).alias("line_no"), "line")


class Counters(StatefulProcessor):
    """A log's counters and the class number that the line of the greatest line_no reported.

    Each batch gives a log's new counters; a log without lines for `quiet` milliseconds (if more than 0) gives them a
    last time, with `ended`, and is forgotten. Lines count by their own place, so the order in a batch doesn't matter.
    """

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        errors, failed, classes, at = self.state.get() if self.state.exists() else (0, 0, None, -1)
        for part in rows:
            errors += int((part["kind"] == "error").sum())
            failed += int(part["kind"].isin(["error", "skipped"]).sum())
            told = part[part["classes"].notna()]
            if len(told):
                top = told.loc[told["line_no"].idxmax()]
                if int(top["line_no"]) > at:
                    classes, at = int(top["classes"]), int(top["line_no"])
        now = (errors, failed, classes, at)
        self.state.update(now)
        if self.quiet > 0:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield self._told(key, now, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.state.get()
        self.state.clear()
        yield self._told(key, now, True)

    @staticmethod
    def _told(key: tuple, now: tuple, ended: bool) -> pd.DataFrame:
        errors, failed, classes, _ = now
        outcome = "failure" if not classes else "success" if errors == 0 else "partial"
        return pd.DataFrame({"log": [key[0]], "errors": [errors], "failed": [failed], "classes": pd.array([classes], dtype="Int32"), "outcome": [outcome], "ended": [ended]})

    def close(self) -> None:
        pass


def counters(lines: DataFrame, quiet: int = 0) -> DataFrame:
    """A stream of a log's counters after each batch that has lines of it, of a stream (log, line_no, line).

    The state of a log is one row, whatever its length. What a line tells is found by the same expressions as for a
    whole log; other lines don't leave the JVM.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = lines.select("log", "line_no", log_kind(F.col("line")).alias("kind"), reported_classes(F.col("line")).alias("classes")).filter("kind IS NOT NULL")
    return told.groupBy("log").transformWithStateInPandas(statefulProcessor=Counters(quiet), outputStructType=COUNTERS, outputMode="Update", timeMode="ProcessingTime" if quiet else "None")
