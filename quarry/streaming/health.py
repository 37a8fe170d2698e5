"""Health over time: a project counts as failing when two samples in a row say so, and a queue as stuck when it is long and not shrinking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STUCK = 20
SILENT_MS = 15 * 60 * 1000


def failing_twice(samples: DataFrame) -> DataFrame:
    """(ts, project): samples (ts, project, failing) whose predecessor of the same project failed as well."""
    before = F.lag("failing").over(Window.partitionBy("project").orderBy("ts"))
    return samples.withColumn("_before", before).where("failing AND _before").select("ts", "project")


def stuck(samples: DataFrame) -> DataFrame:
    """(host, ts): samples (host, ts, depth) of at least STUCK whose depth has not gone down since the one before."""
    before = F.lag("depth").over(Window.partitionBy("host").orderBy("ts"))
    return samples.withColumn("_before", before).where((F.col("depth") >= STUCK) & (F.col("_before") <= F.col("depth"))).select("host", "ts")


def latency(samples: DataFrame, *by: str) -> DataFrame:
    """p50 and p99 of a column seconds."""
    p = F.percentile("seconds", F.array(F.lit(0.5), F.lit(0.99)))
    return samples.groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99"))


class Failing(StatefulProcessor):
    """One project's samples (ts, failing): says failing where a sample and the one before it fail, and silent once none has come for a while.

    State is the last sample. Samples of one batch are put in order first; one that is older than the last of an earlier batch is late and is left out.
    """

    SCHEMA = "ts long, project string, status string"

    def __init__(self, silent_ms: int = SILENT_MS):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, failing boolean, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("ts", kind="stable")
        before = self.last.get() if self.last.exists() else None
        if before:
            own = own[own["ts"] > before[0]]
        failing = own["failing"].fillna(False).astype(bool)
        twice = own["ts"][failing & failing.shift(fill_value=bool(before and before[1]))]
        if len(own):
            if before and before[2] in self.handle.listTimers():
                self.handle.deleteTimer(before[2])
            due = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
            self.handle.registerTimer(due)
            self.last.update((int(own["ts"].iloc[-1]), bool(failing.iloc[-1]), due))
        yield self.said(key, twice.tolist(), "failing")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.said(key, [self.last.get()[0]] if self.last.exists() else [], "silent")

    @staticmethod
    def said(key, ts: list[int], status: str) -> pd.DataFrame:
        return pd.DataFrame({"ts": pd.Series(ts, dtype="int64"), "project": pd.Series([key[0]] * len(ts), dtype=object), "status": pd.Series([status] * len(ts), dtype=object)})

    def close(self) -> None:
        pass


def failing_stream(samples: DataFrame, silent_ms: int = SILENT_MS) -> DataFrame:
    """A stream of (project string, ts long, failing) as a stream of (ts, project, status). Needs the RocksDB state store."""
    return samples.groupBy("project").transformWithStateInPandas(Failing(silent_ms), outputStructType=Failing.SCHEMA, outputMode="Append", timeMode="ProcessingTime")
