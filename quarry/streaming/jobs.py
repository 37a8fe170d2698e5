"""The work queue as a stream: change events are routed to projects, merged while they wait, and worked off one project at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import incremental

CAP = 200
DELETE_AFTER_MS = 30_000


class Queue(StatefulProcessor):
    """One project's job. Events (path; null: the whole tree) merge into the one that waits, a taken event sends it to work, and a done event ends that.

    Output: root, status (queued, merged, requeued: it waits while another runs, running, done) and paths, null for the whole tree.
    State holds at most CAP paths: beyond them the job is the whole tree, and its paths go.
    """

    SCHEMA = "root string, status string, paths string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", "whole boolean")
        self.running = handle.getValueState("running", "running boolean")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, running = self.whole.exists(), self.running.exists()
        whole = waiting and self.whole.get()[0]
        held = set() if whole or not waiting else {k[0] for k in self.paths.keys()}
        stored, status = set(held), None
        for pdf in rows:
            for kind, path in zip(pdf["kind"], pdf["path"]):
                if kind == "taken":
                    if waiting:
                        yield self.row(key, "running", whole, held)
                        waiting, whole, held, running, status = False, False, set(), True, None
                elif kind == "done":
                    running, status = False, "done" if not waiting else status
                else:
                    if status in (None, "done"):  # what the first event of a batch meets
                        status = "merged" if waiting else "requeued" if running else "queued"
                    waiting = True
                    if path is None or pd.isna(path):
                        whole = True
                    elif not whole:
                        held.add(path)
                    if whole or len(held) > CAP:
                        whole, held = True, set()
        for gone in stored - held:
            self.paths.removeKey((gone,))
        for new in held - stored:
            self.paths.updateValue((new,), (True,))
        self.whole.update((whole,)) if waiting else self.whole.clear()
        self.running.update((True,)) if running else self.running.clear()
        if status is not None:
            yield self.row(key, status, whole or not waiting, held)

    @staticmethod
    def row(key, status: str, whole: bool, held: set[str]) -> pd.DataFrame:
        return pd.DataFrame({"root": [key[0]], "status": [status], "paths": [None if whole else ",".join(sorted(held))]})

    def close(self) -> None:
        pass


class Deletions(StatefulProcessor):
    """A path that went away counts as deleted only when it has not come back for a while."""

    SCHEMA = "path string, deleted boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = [k for pdf in rows for k in pdf["kind"]]
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if kinds and kinds[-1] == "gone":
            at = timerValues.getCurrentProcessingTimeInMs() + DELETE_AFTER_MS
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield pd.DataFrame({"path": pd.Series(dtype=str), "deleted": pd.Series(dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield pd.DataFrame({"path": [key[0]], "deleted": [True]})

    def close(self) -> None:
        pass


def queue(events: DataFrame) -> DataFrame:
    """A stream of (root, kind, path) as a stream of job states. Needs the RocksDB state store."""
    return events.groupBy("root").transformWithStateInPandas(Queue(), outputStructType=Queue.SCHEMA, outputMode="Update", timeMode="None")


def deletions(events: DataFrame) -> DataFrame:
    """A stream of (path, kind) as a stream of confirmed deletions."""
    return events.groupBy("path").transformWithStateInPandas(Deletions(), outputStructType=Deletions.SCHEMA, outputMode="Append", timeMode="ProcessingTime")


def route(events: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path): events by the project that owns their path."""
    return events.select("path").distinct().join(incremental.owners(events.select("path").distinct(), roots), "path").select("root", "path")


def batches(events: DataFrame, roots: DataFrame, work: Callable[[str, list[str] | None], None], ledger: list | None = None) -> Callable:
    """A foreachBatch function: each project's merged hints are worked off, and a failure stays with its project."""

    def run(batch: DataFrame, number: int) -> None:
        for row in incremental.merged_hints(route(batch, roots)).toLocalIterator():
            try:
                work(row.root, row.paths)
            except Exception as error:  # noqa: BLE001  one project's failure must not stop the others
                if ledger is not None:
                    ledger.append((number, row.root, repr(error)))

    return run
