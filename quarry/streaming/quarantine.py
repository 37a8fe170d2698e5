"""What was deleted stays for a while: a kept index goes to quarantine, comes back on request, and is let go when its time is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP_MS = 7 * 24 * 60 * 60 * 1000


class Quarantine(StatefulProcessor):
    """One project's index. Events: deleted (place: where its data is) and restored. Output: (path, status, place), status taken, restored, expired, or missing for a
    request that finds nothing. A second deletion while one is held starts the time anew and lets the first one's place go.

    State expires by itself, so a timer that is lost leaves nothing behind; the timer is what says so.
    """

    SCHEMA = "path string, status string, place string"

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the value outlives its timer a little, so that what expires can still be named
        self.held = handle.getValueState("held", "place string, until long", ttlDurationMs=self.keep_ms + 24 * 60 * 60 * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said, now = [], timerValues.getCurrentProcessingTimeInMs()
        held = self.held.get() if self.held.exists() else None
        if held and held[1] <= now:  # its timer is due in this batch
            said.append(("expired", held[0]))
            self.handle.deleteTimer(held[1])
            held = None
        for pdf in rows:
            for kind, place in zip(pdf["kind"], pdf["place"]):
                if kind == "deleted":
                    if held:
                        said.append(("expired", held[0]))
                        self._stop(held)
                    held = (place, now + self.keep_ms)
                    said.append(("taken", place))
                elif kind == "restored":
                    said.append(("restored", held[0]) if held else ("missing", None))
                    self._stop(held)
                    held = None
        if held:
            self.held.update(held)
            if held[1] not in self.handle.listTimers():
                self.handle.registerTimer(held[1])
        else:
            self.held.clear()
        yield pd.DataFrame({"path": [key[0]] * len(said), "status": [s for s, _ in said], "place": [p for _, p in said]}, dtype=object)

    def _stop(self, held: tuple | None) -> None:
        if held and held[1] in self.handle.listTimers():
            self.handle.deleteTimer(held[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [self.held.get()[0]] if self.held.exists() else []
        self.held.clear()
        yield pd.DataFrame({"path": [key[0]] * len(gone), "status": ["expired"] * len(gone), "place": gone}, dtype=object)

    def close(self) -> None:
        pass


def quarantined(events: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """A stream of (path, kind, place) as a stream of what becomes of it. Needs the RocksDB state store."""
    return events.groupBy("path").transformWithStateInPandas(Quarantine(keep_ms), outputStructType=Quarantine.SCHEMA, outputMode="Append", timeMode="ProcessingTime")
