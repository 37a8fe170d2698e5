"""A ledger of passes that a stream appends to: a batch that comes again takes its own place, and old rows go by whole generations.

A generation is a folder of batches. Once the newest one outgrows its bytes the next batch opens another, and the newest two stay: what is
read is at least one full generation. A batch number names its folder, so a replay overwrites what it had written, in whichever generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import fleet
from quarry.sources import tables
from quarry.sources.catalog import Catalog

GENERATIONS, MAX_BYTES = 2, 16 << 20


class Ledger:
    """Rows (ts, id, error and others) in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = MAX_BYTES):
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), max_bytes

    def _names(self, path: str) -> list[str]:
        place, system = Catalog(self.spark, path)._at(path)
        return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []

    def generations(self) -> list[str]:
        """Oldest first; at most GENERATIONS but for a moment."""
        return [n for n in self._names(self.path) if n.startswith("generation=")]

    def _bytes(self, generation: str) -> int:
        place, system = Catalog(self.spark, self.path)._at(f"{self.path}/{generation}")
        return int(system.getContentSummary(place).getLength())

    def put(self, rows: DataFrame, batch: int) -> None:
        held = self.generations()
        name = f"batch={batch:012d}"
        home = next((g for g in reversed(held) if name in self._names(f"{self.path}/{g}")), None)
        if home is None:
            home = held[-1] if held else f"generation={0:012d}"
            if held and self._bytes(home) > self.max_bytes:
                home = f"generation={int(home.split('=')[1]) + 1:012d}"
        tables.save(rows.coalesce(1), f"{self.path}/{home}/{name}", mode="overwrite")
        for old in self.generations()[:-GENERATIONS]:
            tables.delete(self.spark, f"{self.path}/{old}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function."""
        return lambda rows, batch: self.put(rows, batch)

    def read(self) -> DataFrame:
        """The rows of the generations that stay, as one table."""
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{g}" for g in self.generations()[-GENERATIONS:]]).drop("generation", "batch")

    def newest(self, limit: int, errors_only: bool = False) -> DataFrame:
        return fleet.ledger(self.read(), limit, errors_only)


def passes(events: DataFrame) -> DataFrame:
    """(ts, id, error) of events that end a pass: error is null for one that went well."""
    return events.select("ts", "id", F.col("error").cast("string").alias("error"))
