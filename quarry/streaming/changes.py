"""Changes of a tree as a stream: listings are compared as tables, and what differs is published as files that a stream reads in order.

A look compares the tree's listing with the one that is kept. The rows that differ are both the kept listing's next segment and its events, in
one version, so a crash keeps both or none; then the version's events get their folder by one rename. A look that was cut short between the
two is made good by the next. So every change is one event, however often writer and reader are killed: the stream's checkpoint knows the
folders that it has read, and reads them again from any place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import files as X
from quarry.sources import tables
from quarry.sources.catalog import Catalog

EVENT = "version long, path string, kind string"


def watched(listing: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """The rows of a listing (path, size, and others) that are worth an event: files of a known language outside the folders that are never indexed."""
    return listing.where(X.indexable(F.col("path"), F.col("size")) & ~X.excluded(F.col("path"), exclude or []))


class Changes:
    """The changes of one tree, kept in a folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self.catalog = Catalog(spark, f"{self.home}/listing", {"listing": {"path": "path"}})

    def look(self, listing: DataFrame) -> int | None:
        """Compare with a listing (path, size, mtime) and publish what differs: added, changed or gone. The version, or None where nothing does."""
        self.publish()
        first = not self.catalog.numbers()
        held = self.spark.createDataFrame([], listing.select("path", "size", "mtime").schema) if first else self.catalog.read()["listing"]
        old, new = (df.select("path", F.struct("size", "mtime").alias(name)) for df, name in ((held, "old"), (listing, "new")))
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        changes = tables.store(old.join(new, "path", "full_outer").select("path", kind.alias("kind"), "new.*").where("kind IS NOT NULL"))
        if changes.isEmpty():
            return None
        rows = {"listing": changes.where("kind <> 'gone'").select("path", "size", "mtime"), "changes": changes.select("path", "kind")}
        number = self.catalog.write(rows) if first else self.catalog.append(rows, {"path": changes.where("kind <> 'added'").select("path")})
        self.publish()
        self.catalog.merge(without=("changes",))
        return number

    def publish(self) -> list[int]:
        """Give every version's events their folder, oldest first; those that had none."""
        place, system = self.catalog._at(f"{self.home}/events")
        system.mkdirs(place)
        there = {s.getPath().getName() for s in system.listStatus(place)}
        out = []
        for number in sorted(self.catalog.numbers()):
            segment = self.catalog.version(number)["segments"][-1]
            if segment["number"] != number or "changes" not in segment["rows"] or f"{number:012d}" in there:
                continue
            draft = f"{self.home}/drafts/{uuid.uuid4().hex}"
            tables.save(self.catalog._rows("changes", segment).select(F.lit(number).cast("long").alias("version"), "path", "kind").coalesce(1), draft)
            system.mkdirs(self.catalog._at(f"{self.home}/events")[0])
            if system.rename(self.catalog._at(draft)[0], self.catalog._at(f"{self.home}/events/{number:012d}")[0]):
                out.append(number)
        return out

    def stream(self, versions_at_once: int | None = None) -> DataFrame:
        """The events as a stream (version, path, kind), in the order of versions."""
        reader = self.spark.readStream.schema(EVENT)
        if versions_at_once:
            reader = reader.option("maxFilesPerTrigger", versions_at_once)
        return reader.parquet(f"{self.home}/events/*")
