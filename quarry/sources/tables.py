"""Stored tables: written once to the folder that driver and executors share, and read from there by every later plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a write go when it ends: what it wrote is read from then on, so nothing asks for them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, one of our own, on a single machine only: executors elsewhere could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='quarry-')}")


def save(df: DataFrame, path: str, codec: str = "zstd", mode: str = "error") -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", codec).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm, context = spark._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


class Stored:
    """A DataFrame written once: its lineage ends there, its size is known to later joins, and a lost executor costs nothing."""

    #: Where tables are noted as they are made, if anybody asks for that.
    noted: list[Stored] | None = None

    def __init__(self, df: DataFrame | Iterator[DataFrame], codec: str = "zstd"):
        """df may come in parts: these are written one after the other, and each one's shuffle files go before the next is asked for."""
        self.path = ""
        for part in [df] if isinstance(df, DataFrame) else df:
            self.spark, df = part.sparkSession, part
            self.path = self.path or f"{shared_dir(self.spark)}/quarry/{uuid.uuid4().hex}"
            save(part, self.path, codec, "append")
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if Stored.noted is not None:
            Stored.noted.append(self)

    def drop(self) -> None:
        """Delete the table; only when nothing reads it any more."""
        delete(self.spark, self.path)


def store(df: DataFrame) -> DataFrame:
    return Stored(df).df


@contextmanager
def noted() -> Iterator[list[Stored]]:
    """All tables that are stored within, by whomever, for a caller that will drop them when it has what it wants."""
    before, Stored.noted = Stored.noted, []
    try:
        yield Stored.noted
    finally:
        Stored.noted = before


class Scratch:
    """Tables for the length of one job: all of them are deleted at the end but those that were asked to stay."""

    def __init__(self) -> None:
        self.held: list[Stored] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(Stored(df))
        return self.held[-1].df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self.held:
            table.drop()


class Given:
    """A table that somebody else keeps."""

    def __init__(self, df: DataFrame):
        self.df = df


class Tables:
    """Tables of one source, each made when it is first asked for, and made anew when the source's files are others."""

    _known: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, source: str, stamp: str = ""):
        self.spark, self.source, self.stamp = spark, source, stamp
        self.made: dict[str, Stored | Given] = {}

    @classmethod
    def of(cls, spark: SparkSession, source: str, stamp: str = "") -> Tables:
        key = (spark.sparkContext.applicationId, source)
        if key not in cls._known or cls._known[key].stamp != stamp:
            cls._known[key] = cls(spark, source, stamp)
        return cls._known[key]

    def table(self, name: str, make: Callable[[], DataFrame | Iterator[DataFrame]]) -> DataFrame:
        if name not in self.made:
            self.made[name] = Stored(make())
        return self.made[name].df


def stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below these paths: names, sizes and times; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    rows = files.agg(F.sort_array(F.collect_list(F.xxhash64("path", "length", "modificationTime"))).alias("h")).select(F.sha2(F.to_json(F.struct("h")), 256)).first()
    return rows[0]
