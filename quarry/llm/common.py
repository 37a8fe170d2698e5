"""What the operators of this package share: reading, written tables in the shared folder, text pieces, rows packed out of the way."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import Stored as Written
from quarry.sources.tables import save, shared_dir, store

__all__ = ["Written", "packed", "read_table", "row_key", "save", "segments", "shared_dir", "uniform", "unpacked", "written"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: The column that holds a caller's whole row while an operator works beside it.
ROW = "quarry_row"

written = store


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The caller's rows as one struct, with an operator's own columns beside it, so that no name of theirs can meet one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *columns)


def unpacked(df: DataFrame, *columns: Column) -> DataFrame:
    """The caller's rows again; columns given here take the place of theirs of the same name, or follow."""
    names = {c: i for i, c in enumerate(df.schema[ROW].dataType.names)}
    new = {df.select(c).columns[0]: c for c in columns}
    own = [new.pop(n) if n in new else F.col(ROW).getField(n).alias(n) for n in names]
    return df.select(*own, *new.values())


def row_key(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of all of a row's columns: rows that agree in all have one key. Types that cannot be hashed go in as JSON."""
    plain = ("string", "bigint", "int", "double", "float", "boolean", "smallint", "tinyint", "binary", "date", "timestamp", "timestamp_ntz")
    parts = []
    for f in docs.schema.fields:
        own = F.col(f"`{f.name}`")
        value = own if f.dataType.simpleString() in plain or f.dataType.simpleString().startswith("decimal") else F.to_json(F.struct(own))
        parts += [own.isNull(), value]  # a null leaves a hash as it is
    return F.xxhash64(F.lit(seed), *parts)


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on these columns and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about size characters that end before white space, so that a very long text never becomes one huge list."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            found = re.compile(r"[\x20\x09-\x0D]").search(text, end)
            end = found.start() if found else n
        yield text[at:end]
        at = end
