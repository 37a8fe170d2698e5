"""A corpus in five stages: each takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and read again.

A null or empty text passes the classifier at the weight of nothing known, has no line to lose, is no duplicate, is mixed in once and
encodes to no id. Very long texts are read in pieces. Rows that repeat are one document to line dedup and one of them stays in near-dedup;
ties go to the smaller doc_id, null last. Columns beside those of documents pass through all stages but the last, which returns doc_id,
lang, source and the ids. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, line_dedup, mixing, near_dedup, quality_resample
from quarry.llm.common import Written, read_table
from quarry.sources.tables import noted


class Stage:
    """A stage that lets go of what the one before it had stored on its way, once its own rows are read from elsewhere: written, as they should be, and read again."""

    def __init__(self, function: Callable[[SparkSession, DataFrame, str], DataFrame], before: Stage | None = None):
        self.function, self.before, self.made = function, before, []

    def __call__(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if self.before and self.before.made:
            read = docs.inputFiles()
            if not any(table.path.split(":", 1)[-1] in file for file in read for table in self.before.made):
                self.before.drop()
        with noted() as made:
            out = self.function(spark, docs, sf_dir)
        self.made += made
        return out

    def drop(self) -> None:
        for table in self.made:
            table.drop()
        self.made = []


def chained(*named: tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]) -> list[tuple[str, Stage]]:
    out: list[tuple[str, Stage]] = []
    for name, function in named:
        out.append((name, Stage(function, out[-1][1] if out else None)))
    return out


STAGES = chained(
    ("quality classifier", quality_resample.stage),
    ("line dedup", line_dedup.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("mixing sources to target weights", mixing.stage),
    ("BPE encoding and decoding", bpe.stage),
)

#: Models, sketches and byte-pair encoding are not expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is written, and the one before it dropped once the next one is there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = Written(stage(spark, docs, sf_dir))
        stage.drop()
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
