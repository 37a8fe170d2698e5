"""A kept index that follows its tree: events lead to the files that changed, and a pass without them finds what events have missed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import incremental
from quarry.plans import index
from quarry.streaming.jobs import CAP


def follow(root: str, path: str, exclude: list[str] | None = None, languages: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for events (path) of one tree: the index at path is renewed for these files, or for all where there are more than CAP.

    A batch that comes twice finds the files as they are and writes nothing the second time.
    """

    def run(batch: DataFrame, _: int) -> None:
        paths = batch.select("path").distinct()
        few = paths.limit(CAP + 1).collect()
        if few:
            hint = None if len(few) > CAP else incremental.safe(batch.sparkSession.createDataFrame([(r.path,) for r in few], "path string"))
            index.index(batch.sparkSession, root, exclude, languages, path=path, hint=hint)

    return run


def reconcile(spark: SparkSession, root: str, path: str, exclude: list[str] | None = None, languages: list[str] | None = None):
    """The second trigger: the index as a look at every file leaves it, whatever events were lost."""
    return index.index(spark, root, exclude, languages, path=path)
