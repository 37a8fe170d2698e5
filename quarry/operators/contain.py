"""Containment: which definition encloses a byte, and which class a definition belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Stored


def definitions(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind <> 'module'")


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent): the smallest other definition whose body holds a definition's first byte; ties go to the smaller id. No row where none does.

    Equal file first, bytes within it: an interval join whose groups are files.
    """
    own = definitions(nodes)
    outer = own.select(F.col("id").alias("parent"), F.col("file_id").alias("p_file"), F.col("start_byte").alias("p_start"), F.col("body_end").alias("p_end"))
    inside = (F.col("file_id") == F.col("p_file")) & (F.col("id") != F.col("parent")) & (F.col("p_start") <= F.col("start_byte")) & (F.col("start_byte") < F.col("p_end"))
    # the file is in the key only so that rows stay where the join has put them
    return own.join(outer, inside).groupBy("file_id", "id").agg(F.min_by("parent", F.struct(F.col("p_end") - F.col("p_start"), "parent")).alias("parent")).drop("file_id")


def enclosing(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, enclosing): the smallest definition whose body holds a reference's byte."""
    outer = definitions(nodes).select(F.col("id").alias("e_id"), F.col("file_id").alias("e_file"), F.col("start_byte").alias("e_start"), F.col("body_end").alias("e_end"))
    inside = (F.col("file_id") == F.col("e_file")) & (F.col("e_start") <= F.col("site")) & (F.col("site") < F.col("e_end"))
    return refs.select(F.col("id").alias("ref_id"), "file_id", "site").join(outer, inside).groupBy("file_id", "ref_id").agg(F.min_by("e_id", F.struct(F.col("e_end") - F.col("e_start"), "e_id")).alias("enclosing")).drop("file_id")


def climbed(own: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own (id, up and others) after as many steps as its longest chain of up needs. Pointer jumping: each step doubles how far a row has looked, so rounds grow as the logarithm of the depth; chains that run in a circle end when every definition has been looked at."""
    now = Stored(own)
    looked, n = 1, now.df.count()
    while looked < n and not now.df.where("up IS NOT NULL").isEmpty():
        last, now = now, Stored(step(now.df))
        last.drop()
        looked *= 2
    return now.df


def classes(nodes: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, class_id): the nearest class at or above each definition, however deep it is nested."""
    own = definitions(nodes).select("id", F.when(F.col("kind") == "class", F.col("id")).alias("class_id")).join(parent, "id", "left")
    own = own.select("id", "class_id", F.when(F.col("class_id").isNull(), F.col("parent")).alias("up"))

    def step(at: DataFrame) -> DataFrame:
        above = at.select(F.col("id").alias("a_id"), F.col("class_id").alias("a_class"), F.col("up").alias("a_up"))
        return at.join(above, F.col("up") == F.col("a_id"), "left").select("id", F.coalesce("class_id", "a_class").alias("class_id"), F.when(F.col("class_id").isNull() & F.col("a_class").isNull(), F.col("a_up")).alias("up"))

    return climbed(own, step).where("class_id IS NOT NULL").select("id", "class_id")


def qualified_names(nodes: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, qualified_name): a definition's name after those of all that enclose it, joined by dots."""
    own = definitions(nodes).select("id", "name").join(parent, "id", "left").select("id", F.col("name").alias("qualified_name"), F.col("parent").alias("up"))

    def step(at: DataFrame) -> DataFrame:
        above = at.select(F.col("id").alias("a_id"), F.col("qualified_name").alias("a_name"), F.col("up").alias("a_up"))
        name = F.when(F.col("a_name").isNull(), F.col("qualified_name")).otherwise(F.concat("a_name", F.lit("."), "qualified_name"))
        return at.join(above, F.col("up") == F.col("a_id"), "left").select("id", name.alias("qualified_name"), F.col("a_up").alias("up"))

    return climbed(own, step).select("id", "qualified_name")


def structural_edges(nodes: DataFrame, parent: DataFrame) -> DataFrame:
    """(src, dst, kind): CONTAINS from a definition's parent, DEFINES from the file's module where it has none."""
    return definitions(nodes).join(parent, "id", "left").select(
        F.coalesce("parent", "file_id").alias("src"), F.col("id").alias("dst"), F.when(F.col("parent").isNull(), "DEFINES").otherwise("CONTAINS").alias("kind")
    )
