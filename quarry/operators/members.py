"""Members of a workspace: the projects that links below a root lead to, and the ones that it names, as tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import files as X

#: Folders of a link's own path below its root, with itself, at most.
DEPTH = 4


def ancestors(path: str) -> Column:
    """A path and every folder above it, each once; an absolute path starts at its first folder."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")


def inside(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root) wherever a root holds a path or is it: each path is met by its own ancestors, so no path meets every root."""
    return paths.select("path", F.explode(ancestors("path")).alias("root")).join(roots.select("root").distinct(), "root").select("path", "root").distinct()


def discovered(links: DataFrame, roots: DataFrame, projects: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(root, member, link): projects (path) that links (link, target, both resolved) below a root lead to.

    A link counts down to DEPTH folders below its root, outside folders that are never read. A target that is the root or lies in it is none,
    nor is one where a pattern matches the link or the target. Links that lie below another link of the root are not met on the way: their
    resolved paths are elsewhere.
    """
    own = inside(links.select(F.col("link").alias("path")), roots).select(F.col("path").alias("link"), "root").join(links.select("link", "target").distinct(), "link")
    own = own.where(F.col("link") != F.col("root")).withColumn("below", F.expr("substring(link, length(root) + 2)"))
    near = (F.size(F.split("below", "/")) <= DEPTH) & ~X.skipped(F.concat(F.col("below"), F.lit("/x")))
    apart = (F.col("target") != F.col("root")) & ~F.col("target").startswith(F.concat(F.col("root"), F.lit("/")))
    wanted = ~(X.excluded(F.col("below"), exclude or []) | X.excluded(F.col("target"), exclude or []))
    found = own.where(near & apart & wanted)
    return found.join(projects.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("root", F.col("target").alias("member"), "link").distinct()


def reach(roots: DataFrame, declared: DataFrame, links: DataFrame) -> DataFrame:
    """(root, place, path, links): the paths that a question to a root may reach, the root itself first (place 0), then its members by path; links: how many lead there.

    Declared members (root, member) count as they are named, but for the root itself and places that are no project; however many links and
    names lead to a member, it is one.
    """
    named = declared.where((F.col("root") != F.col("member")) & ~X.forbidden(F.col("member"))).select("root", "member", F.lit(None).cast("string").alias("link"))
    both = named.unionByName(links.select("root", "member", "link")).groupBy("root", "member").agg(F.count_distinct("link").alias("links"))
    placed = both.select("root", F.col("member").alias("path"), "links", F.lit(1).alias("after")).unionByName(roots.select("root", F.col("root").alias("path"), F.lit(0).cast("long").alias("links"), F.lit(0).alias("after")).distinct())
    place = F.row_number().over(Window.partitionBy("root").orderBy("after", "path")) - 1
    return placed.withColumn("place", place).select("root", "place", "path", "links")


def within(asked: DataFrame, reached: DataFrame) -> DataFrame:
    """asked (root, path) with within: whether the root or one of its members holds the path."""
    held = inside(asked, reached.select(F.col("path").alias("root"))).select("path", F.col("root").alias("holder"))
    met = asked.join(held, "path").join(reached.select("root", F.col("path").alias("holder")), ["root", "holder"]).select("root", "path").distinct().withColumn("within", F.lit(True))
    return asked.join(met, ["root", "path"], "left").withColumn("within", F.coalesce("within", F.lit(False)))


def gaps(reached: DataFrame, indexed: DataFrame, show: int = 5) -> DataFrame:
    """(root, unindexed, first): members of which no index is kept (path), and the first few of them by path."""
    missing = reached.where("place > 0").join(indexed.select("path").distinct(), "path", "left_anti")
    few = missing.withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("path"))).where(F.col("i") <= show).groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first"))
    return missing.groupBy("root").agg(F.count(F.lit(1)).alias("unindexed")).join(few, "root")
