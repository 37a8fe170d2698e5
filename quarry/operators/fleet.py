"""Many projects: who claims whom, what may be forgotten, which settings hold, and how ready each one is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BACKUPS = 20


def sweep(reachable: DataFrame, held: DataFrame) -> DataFrame:
    """(root, member, change): members to claim, which a root reaches and does not hold, and to release, which it holds and does not reach."""
    claim = reachable.select("root", "member").subtract(held.select("root", "member")).withColumn("change", F.lit("claim"))
    return claim.unionByName(held.select("root", "member").subtract(reachable.select("root", "member")).withColumn("change", F.lit("release")))


def members(declared: DataFrame, found: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(root, member): declared and discovered members, without a root itself and without forbidden places."""
    both = declared.select("root", "member").union(found.select("root", "member")).distinct().where("root <> member")
    return both.join(forbidden.select(F.col("path").alias("member")), "member", "left_anti").select("root", "member")


def unclaimed(stores: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Stores that no registry row claims."""
    return stores.join(registry.select(key).distinct(), key, "left_anti")


def verdicts(projects: DataFrame) -> DataFrame:
    """projects (path, exists, parent_exists, same_device) with verdict: a path that is gone counts as deleted only where its parent stands on the device it stood on."""
    verdict = F.when(F.col("exists"), "live").when(F.col("parent_exists") & F.col("same_device"), "deleted").when(F.col("parent_exists"), "unmounted").otherwise("unknown")
    return projects.withColumn("verdict", verdict)


def survey(judged: DataFrame, show: int = 5) -> DataFrame:
    """(verdict, projects, first): how many projects have each verdict, and the first few of them in order. Only the first few travel."""
    order = Window.partitionBy("verdict").orderBy("path")
    few = judged.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= show).groupBy("verdict").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first"))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("projects")).join(few, "verdict")


def prune_refused(judged: DataFrame) -> DataFrame:
    """One row, refused: nothing is pruned from an empty registry, nor where more than half of it would go."""
    return judged.agg((F.count(F.lit(1)) == 0) | (F.count_if(F.col("verdict") == "deleted") * 2 > F.count(F.lit(1)))).toDF("refused")


def retained(backups: DataFrame, of: str, newest: str, keep: int = BACKUPS) -> DataFrame:
    """The newest backups of each thing."""
    order = Window.partitionBy(of).orderBy(F.desc(newest))
    return backups.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= keep).drop("_row")


def ledger(rows: DataFrame, limit: int, errors_only: bool = False) -> DataFrame:
    """The newest rows (ts, id, error), the later of two at one time first."""
    return (rows.where("error IS NOT NULL") if errors_only else rows).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def inherited(projects: DataFrame, settings: DataFrame) -> DataFrame:
    """(path, key, value): a project's settings: its own, else those of the first root (by position in roots) that sets the key."""
    chain = projects.select("path", F.posexplode(F.concat(F.array("path"), F.coalesce("roots", F.array().cast("array<string>")))).alias("pos", "of"))
    return chain.join(settings.select(F.col("path").alias("of"), "key", "value"), "of").groupBy("path", "key").agg(F.min_by("value", "pos").alias("value"))


def readiness(seen: DataFrame) -> DataFrame:
    """(family, tool, tier) of what was seen of each tool (has_index, has_build, has_tool): 0 an index is there, 1 it can be built, 2 the tool alone is there, 3 nothing."""
    has = seen.groupBy("family", "tool").agg(*[F.max(c).alias(c) for c in ("has_tool", "has_build", "has_index")])
    tier = F.when(~F.col("has_tool"), 3).when(~F.col("has_build"), 2).when(~F.col("has_index"), 1).otherwise(0)
    return has.select("family", "tool", tier.alias("tier"))


def best_tier(readiness: DataFrame) -> DataFrame:
    """(family, tier): the best readiness of a family's tools; 0 is ready."""
    return readiness.groupBy("family").agg(F.min("tier").alias("tier"))


def nearest_key(unknown: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, meant): the known settings name most like each unknown one, by the share of its letters that stay; null where none is like it enough.

    Names meet by pairs of letters, with an edge at either end: of the n + 1 pairs of a name of n letters one edit takes two at most, so names
    that keep a share over a half of their letters keep one pair at least.
    """
    if least <= 0.5:
        raise ValueError("names that keep half of their letters or fewer need share no pair of them")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("\x02"), c, F.lit("\x03")), i, F.lit(2))))
    asked, there = unknown.select("key").distinct(), known.select(F.col("key").alias("k")).distinct()
    met = asked.select("key", F.explode(grams(F.col("key"))).alias("gram")).join(there.select("k", F.explode(grams(F.col("k"))).alias("gram")), "gram").select("key", "k").distinct()
    like = 1 - F.levenshtein("key", "k") / F.greatest(F.length("key"), F.length("k"), F.lit(1))
    best = met.withColumn("like", like).where(F.col("like") >= least).groupBy("key").agg(F.min(F.struct((-F.col("like")).alias("d"), "k")).alias("b"))
    return asked.join(best, "key", "left").select("key", F.col("b.k").alias("meant"))
