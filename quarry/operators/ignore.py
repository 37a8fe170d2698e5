"""Ignore files: which paths the patterns of all folders above them leave out, for all paths of a tree at once.

A pattern is turned into a regular expression by column functions. Of the patterns that match a path the last one of the nearest folder
decides; what lies in an ignored folder is ignored whatever else matches it. Not read: bracket expressions with named classes, the
exclude file of a repository and of a user, and what is tracked although a pattern ignores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.walk import folders_of

NAME = ".gitignore"
#: Parts that the paths of one folder are dealt into: all paths meet the patterns of the root.
PARTS = 64
#: A pattern's pieces: escaped characters, bracket expressions, the three places of a double star, other stars, characters.
PIECES = r"(?s)\\.|\[[!^]?\]?[^\]]*\]|^\*\*/|/\*\*/|/\*\*$|\*+|."


def _piece(c: Column) -> Column:
    one = lambda ch: F.when(ch.rlike(r"[A-Za-z0-9_/]"), ch).when(ch.rlike(r"^\p{ASCII}$"), F.concat(F.lit("\\"), ch)).otherwise(ch)
    body = F.regexp_replace(c, r"^\[[!^]?|\\|\]$", "")
    backwards = F.exists(F.regexp_extract_all(body, F.lit("(?s).-."), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
    bracket = F.concat(F.lit("(?!/)["), F.when(c.rlike(r"^\[[!^]"), "^").otherwise(""), F.regexp_replace(body, r"([\[\]&^])", r"\\$1"), F.lit("]"))
    return (
        F.when(c.rlike(r"(?s)^\\."), one(F.substring(c, 2, 1)))
        .when(c.rlike(r"^\[.+\]$"), F.when(backwards | (body == ""), F.lit("(?!)")).otherwise(bracket))
        .when(c == "**/", F.lit("(?:.*/)?"))
        .when(c == "/**/", F.lit("/(?:.*/)?"))
        .when(c == "/**", F.lit("/.+"))
        .when(c.startswith("*"), F.lit("[^/]*"))
        .when(c == "?", F.lit("[^/]"))
        .otherwise(one(c))
    )


def rules(files: DataFrame) -> DataFrame:
    """(folder, rules) of ignore files (path, text): each one's patterns in order, as struct(regex, negated, folder_only). Texts may be null."""
    line = F.col("line")
    out = files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r?\n")).alias("place", "line"))
    out = out.where(~line.startswith("#")).withColumn("line", F.regexp_replace(line, r"(?<!\\) +$", ""))
    out = out.withColumn("negated", line.startswith("!")).withColumn("line", F.regexp_replace(line, "^!", ""))
    out = out.withColumn("folder_only", line.endswith("/")).withColumn("line", F.regexp_replace(line, "/$", "")).where("line <> ''")
    bound = line.contains("/")
    text = F.array_join(F.transform(F.regexp_extract_all(F.regexp_replace(line, "^/", ""), F.lit(PIECES), F.lit(0)), _piece), "")
    out = out.withColumn("regex", F.concat(F.lit("(?s)^"), F.when(bound, "").otherwise("(?:.*/)?"), text, F.lit("$")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "regex", "negated", "folder_only")))
    return out.groupBy("folder").agg(ordered.alias("rules"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path), each once, of the paths (path) that are ignored."""
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
    dealt = rules.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    folders = paths.select(F.explode(folders_of(F.col("path"))).alias("path"), F.lit(True).alias("is_folder")).where("path <> ''")
    every = folders.unionByName(paths.select("path", F.lit(False).alias("is_folder"))).distinct().withColumn("part", part)
    met = every.select("*", F.posexplode(folders_of(F.col("path"))).alias("depth", "folder")).join(dealt, ["folder", "part"])
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.col("path").substr(F.length("folder") + 2, F.length("path")))
    last = F.try_element_at(F.filter("rules", lambda r: (~r["folder_only"] | F.col("is_folder")) & F.regexp_like(below, r["regex"])), F.lit(-1))
    decided = met.withColumn("last", last).where("last IS NOT NULL").groupBy("path", "is_folder").agg(F.max(F.struct("depth", "last.negated")).alias("by"))
    out = decided.where("NOT by.negated").select(F.col("path").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    own = paths.select("path", part.alias("part"), F.explode(F.array_append(folders_of(F.col("path")), F.col("path"))).alias("at"))
    return own.join(out, ["at", "part"], "left_semi").select("path").distinct()
