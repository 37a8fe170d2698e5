"""Source trees as tables: listing, digests, admission and reading, in tasks of bounded work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import files as X
from quarry.operators import ignore
from quarry.sources import tables, walk

#: Why a file yields less than its language promises (fixed values).
REASONS = ("unreadable", "no_parser", "no_capability", "query_failed", "no_symbols")


def plainly(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) below a root on a file system that only Spark opens; its reader passes over names that start with '_' or '.'."""
    bare = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), F.lit("^" + "".join(f"[{c}]" if c not in "^\\" else f"\\{c}" for c in bare) + "/"), F.lit(""))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
    return read.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of every file below a root but those in folders that are never read; no content is read."""
    return walk.walked(spark, root) if walk.reachable(root) else plainly(spark, root).drop("content")


def unignored(root: str, files: DataFrame) -> DataFrame:
    """files (path) without those that ignore files of the tree leave out."""
    places = files.select(F.explode(walk.folders_of(F.col("path"))).alias("f")).distinct()
    written = walk.contents(root, places.select(F.when(F.col("f") == "", ignore.NAME).otherwise(F.concat("f", F.lit(f"/{ignore.NAME}"))).alias("path")))
    rules = tables.store(ignore.rules(written.select("path", F.col("content").cast("string").alias("text"))))
    return files if rules.isEmpty() else files.join(ignore.ignored(files.select("path"), rules), "path", "left_anti")


def snapshot(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, sha256, lang, content) of every admitted file below a root, or of those among some paths (a few, given by the caller).

    Files too large or of an unknown language, and in a repository those that its ignore files leave out, are never opened; generated
    ones are left out after.
    """
    reachable = walk.reachable(root)
    if only is not None:
        asked = spark.createDataFrame([(p,) for p in only], "path string")
        own = walk.contents(root, asked) if reachable else plainly(spark, root).join(asked, "path", "left_semi")
    else:
        own = walk.walked(spark, root) if reachable else plainly(spark, root)
    own = own.withColumn("lang", X.language(F.col("path"))).where(X.indexable(F.col("path"), F.col("size")) & ~X.excluded(F.col("path"), exclude or []))
    if languages:
        own = own.where(F.col("lang").isin(*languages))
    if reachable and walk.there(root, ".git"):
        own = unignored(root, own)
    if reachable and only is None:
        own = walk.contents(root, own).where("content IS NOT NULL").withColumn("lang", X.language(F.col("path")))
    return own.where(~X.generated(F.col("content"))).select("path", "size", "mtime", F.sha2("content", 256).alias("sha256"), "lang", "content")


def digested(files: DataFrame) -> DataFrame:
    """files (content and others) with sha256 and size: what decides whether a file has changed."""
    return files.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("long")})


def texts(files: DataFrame) -> DataFrame:
    """files with text, null where the bytes are no UTF-8, and the reason for that."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.withColumn("text", F.when(valid, text)).withColumn("reason", F.when(valid, "").otherwise("unreadable"))


def scripts(pages: DataFrame, text: str) -> DataFrame:
    """pages with pos, attributes, script and first_line: each script block of a single-file component or page, and the line it starts on."""
    block = r"(?is)<script\b([^>]*)>(.*?)</script>"
    whole = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<script\b[^>]*>.*?</script>"), F.lit(0))
    cut = pages.select("*", F.posexplode(whole).alias("pos", "_block"), F.split(F.col(text), r"(?is)<script\b[^>]*>").alias("_before"))
    # what stands before the block's own text: all earlier pieces and tags
    before = F.array_join(F.slice("_before", F.lit(1), F.col("pos") + 1), "")
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    tags = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<script\b[^>]*>"), F.lit(0)), F.lit(1), F.col("pos") + 1), "")
    return cut.select(
        *pages.columns, "pos", F.regexp_extract("_block", block, 1).alias("attributes"), F.regexp_extract("_block", block, 2).alias("script"), (lines(before) + lines(tags) + 1).alias("first_line")
    )
