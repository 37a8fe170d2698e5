"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line equals it or, from MIN_NEAR code points on, lies within one edit of it (one code point inserted,
deleted or replaced). Earlier means: smaller doc_id, then text hash, then line number; null doc_id last.

Equal lines meet by a 128-bit hash. For near ones, a line is cut into windows; two lines within one edit agree on all that is left
and all that is right of one window, where the windows are laid over the shorter one. Keys of these two sides are counted first,
and only lines that share one with another text (a necessary condition, so nothing is lost) emit their deletion variants: every
way to delete one code point of the window, as hashed keys. Lines of one length that share a variant at one place differ by a
replacement there; a variant of the longer that equals the shorter is an insertion. Each key group is reduced to its earliest line
before it is joined, so a group of g lines makes g rows and never g * g; what matched is verified by edit distance.

Defined cases: a null text has no line; lines of white space alone are never dropped; lines are what ``\\n`` separates; rows that
repeat both doc_id and text are one document and keep the same lines; a document whose every non-blank line is dropped is empty
after it, and ``dedup`` lets it go; documents that had none stay; extra columns pass through, whatever they are called; n_chars, where
there is such a column, is the new length of a text that lost lines and stays as it was elsewhere; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ROW, packed, read_table, unpacked, written
from quarry.sources.tables import Scratch

MIN_NEAR = 20
#: Code points of a window, at most, for lines of two windows and more.
WINDOW = 512


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def windows(m: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(m / F.lit(WINDOW)).cast("int"))


def bound(m: Column, w: Column, j: Column) -> Column:
    """Where window j begins."""
    return F.floor(j * m / w).cast("int")


def sides(line: Column, n: Column, m: Column, j: Column) -> tuple[Column, Column]:
    w = windows(m)
    right = m - bound(m, w, j + 1)
    return F.substring(line, F.lit(1), bound(m, w, j)), F.substring(line, n - right + 1, right)


def side_keys(line: Column, n: Column, m: Column) -> Column:
    """A key for each window, of what is left and right of it, for pairs whose shorter line has m code points."""

    def key(j):
        left, right = sides(line, n, m, j)
        return F.xxhash64(m, j, left, right)

    # nearly all lines have two windows: their keys are written out, so that no lambda is interpreted for them
    half = F.floor(m / F.lit(2)).cast("int")
    right, none = F.substring(line, n - (m - half) + 1, m - half), F.lit("")
    two = F.array(F.xxhash64(m, F.lit(0), none, right), F.xxhash64(m, F.lit(1), F.substring(line, F.lit(1), half), none))
    return F.when(m <= 2 * WINDOW, two).otherwise(F.transform(F.sequence(F.lit(0), windows(m) - 1), key))


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: its place, 128-bit hash, length and side keys."""
    text = F.col("text").cast("string")
    # the hash stands below the explode: beside it, it would be computed from the whole text for every line
    own = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    line, n = F.col("line"), F.col("n")
    none = F.array().cast("array<bigint>")
    return (
        own.select("doc_id", "h", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
        .where(~blank(line))
        .withColumn("n", F.length(line))  # a column of its own, so that it is counted once and not in every key
        .select(
            place(F.col("doc_id"), F.col("h"), F.col("line_no")).alias("at"),
            F.xxhash64(line).alias("h1"),
            F.xxhash64(F.lit(1), line).alias("h2"),
            "n",
            F.when(n >= MIN_NEAR, side_keys(line, n, n)).otherwise(none).alias("same"),
            F.when(n > MIN_NEAR, side_keys(line, n, n - 1)).otherwise(none).alias("longer"),
        )
    )


def place(doc_id: Column, h: Column, line_no: Column) -> Column:
    return F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), h.alias("h"), line_no.alias("line_no"))


def suspects(lines: DataFrame) -> DataFrame:
    """The distinct lines and windows whose side key another text shares: (at, h1, h2, n, m, j). Keys travel with a line's number alone."""
    keys = F.concat(
        F.transform("same", lambda k, j: F.struct(k.alias("key"), F.lit(0).alias("less"), j.alias("j"))),
        F.transform("longer", lambda k, j: F.struct(k.alias("key"), F.lit(1).alias("less"), j.alias("j"))),
    )
    keyed = lines.where(F.col("n") >= MIN_NEAR).select("lid", F.explode(keys).alias("k")).select("lid", "k.*")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    found = written(keyed.join(shared, "key", "left_semi").drop("key"))
    return lines.select("lid", "at", "h1", "h2", "n").join(found, "lid").select("at", "h1", "h2", "n", (F.col("n") - F.col("less")).alias("m"), "j")


def window_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with pid, the window's text (part) and hashes of what is left and right of it; each text is read at the line's first place only."""
    asked = found.groupBy(F.col("at.doc_id").alias("a_doc"), F.col("at.h").alias("a_h")).agg(
        F.collect_list(F.struct("h1", "h2", "at", "n", "m", "j")).alias("asked")
    )
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    picked = lambda x: F.transform(x["asked"], lambda a: F.struct(a.alias("a"), F.get(x["lines"], a["at"]["line_no"]).alias("line")))
    joined = (
        texts.join(asked, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("h") == F.col("a_h")))
        .select(F.explode(once(F.struct(lines_of(F.col("text")).alias("lines"), F.col("asked").alias("asked")), picked)).alias("z"))
        .select("z.a.*", "z.line")
    )
    line, n, m, j = (F.col(c) for c in ("line", "n", "m", "j"))
    left, right = sides(line, n, m, j)
    w = windows(m)
    first, last = bound(m, w, j), n - (m - bound(m, w, j + 1))
    return joined.select(
        "h1", "h2", "at", "n", "m", "j",
        F.xxhash64(left, right).alias("s1"), F.xxhash64(F.lit(1), left, right).alias("s2"),
        F.substring(line, first + 1, last - first).alias("part"),
    ).dropDuplicates(["h1", "h2", "m", "j"]).withColumn("pid", F.monotonically_increasing_id())


#: What a variant key stands for: a window less one code point at a place, in the shorter length; a whole window; one of the longer length less one.
REPLACED, WHOLE, LESS = 0, 1, 2


def variants(parts: DataFrame) -> DataFrame:
    """(pid, key, role): the deletion neighbourhood of every window, as hashed keys."""
    part, size = F.col("part"), F.length("part")
    without = lambda i: F.concat(F.substring(part, F.lit(1), i), F.substring(part, i + 2, F.lit(1 << 30)))
    places = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
    row = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))
    replaced = F.transform(places, lambda i: row(F.xxhash64("m", "j", "s1", "s2", i, without(i)), REPLACED))
    whole = F.array(row(F.xxhash64("m", "j", "s1", "s2", part), WHOLE))
    less = F.array_distinct(F.transform(places, lambda i: row(F.xxhash64("m", "j", "s1", "s2", without(i)), LESS)))
    return parts.select("pid", F.explode(F.when(F.col("n") == F.col("m"), F.concat(replaced, whole)).otherwise(less)).alias("v")).select("pid", "v.*")


def near(parts: DataFrame) -> DataFrame:
    """(h1, h2, first): lines within one edit of an earlier one, with the earliest such place.

    parts is a written table (pid is fixed). Keys that only one window has are left behind first; groups of the others are reduced to
    their earliest line for each role, so that each row meets one other.
    """
    keyed = written(variants(parts))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("role").alias("lo"), F.max("role").alias("hi")).where("c > 1 AND (lo = 0 OR lo < hi)").select("key")
    hits = written(keyed.join(shared, "key", "left_semi"))
    rows = hits.join(parts, "pid").select("key", "role", "at", "h1", "h2", "m", "j", "s1", "s2", "part")
    same = ["key", "m", "j", "s1", "s2"]
    earliest = rows.groupBy(*same, F.when(F.col("role") == REPLACED, REPLACED).when(F.col("role") == WHOLE, LESS).otherwise(WHOLE).alias("role")).agg(
        F.min(F.struct("at", "part")).alias("e")
    )
    found = rows.join(earliest, [*same, "role"]).where("e.at < at")
    return found.where(F.levenshtein("part", "e.part", 1) >= 0).groupBy("h1", "h2").agg(F.min("e.at").alias("first"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, dropped): for each document that loses lines, their numbers in order; h is the text's hash."""
    with Scratch() as scratch:
        occ = scratch.keep(occurrences(docs))
        lines = occ.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min("same").alias("same"), F.min("longer").alias("longer"))
        lines = scratch.keep(lines.withColumn("lid", F.monotonically_increasing_id()))
        parts = scratch.keep(window_texts(docs, suspects(lines)))
        close = near(parts).select("h1", "h2", F.lit(True).alias("near"))
        # a table of its own, so that the next join deals both sides alike and the rows of a very common line can be split
        marked = scratch.keep(lines.select("h1", "h2", F.col("at").alias("first"), "c").join(close, ["h1", "h2"], "left").where("c > 1 OR near"))
        return written(
            occ.select("at", "h1", "h2")
            .join(marked, ["h1", "h2"])
            .where("near OR first < at")
            .groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.h").alias("h"))
            .agg(F.array_sort(F.collect_set("at.line_no")).alias("dropped"))
        )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often the result looks into it: a lambda's variable is never spelled out again."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, dropped: Column) -> Column:
    """The text less its lines of these numbers; takes as long as the text and the numbers are, not their product."""

    def left(x: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["dropped"])
        return F.array_join(F.transform(numbers, lambda i: F.get(x["lines"], i)), "\n")

    return once(F.struct(lines_of(text).alias("lines"), dropped.alias("dropped")), left)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of text; a document that loses every non-blank line goes."""
    gone = dropped_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "dropped")
    own = packed(docs, F.col("doc_id").cast("long").alias("d_id"), F.xxhash64(F.col("text").cast("string")).alias("d_h"))
    joined = own.join(gone, F.col("d_id").eqNullSafe(F.col("g_id")) & (F.col("d_h") == F.col("g_h")), "left")
    old = F.col(ROW)["text"]
    left = joined.withColumn("left", F.when(F.col("dropped").isNull(), old).otherwise(without(old, F.col("dropped")))).where(F.col("dropped").isNull() | ~blank(F.col("left")))
    new = [F.col("left").alias("text")]
    if "n_chars" in docs.columns:
        was = F.col(ROW)["n_chars"]
        new.append(F.when(F.col("dropped").isNull(), was).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return unpacked(left, *new)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs).select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "dropped")
    counted = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    return counted.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)


#: Halves of lines as join keys, then a comparison code point by code point. doc_id is unique in these tables.
ORACLE = r"""
WITH e AS (
  SELECT doc_id, i AS line_no, lines[i + 1] AS ln, doc_id * 10000000 + i AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(len(lines))) t(i)),
nb AS (SELECT * FROM e WHERE regexp_replace(ln, '[\x20\x09-\x0D]', '', 'g') <> ''),
d AS (SELECT ln, length(ln) AS n, min(pos) AS pos FROM nb GROUP BY ln),
k AS (
  SELECT ln, n, pos, m, s, CASE WHEN s = 0 THEN ln[1:m // 2] ELSE ln[n - (m - m // 2) + 1:n] END AS h
  FROM d, (VALUES (0), (1)) x(dm), (VALUES (0), (1)) y(s), LATERAL (SELECT n - dm AS m) z WHERE n - dm >= 20),
c AS (SELECT DISTINCT a.ln AS x, b.ln AS y, a.n AS nx, b.n AS ny FROM k a JOIN k b USING (m, s, h) WHERE b.pos < a.pos AND (a.n = m OR b.n = m)),
p AS (
  SELECT DISTINCT x FROM c
  WHERE (nx = ny AND list_sum(list_transform(range(1, nx + 1), lambda i: CAST(x[i] <> y[i] AS INTEGER))) <= 1)
     OR (nx = ny + 1 AND len(list_filter(range(0, nx), lambda i: x[1:i] || x[i + 2:nx] = y)) > 0)
     OR (ny = nx + 1 AND len(list_filter(range(0, ny), lambda i: y[1:i] || y[i + 2:ny] = x)) > 0)),
g AS (
  SELECT nb.doc_id, nb.line_no FROM nb JOIN d USING (ln) LEFT JOIN p ON p.x = nb.ln
  WHERE nb.pos > d.pos OR p.x IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_dropped, coalesce(r.dropped, '') AS dropped
FROM documents LEFT JOIN r USING (doc_id)
"""
