"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures are exact counts over whole texts. In each stratum (language) a path of steps leads from loose to strict cutoffs, each
step holding one cutoff for every rule. A quarter of the labelled good documents (GUIDE) lays the path; the others test it, in fixed
sequence: a step may be used if it and all before it show by the exact binomial bound that all rules together reject less than
``risk`` of good documents, i.e. P(Binomial(n, risk) <= rejected) <= level. As the first step that fails ends the sequence, steps need
no share of the error; the level is ``delta / strata``, so that the cutoffs of all strata hold together. Only strata that could pass
with no rejection at all count and are tested: with risk 3 % and delta 5 % that takes 99 test labels for one stratum, 144 for four.
The last step that passes is used; a stratum with too few labels gets none and loses no document to the method.

Defined cases: a null text counts as empty; a null language is a stratum of its own, and so is an empty one; labels that name no
document or have a null quality count for nothing; the lowest quality counts where a document has several; rows that repeat are
counted and judged alike, each for itself; extra columns pass through ``judge``, but for those that bear the name of a column that is
added, whose place the added one takes; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ROW, SPACES, WORD_SPLIT, packed, read_table, unpacked, written

#: Rejecting at most so large a part of good documents in any stratum, but for an error of DELTA.
RISK, DELTA = 0.03, 0.05
CUTOFFS = 24
#: One of so many labelled good documents lays the path and tests nothing.
GUIDE = 4
#: Each rule rejects values over its cutoff; the grid is lo * (hi / lo) ** (i / (CUTOFFS - 1)). These are shares of words or lines.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
RULES = {"symbol_rate": (0.02, 2.0), "dup_line_rate": (0.02, 0.95), "repeat_rate": (0.05, 0.5), "word_chars_mean": (8.0, 40.0)}


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def measures(docs: DataFrame) -> DataFrame:
    """docs (text and others; working names are this module's own) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, in one pass over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    w = F.col("_words")
    # windows as (hash, position), sorted: those equal to a neighbour are found twice or more
    windows = F.when(F.size(w) < 3, F.expr("array()").cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    )
    s = F.col("_windows")
    again = F.filter(s, lambda x, k: F.get(s, k - F.lit(1))["h"].eqNullSafe(x["h"]) | F.get(s, k + F.lit(1))["h"].eqNullSafe(x["h"]))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return (
        docs.withColumn("_words", words(text))
        .withColumn("_windows", windows)
        .withColumn("_lines", lines)
        .select(
            *[c for c in docs.columns if c not in MEASURES],
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("_n_lines"),
            repeated.cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def rule_values() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        (F.col("n_symbols") / n).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")).alias("dup_line_rate"),
        (F.col("n_repeat_words") / n).alias("repeat_rate"),
        (F.col("word_chars") / n).alias("word_chars_mean"),
    ]


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Binomial(n, p) <= x), exactly summed in logarithms; 1 for x = n."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("term"), F.exp(first).cast("double").alias("sum"))

    def step(at, i):
        term = at["term"] + F.log((n - i + 1) / i.cast("double") * odds)
        return F.struct(term.alias("term"), (at["sum"] + F.exp(term)).alias("sum"))

    steps = F.filter(F.sequence(F.lit(0).cast("long"), x.cast("long")), lambda i: i > 0)
    return F.when(x >= n, F.lit(1.0)).otherwise(F.least(F.aggregate(steps, start, step, lambda at: at["sum"]), F.lit(1.0)))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, cutoffs: int = CUTOFFS) -> DataFrame:
    """stratum, rule, cutoff: the strictest step whose false rejections are bounded, a row for each rule; no row where none is proven.

    Labelled good documents that the base rules already reject are no evidence for the cutoffs and are left out.
    """
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg(F.min("quality").alias("_quality"))
        .where("_quality > 0")
        .select("_label_id")
    )
    held = (
        measured.where(~F.col("base_failed"))
        .select("doc_id", _told(stratum).alias("stratum"), *rule_values())
        .join(good, F.col("doc_id") == F.col("_label_id"), "left_semi")
        .withColumn("guide", F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(GUIDE)) == 0)
    )
    # rejected by the guide at cutoff i = values over it; one array of counts for each stratum and rule, whatever the number of labels
    grids = {r: [lo * (hi / lo) ** (i / (cutoffs - 1)) for i in range(cutoffs)] for r, (lo, hi) in RULES.items()}
    counts = held.groupBy("stratum").agg(
        F.count_if("guide").alias("guides"),
        F.count_if(~F.col("guide")).alias("n"),
        *[F.array(*[F.count_if(F.col("guide") & (F.col(r) > F.lit(c))) for c in grid]).alias(r) for r, grid in grids.items()],
    )
    # the k-th largest stratum is tested if k could pass at once
    ranked = counts.where(F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(delta)).withColumn("_k", F.row_number().over(_whole().orderBy(F.desc("n"), "stratum")))
    could = F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(delta) / F.col("_k")
    strata = ranked.withColumn("strata", F.max(F.when(could, F.col("_k"))).over(_whole())).where("_k <= strata")
    paths = written(strata.select("stratum", "n", "strata", *[_path(r, grid, risk).alias(f"_path_{r}") for r, grid in grids.items()]))
    # the first step at which a document is rejected, by whichever rule; a step rejects those of all steps before it too
    steps = 2 * cutoffs - 1
    first = F.least(*[F.size(F.filter(F.col(f"_path_{r}"), _not_under(F.col(r)))) for r in RULES])
    test = held.where(~F.col("guide")).join(F.broadcast(paths.select("stratum", *[f"_path_{r}" for r in RULES])), "stratum").select("stratum", first.alias("step"))
    at = test.groupBy("stratum").agg(*[F.count_if(F.col("step") <= i).alias(f"_{i}") for i in range(steps)])
    tested = paths.join(at, "stratum").select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"_{i}").alias("rejected")) for i in range(steps)])).alias("t"))
    fails = binomial_tail(F.col("n"), F.col("t.rejected"), risk) > F.lit(delta) / F.col("strata")
    ends = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(fails, F.col("t.step"))), F.lit(steps)).alias("_end"))
    proven = paths.join(ends.where("_end > 0"), "stratum")
    return proven.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.get(f"_path_{r}", F.col("_end") - 1).alias("cutoff")) for r in RULES])).alias("t")).select(_untold(F.col("stratum")).alias("stratum"), "t.*")


def _told(stratum: str) -> Column:
    """A name for a stratum that is never null, and another for null than for an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))


def _untold(name: Column) -> Column:
    return F.when(name != "", F.substring(name, F.lit(2), F.length(name)))


def _path(rule: str, grid: list[float], risk: float) -> Column:
    """A rule's cutoff at each step, falling: from the loosest to the strictest one that rejects none of the guide, then to those that reject up to ``risk`` of it."""
    last = len(grid) - 1
    cutoffs = F.array(*map(F.lit, grid))
    strictest = lambda most: F.size(F.filter(F.col(rule), lambda x: x > most))  # noqa: E731  counts fall along the grid
    place = lambda i: F.when(i < last, strictest(F.lit(0)) + last - i).otherwise(strictest(F.floor(F.col("guides") * F.lit(risk / last) * (i - last))))
    return F.transform(F.sequence(F.lit(0), F.lit(2 * last)), lambda i: F.get(cutoffs, F.least(place(i), F.lit(last))))


def _not_under(value: Column):
    return lambda cutoff: value <= cutoff


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over one row for each stratum that has labels enough to pass alone


def verdicts(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with kept; chosen holds a row for each stratum and rule, so that adaptive execution, which measures it, sends it to all tasks."""
    wide = chosen.groupBy(_told("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_max_{r}") for r in RULES])
    joined = measured.join(wide, _told(stratum) == F.col("_stratum"), "left")
    values = dict(zip(RULES, rule_values()))
    over = [F.coalesce(values[r] > F.col(f"_max_{r}"), F.lit(False)) for r in RULES]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_stratum", *[f"_max_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs (doc_id, text, the stratum's column and any others) with the measures, base_failed and kept."""
    own = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col(stratum).alias("stratum"))
    measured = written(measures(own).drop("text"))
    judged = verdicts(measured, written(thresholds(measured, labels, "stratum")), "stratum")
    return unpacked(judged.select(ROW, *MEASURES), *[F.col(c) for c in MEASURES])


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = written(measures(docs).drop("text"))
    chosen = written(thresholds(measured, read_table(spark, sf_dir, "labels")))  # a few rows of known size, which are sent to all tasks
    return verdicts(measured, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """Measures by unnesting, cutoffs by counting over the labelled documents, tails by the binomial formula."""
    last = CUTOFFS - 1
    grids = {r: [lo * (hi / lo) ** (i / last) for i in range(CUTOFFS)] for r, (lo, hi) in RULES.items()}
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, {i} AS i, {c!r}::DOUBLE AS cutoff" for r, g in grids.items() for i, c in enumerate(g))
    values = " UNION ALL ".join(f"SELECT doc_id, lang, guide, '{r}' AS rule, {r} AS v FROM h" for r in RULES)
    over = " OR ".join(f"coalesce({r} > (SELECT cutoff FROM chosen c WHERE c.lang IS NOT DISTINCT FROM r.lang AND c.rule = '{r}'), false)" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (VALUES (0), (1), (2)) x(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT * EXCLUDE (lines), CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (
  SELECT *, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_rate, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_rate, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_rate, word_chars / greatest(n_words, 1)::DOUBLE AS word_chars_mean FROM b),
h AS (
  SELECT *, ('0x' || md5(CAST(doc_id AS VARCHAR))[1:8])::BIGINT % {GUIDE} = 0 AS guide FROM r
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0)),
sizes AS (SELECT lang, count(*) FILTER (WHERE guide) AS guides, count(*) FILTER (WHERE NOT guide) AS n FROM h GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, lang NULLS FIRST) AS k FROM sizes WHERE pow({1 - RISK!r}, n) <= {DELTA!r}),
strata AS (SELECT *, (SELECT max(k) FROM ranked WHERE pow({1 - RISK!r}, n) <= {DELTA!r} / k) AS strata FROM ranked),
tested AS (SELECT * FROM strata WHERE k <= strata),
grid AS ({grid}), vals AS ({values}),
over AS (SELECT s.lang, g.rule, g.i, g.cutoff, (SELECT count(*) FROM vals v WHERE v.lang IS NOT DISTINCT FROM s.lang AND v.rule = g.rule AND v.guide AND v.v > g.cutoff) AS c FROM tested s, grid g),
steps AS (SELECT i AS step FROM unnest(range({2 * CUTOFFS - 1})) u(i)),
asked AS (SELECT s.lang, o.rule, step, CASE WHEN step < {last} THEN (SELECT count(*) FROM over o2 WHERE o2.lang IS NOT DISTINCT FROM s.lang AND o2.rule = o.rule AND o2.c > 0) + {last} - step
    ELSE (SELECT count(*) FROM over o2 WHERE o2.lang IS NOT DISTINCT FROM s.lang AND o2.rule = o.rule AND o2.c > floor(s.guides * {RISK / last!r}::DOUBLE * (step - {last}))) END AS place
  FROM tested s, (SELECT DISTINCT rule FROM grid) o, steps),
path AS (SELECT a.lang, a.rule, a.step, g.cutoff FROM asked a JOIN grid g ON g.rule = a.rule AND g.i = least(a.place, {last})),
lost AS (SELECT s.lang, step, (SELECT count(*) FROM h WHERE NOT guide AND h.lang IS NOT DISTINCT FROM s.lang AND EXISTS (
    SELECT 1 FROM vals v JOIN path p ON p.rule = v.rule AND p.lang IS NOT DISTINCT FROM v.lang WHERE v.doc_id = h.doc_id AND p.step = steps.step AND v.v > p.cutoff)) AS x FROM tested s, steps),
tails AS (SELECT l.lang, step, s.strata, CASE WHEN x >= n THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK!r}) + (n - j) * ln({1 - RISK!r})))) END AS tail
  FROM lost l JOIN tested s ON s.lang IS NOT DISTINCT FROM l.lang),
ends AS (SELECT lang, coalesce(min(step) FILTER (WHERE tail > {DELTA!r} / strata), {2 * CUTOFFS - 1}) AS e FROM tails GROUP BY lang),
chosen AS (SELECT p.lang, p.rule, p.cutoff FROM path p JOIN ends ON ends.lang IS NOT DISTINCT FROM p.lang WHERE p.step = e - 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM r
"""


ORACLE = _oracle()
