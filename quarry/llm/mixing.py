"""Mixing sources to target weights by entropy balancing.

Among all document rates from 0 to MOST, those are taken that stray least from rate 1 (entropy weighted by tokens) and meet the token
constraints: every source's tokens are its target, and every length band (powers of four, in words) keeps its share of all tokens, so
that a source that is taken more often does not bring its own lengths into the mix. The solution is an exponential tilt with two parts,
rate = min(MOST, exp(a[source] + b[band])). Sources hold exactly. Bands are soft, as they may contradict the sources: a band may miss
its share by SLACK times its tilt.

The tilts solve a convex dual by Newton's method. For given band tilts each source's own tilt is a root of one increasing function,
found in the source's row; gradient and Hessian by bands are sums over all sources, gathered by one aggregation over the table of
sources for each step. Documents of one source and band share a rate, so that table (tokens by source and band) is all that the
steps have to read. The driver holds one number a band, never a source.

Rates become whole copies in blocks of a source's documents, walked from the longest to the shortest, each passing on what its rounding
owes. Documents too long for their block to make up for come first, in blocks of their own; the source's other rates are scaled by what
these leave over. Large sources have many blocks, so no source lands in one task.

Defined cases: a null source is a source (last in order); a null or blank text has size 0, rate 1 and one copy, and takes no word;
a source without words has target 0; rows that agree in every column are one group whose copies are dealt out evenly, whatever its
size; ties in a block go by a hash; extra columns pass through. With no words at all every target is 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import ROW, SPACES, WORD_SPLIT, packed, read_table, row_key, unpacked, written

#: No document is taken more often, and no source's target is more times its size.
MOST = 3
#: Length bands: 1 to 3 words, 4 to 15, and so on; the last has no end.
BANDS = 8
SLACK = 0.02
#: Groups of a block, about; a document is long for its block if it holds more than 1 / LONG of the block's tokens.
BLOCK_ROWS, LONG = 2_000, 16
#: Rows that one row is spread into at once.
CHUNK = 1_000
#: A table of sources of at most so many rows (about 150 bytes each) is sent to all tasks; a larger one is joined.
FEW_SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of words: pieces between white space, without the empty ones at either end."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    blank = lambda c: c.isin(*SPACES)
    outer = F.when((t == "") | blank(F.substring(t, 1, 1)), 1).otherwise(0) + F.when((t != "") & blank(F.substring(t, -1, 1)), 1).otherwise(0)
    return (F.size(F.split(t, WORD_SPLIT)) - outer).cast("long")


def band(size: Column) -> Column:
    out = F.lit(0)
    for i in range(1, BANDS):
        out = out + (size >= 4**i).cast("int")
    return out


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with source_no, 0, 1, 2, ... in this order, which no two rows share: counted by ranges, so no task sees more than its range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("row", row).join(F.broadcast(starts), "part").withColumn("source_no", F.col("start") + F.col("row") - 1).drop("part", "row", "start")


def shares(sources: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """sources (source_no, source_size) with target: by weight, adding up to all sizes, none above most times its size; the excess is shared again by weight.

    A round fixes all sources that are over at the present share; rounds end when none is. Each takes one aggregation.
    """
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod("source_no", F.lit(len(weights))).cast("int"))
    rows = sources.withColumn("weight", weight)
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, by, fixed = float(total), None, -1
    while True:
        over = F.lit(False) if by is None else F.lit(left) * F.col("weight") / F.lit(by) > most * F.col("source_size")
        r = rows.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("by")).first()
        if r.n == fixed or not r.by:
            target = most * F.col("source_size") if by is None else F.when(over, most * F.col("source_size")).otherwise(F.lit(left) * F.col("weight") / F.lit(by))
            return rows.withColumn("target", target.cast("double")).drop("weight")
        left, by, fixed = float(total - r.taken), float(r.by), r.n


def own_tilt(tilts: list[float], most: int = MOST) -> Column:
    """The tilt of a source (columns target, source_size, band_0 ...) that meets its target under these band tilts, by bisection in its row."""
    start = F.struct((F.log(F.col("target") / F.col("source_size")) - max(tilts)).alias("lo"), F.lit(math.log(most) - min(tilts)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        value = F.lit(0.0)
        for i, b in enumerate(tilts):
            value = value + F.col(f"band_{i}") * F.least(F.lit(float(most)), F.exp(mid + b))
        low = value < F.col("target")
        return F.struct(F.when(low, mid).otherwise(at["lo"]).alias("lo"), F.when(low, at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(42)), start, halve, lambda at: (at["lo"] + at["hi"]) / 2)


def state(sources: DataFrame) -> Column:
    """What a source is to the solver: nothing to take, taken in full, or free to tilt."""
    return F.when((F.col("source_size") <= 0) | (F.col("target") <= 0), "none").when(F.col("target") >= MOST * F.col("source_size"), "full").otherwise("free")


def rate(a: Column, b: Column) -> Column:
    return F.when(F.col("state") == "none", 0.0).when(F.col("state") == "full", float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.exp(a + b)))


def gathered(sources: DataFrame, tilts: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Dual value (without the bands' own terms), tokens by band and their curvature, summed over all sources."""
    at = sources.withColumn("a", F.when(F.col("state") == "free", own_tilt(tilts)))
    value, tokens, bends = F.lit(0.0), [], []
    for i, b in enumerate(tilts):
        size, r, tilt = F.col(f"band_{i}").cast("double"), rate(F.col("a"), F.lit(b)), F.col("a") + b
        value = value + size * F.when(F.col("state") == "free", F.when(tilt <= math.log(MOST), F.exp(tilt)).otherwise(MOST * (1 + tilt - math.log(MOST)))).when(F.col("state") == "full", F.lit(MOST * b)).otherwise(0.0)
        tokens.append(size * r)
        bends.append(F.when((F.col("state") == "free") & (r < MOST), size * r).otherwise(0.0))
    at = at.select(
        (value - F.when(F.col("state") == "free", F.col("target") * F.col("a")).otherwise(0.0)).alias("value"),
        *[t.alias(f"t{i}") for i, t in enumerate(tokens)], *[w.alias(f"w{i}") for i, w in enumerate(bends)], sum(bends[1:], bends[0]).alias("w"),
    )
    pairs = [(i, j) for i in range(BANDS) for j in range(i, BANDS)]
    cross = [F.sum(F.when(F.col("w") > 0, F.col(f"w{i}") * F.col(f"w{j}") / F.col("w")).otherwise(0.0)) for i, j in pairs]
    r = at.agg(F.sum("value"), *[F.sum(f"t{i}") for i in range(BANDS)], *[F.sum(f"w{i}") for i in range(BANDS)], *cross).first()
    r = [float(x or 0.0) for x in r]
    hessian = np.diag(r[1 + BANDS : 1 + 2 * BANDS])
    for (i, j), x in zip(pairs, r[1 + 2 * BANDS :]):
        hessian[i, j] -= x
        if i != j:
            hessian[j, i] -= x
    return r[0], np.array(r[1 : 1 + BANDS]), hessian


def balance(sources: DataFrame, slack: float = SLACK, steps: int = 40) -> list[float]:
    """The band tilts that solve the dual over all sources (a written table); a Newton step is halved while it does not lower the dual."""
    sums = sources.agg(*[F.coalesce(F.sum(f"band_{i}"), F.lit(0)) for i in range(BANDS)], F.coalesce(F.sum("target"), F.lit(0.0))).first()
    sizes, total = np.array(sums[:BANDS], float), float(sums[BANDS])
    if not total:
        return [0.0] * BANDS
    want = sizes / sizes.sum() * total

    def dual(b: np.ndarray):
        value, tokens, hessian = gathered(sources, b.tolist())
        gradient = tokens - want + slack * want * b
        return value - want @ b + 0.5 * slack * (want @ (b * b)), gradient, hessian + np.diag(np.where(want > 0, slack * want, 1.0))

    b = np.zeros(BANDS)
    value, gradient, hessian = dual(b)
    for _ in range(steps):
        if np.abs(gradient).max() <= 1e-9 * total:
            break
        step, share = -np.linalg.solve(hessian, gradient), 1.0
        while share > 1e-4:
            there = dual(b + share * step)
            if there[0] <= value + 1e-4 * share * (gradient @ step) + 1e-12 * abs(value):
                break
            share /= 2
        else:
            break  # nothing lower in this direction: rounding error is all that is left
        b, (value, gradient, hessian) = b + share * step, there
    if (left := np.abs(gradient).max()) > 1e-6 * total:
        raise ArithmeticError(f"the dual was not solved in {steps} Newton steps: a band is {left:.3g} tokens of {total:.3g} off")
    return b.tolist()


def copies(sizes: np.ndarray, rates: np.ndarray, rows: np.ndarray, order: np.ndarray, block: np.ndarray | None = None, most: int = MOST) -> np.ndarray:
    """Whole copies of groups of equal rows, together at most most times their rows, whose words follow the sum of size x rate; within a block from the longest to the shortest."""
    block = np.zeros(len(sizes), np.int64) if block is None else block
    out, owed, at = np.zeros(len(sizes), np.int64), 0.0, None
    for i in np.lexsort((order, -sizes, block)):
        if block[i] != at:
            at, owed = block[i], 0.0
        if not sizes[i]:
            out[i] = rows[i]
            continue
        owed += sizes[i] * rates[i] * rows[i]
        out[i] = min(most * rows[i], max(0, int(np.floor(owed / sizes[i] + 0.5))))
        owed -= out[i] * sizes[i]
    return out


def rounded(groups: DataFrame, blocks: Column, together: int) -> DataFrame:
    """groups (source_no, size, rate, n, order_key) with total, their whole copies. Sources of one block go many to a task's group, together of them; others have blocks of their own."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in groups.schema)}, total long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["total"] = copies(*(pdf[c].to_numpy() for c in ("size", "rate", "n", "order_key", "source_no")))
        return pdf

    alone = blocks > 1
    own = F.when(alone, F.col("source_no")).otherwise(-1)
    block = F.when(alone, F.pmod("order_key", F.greatest(blocks, F.lit(1)))).otherwise(F.pmod(F.xxhash64("source_no"), F.lit(together)))
    return groups.groupBy(own.alias("own"), block.alias("block")).applyInPandas(run, schema)


def plan(rows: DataFrame, *key: str, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """For rows (key columns, source, size): groups of equal rows with n (rows), total (copies of all of them), source_size, target and rate."""
    groups = written(rows.groupBy(*key, "source", "size").agg(F.count(F.lit(1)).alias("n")))
    tokens = F.col("size") * F.col("n")
    by_source = groups.groupBy("source").agg(
        F.sum(tokens).alias("source_size"), F.count(F.lit(1)).alias("groups"), *[F.coalesce(F.sum(F.when(band(F.col("size")) == i, tokens)), F.lit(0)).alias(f"band_{i}") for i in range(BANDS)]
    )
    ordered = written(numbered(by_source, F.col("source").isNull().asc(), F.col("source").asc()))
    sources = written(shares(ordered, weights).withColumn("state", state(ordered)).withColumn("blocks", F.ceil(F.col("groups") / F.lit(BLOCK_ROWS)).cast("long")))
    tilts = balance(sources)
    solved = written(sources.withColumn("a", F.when(F.col("state") == "free", own_tilt(tilts))).select(F.col("source").alias("m_source"), "source_no", "source_size", "target", "state", "a", "blocks", "groups"))
    n, small = solved.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("blocks") <= 1, F.col("groups"))), F.lit(0))).first()
    together = max(1, -(-small // BLOCK_ROWS))
    solved = solved.drop("groups")
    of = F.broadcast(solved) if n <= FEW_SOURCES else solved
    tilt = F.get(F.array(*map(F.lit, tilts)), band(F.col("size")))
    rated = groups.join(of, F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source").withColumn("rate", rate(F.col("a"), tilt)).drop("a", "state")
    rated = written(rated.withColumns({"order_key": F.xxhash64(*key, "size"), "long": (F.col("blocks") > 1) & (F.col("size") * F.col("blocks") * LONG > F.col("source_size"))}))
    # long ones first: at most LONG a block, so that a hundredth of the blocks holds them; what they leave over scales the rates of the rest
    first = written(rounded(rated.where("long"), F.floor(F.col("blocks") / 100), together))
    owed = first.groupBy(F.col("source_no").alias("o_no")).agg(F.sum(F.col("size") * F.col("rate") * F.col("n")).alias("due"), F.sum(F.col("size") * F.col("total")).alias("got"))
    owed = written(owed)
    of = F.broadcast(owed) if owed.count() <= FEW_SOURCES else owed
    due, got = F.coalesce("due", F.lit(0.0)), F.coalesce("got", F.lit(0))
    scale = F.when(F.col("target") > due, F.greatest(F.lit(0.0), (F.col("target") - got) / (F.col("target") - due))).otherwise(1.0)
    rest = rated.where("NOT long").join(of, F.col("source_no") == F.col("o_no"), "left").withColumn("scale", scale).drop("o_no", "due", "got")
    second = rounded(rest.withColumn("rate", F.least(F.lit(float(MOST)), F.col("rate") * F.col("scale"))), F.col("blocks"), together)
    second = second.withColumn("rate", F.when(F.col("scale") > 0, F.col("rate") / F.col("scale")).otherwise(F.col("rate"))).drop("scale")
    both = written(first.unionByName(second).drop("order_key", "long", "blocks", "source_no"))
    # a document without words has the rate 1, whatever its source
    return both.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.col("rate")))


def spread(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered 0, 1, 2, ...; rows of many are dealt out over tasks in pieces first."""
    few = rows.where(n <= CHUNK).withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))))
    pieces = rows.where(n > CHUNK).withColumn("s_from", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(CHUNK).cast("long")))).withColumn("s_to", F.least(F.col("s_from") + CHUNK, n.cast("long")) - 1)
    many = pieces.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn(name, F.explode(F.sequence("s_from", "s_to"))).drop("s_from", "s_to")
    return few.unionByName(many)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Each row of docs (text, source and any others) as often as the mix takes it. Copies are decided on keys of rows and joined to the rows.

    Of a group of equal rows each emits its even share of the copies; what is left over comes from one of them.
    """
    own = packed(docs, row_key(docs, 1).alias("k1"), row_key(docs, 2).alias("k2"))
    narrow = docs.select(row_key(docs, 1).alias("k1"), row_key(docs, 2).alias("k2"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    taken = plan(narrow, "k1", "k2", weights=weights).select("k1", "k2", F.floor(F.col("total") / F.col("n")).cast("long").alias("each"), F.pmod("total", "n").alias("more"))
    even = own.join(taken.where("each > 0").select("k1", "k2", "each"), ["k1", "k2"])
    out = spread(even, F.col("each"), "copy").select(ROW)
    more = taken.where("more > 0").select("k1", "k2", "more")
    if not more.isEmpty():
        one = own.join(more, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first(ROW).alias(ROW), F.first("more").alias("more"))
        out = out.unionByName(spread(one, F.col("more"), "copy").select(ROW))
    return unpacked(out)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    rows = spread(plan(docs, "doc_id"), F.col("n"), "i")
    upto = lambda i: F.floor(F.col("total") * i / F.col("n"))
    each = (upto(F.col("i") + 1) - upto(F.col("i"))).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (each * F.col("size")).alias("taken"), each.alias("copies"), "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)
