"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has its own codebook; a pair of centroids is a cell. A query walks the cells by the sum of its nearness to
both centroids, with a heap, until the cells hold a share of all vectors; those are ranked again by the original vectors. The
codebooks, and the share that a query must visit to find RECALL of its neighbours, are fitted on a bounded sample (SAMPLE
vectors); every vector is indexed. Codebooks grow with the table, as the root of the number of vectors, so that cells stay small and
the share falls, up to MAX_CENTROIDS, which is what the sample can fit. How far it falls is the vectors' affair: README has figures.

Equal vectors are one entry with its ids, so a vector that a third of the rows hold is compared once. Neighbouring cells are packed
into bins of about BIN vectors (a larger cell is split), a bin meets the queries that visit it in groups of bounded size, and within a
bin a query is multiplied with the runs of cells that it visits, not with the others.

Defined cases: vectors that are null, all zero, of another length than most of the sample, or that hold a null or non-finite
component take no part, nor do rows without an id; rows that repeat an id and vector count once; an id with several vectors is
asked with each, and its list has each other id once, by its best score; ties go to the smaller id; fewer candidates than asked for
are all returned; an empty table gives an empty result; extra columns are ignored. Finite vectors of any magnitude take part: the index works
on vectors scaled by one power of two, products on queries scaled by one each, so nothing overflows on the way. A score of infinity says that
the inner product itself is beyond the doubles; such rows stay in the order of their true products.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read_table, written

SAMPLE = 15_000
#: Centroids of a half, at least and at most; between them about the root of the number of vectors, as a power of two.
MIN_CENTROIDS, MAX_CENTROIDS = 16, 1024
#: Cells of one row that the heap hands out at once; vectors of cells that are multiplied at once, about.
STEP, RUN = 32, 256
#: The share of true neighbours that sampled queries must find among the sample.
RECALL = 0.96
#: Vectors that a query visits at least, as many times as it asks for: of so few, a share leaves out neighbours and saves nothing.
LEAST = 50
BIN = 20_000
QUERIES = 2_000  # of a group, about


#: What rounding may hide, in parts of the largest product that could have been.
NOISE = 1e-9


def scaled(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row by a power of two, so that its products with any finite doubles are finite; and the power that was taken out."""
    shift = np.frexp(np.abs(q).max(axis=1))[1] + math.ceil(math.log2(q.shape[1])) + 1
    return np.ldexp(q, -shift[:, None]), shift


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2): vectors in double precision; h1 and h2 are a 128-bit hash, equal for equal vectors."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    return (
        table.select(F.col("vec_id").cast("long"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
        .select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    )


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds, from rows spread over the sample."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        for j in range(x.shape[1]):
            sums = np.bincount(own, x[:, j], len(centroids))
            centroids[:, j] = np.where(counts > 0, sums / np.maximum(counts, 1), centroids[:, j])
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(1), axis=1)


def centroids_for(n: int) -> int:
    return min(MAX_CENTROIDS, max(MIN_CENTROIDS, 1 << math.ceil(math.log2(max(n, 1)) / 2)))


def along_axis(centroids: np.ndarray) -> np.ndarray:
    """Centroids in order along their main axis, so that neighbours have near numbers."""
    axis = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0]
    return centroids[np.argsort(centroids @ axis, kind="stable")]


class Index:
    """Two codebooks of up to k centroids; cell = first * k + second."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half, self.k = sample.shape[1] // 2, k
        self.shift = int(np.frexp(np.abs(sample).max())[1])
        sample = self.own(sample)
        self.first, self.second = along_axis(codebook(sample[:, : self.half], k)), along_axis(codebook(sample[:, self.half :], k))

    def own(self, x: np.ndarray) -> np.ndarray:
        """Vectors in the index's scale; those far above all of the sample are held at its edge, which decides only their cell."""
        return np.clip(np.ldexp(x, -self.shift), -(2.0**100), 2.0**100)

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = self.own(x)
        return nearest(x[:, : self.half], self.first) * self.k + nearest(x[:, self.half :], self.second)

    def sums(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Nearness of each query to each cell: the sum of its inner products with both centroids."""
        q = self.own(q)
        return (q[:, : self.half] @ self.first.T)[:, cells // self.k] + (q[:, self.half :] @ self.second.T)[:, cells % self.k]

    def walk(self, q: np.ndarray, counts: np.ndarray, enough: int) -> tuple[np.ndarray, float]:
        """Cells with vectors, nearest first, that hold enough, and the sum of the last one.

        The heap has the next STEP cells of each row of centroid pairs that has begun, by the nearest of them; what is popped is complete
        down to the nearest that is still on the heap.
        """
        q = self.own(q)
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        rows, columns = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[rows], b[columns]
        table = counts.reshape(self.k, self.k)
        heap, popped, held = [(-a[0] - b[0], 0, 0)], [], 0
        while heap:
            if held >= enough:  # enough may lie beyond what is complete: count what is
                cells, sums = (np.concatenate(x) for x in zip(*popped))
                sure = sums >= -heap[0][0]
                if counts[cells[sure]].sum() >= enough:
                    break
                enough_popped = counts[cells[sure]].sum()
                held = enough_popped  # go on until as much again is popped
            _, i, j = heapq.heappop(heap)
            cells = rows[i] * self.k + columns[j : j + STEP]
            n = table[rows[i], columns[j : j + STEP]]
            some = n > 0
            popped.append((cells[some], a[i] + b[j : j + STEP][some]))
            held += int(n.sum())
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
            if j + STEP < len(columns):
                heapq.heappush(heap, (-a[i] - b[j + STEP], i, j + STEP))
        cells, sums = (np.concatenate(x) for x in zip(*popped))
        order = np.argsort(-sums, kind="stable")
        upto = int(np.searchsorted(np.cumsum(counts[cells[order]]), enough)) + 1
        order = order[:upto]
        return cells[order], float(sums[order[-1]])


def share(index: Index, sample: np.ndarray, recall: float = RECALL, near: int = 20, queries: int = 200) -> float:
    """The share of the sample that queries from it must visit to find so many of their neighbours."""
    q = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    near = min(near + 1, len(sample))  # the query itself is found as well
    cells = index.cells(sample)
    best = np.argpartition(-(scaled(q)[0] @ sample.T), near - 1, axis=1)[:, :near]
    order = np.argsort(-index.sums(q, cells), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(sample))[None, :].repeat(len(q), 0), 1)
    at = np.sort(np.take_along_axis(rank, best, 1).ravel())
    return float((at[int(np.ceil(recall * len(at))) - 1] + 1) / len(sample))


def bins(counts: np.ndarray, most: int = BIN) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its bin and the number of bins that it is split over."""
    first, split, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        if held and held + n > most:
            at, held = at + 1, 0
        first[cell] = at
        if n > most:
            split[cell] = -(-n // most)
            at, held = at + int(split[cell]), 0
        else:
            held += n
    return first, split


def search(table: DataFrame, every: int = 20, near: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by every."""
    spark = table.sparkSession
    rows = written(usable(table))
    empty = "query_id long, rank int, vec_id long, score double"
    sample = rows.dropDuplicates(["h1", "h2"]).orderBy("h1", "h2").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], empty)
    size = Counter(len(r.v) for r in sample).most_common(1)[0][0]
    fitted = np.array([r.v for r in sample if len(r.v) == size])
    rows = rows.where(F.size("v") == size)
    index = Index(fitted, centroids_for(rows.count()))
    part = share(index, fitted, near=near)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).flatten()).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(x).astype(np.int32))], ["h1", "h2", "first_id", "v", "query", "cell"])

    entries = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.first("v").alias("v"), F.max(F.col("vec_id") % every == 0).alias("query"))
    entries = written(entries.mapInArrow(assign, "h1 long, h2 long, first_id long, v array<double>, query boolean, cell int"))
    counts = np.zeros(index.k * index.k, np.int64)
    for r in entries.groupBy("cell").count().collect():  # MAX_CENTROIDS ** 2 rows at most
        counts[r.cell] = r["count"]
    first, split = bins(counts)
    enough = max(int(np.ceil(part * counts.sum())), LEAST * near, near + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten()).reshape(-1, size)
            take, to, least = [], [], []
            for i, q in enumerate(x):
                cells, last = index.walk(q, counts, enough)
                begin = np.unique(first[cells])
                visited = np.unique(np.concatenate([begin, *[np.arange(first[c], first[c] + split[c]) for c in cells[split[cells] > 1]]]))
                take.append(np.full(len(visited), i))
                to.append(visited)
                least.append(np.full(len(visited), last))
            take, to, least = (np.concatenate(x) if x else np.zeros(0) for x in (take, to, least))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(take.astype(np.int64))) for c in batch.columns] + [pa.array(least.astype(float)), pa.array(to.astype(np.int64))], ["q1", "q2", "q", "least", "bin"])

    routed = written(entries.where("query").select("h1", "h2", "v").mapInArrow(route, "q1 long, q2 long, q array<double>, least double, bin long"))
    groups = routed.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("parts"))
    cell_bins = spark.createDataFrame(pd.DataFrame({"cell": np.flatnonzero(counts), "b": first[counts > 0], "s": split[counts > 0]}), "cell int, b long, s long")
    placed = entries.join(F.broadcast(cell_bins), "cell").withColumn("bin", F.col("b") + F.pmod(F.col("h1"), F.col("s")))
    asked = routed.join(groups, "bin").withColumn("part", F.pmod(F.col("q1"), F.col("parts")).cast("int"))
    offered = placed.join(groups, "bin").select("h1", "h2", "first_id", "v", "cell", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q1", "q2", "h1", "h2", "first_id", "score", "shift"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        right = right.sort_values("cell", kind="stable")
        x, q, cell = np.stack(right["v"].to_numpy()), np.stack(left["q"].to_numpy()), right["cell"].to_numpy()
        ids, (q1, q2, h1, h2) = right["first_id"].to_numpy(), (t[c].to_numpy() for t, c in ((left, "q1"), (left, "q2"), (right, "h1"), (right, "h2")))
        cells, start = np.unique(cell, return_index=True)
        sums = index.sums(q, cells)
        seen = sums >= (left["least"].to_numpy() - NOISE * (np.abs(left["least"].to_numpy()) + np.abs(sums).max(axis=1)))[:, None]
        q, shift = scaled(q)
        noise = NOISE * np.abs(q).sum(axis=1) * np.abs(x).max()
        met, scores, rows_ = [], [], []
        for run in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(start // RUN)) + 1):
            asks = np.flatnonzero(seen[:, run].any(axis=1))
            at = np.arange(start[run[0]], start[run[-1] + 1] if run[-1] + 1 < len(start) else len(cell))
            if not len(asks):
                continue
            score = q[asks] @ x[at].T
            score[~seen[np.ix_(asks, run)][:, np.searchsorted(cells[run], cell[at])]] = -np.inf
            if len(at) > near + 1:
                best = np.argpartition(-score, near, axis=1)[:, : near + 1]
                # as many as tie with the last one, within what rounding may hide
                bar = np.take_along_axis(score, best, 1).min(axis=1) - noise[asks]
                i, j = np.nonzero(score >= np.maximum(bar, np.finfo(float).min)[:, None])
            else:
                i, j = np.nonzero(score > -np.inf)
            met.append(asks[i])
            rows_.append(at[j])
            scores.append(score[i, j])
        if not met:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        met, rows_, scores = map(np.concatenate, (met, rows_, scores))
        order = np.lexsort((-scores, met))
        met, rows_, scores = met[order], rows_[order], scores[order]
        begin = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        last = scores[np.minimum(begin + near, np.concatenate([begin[1:], [len(met)]]) - 1)] - noise[met[begin]]
        some = scores >= np.repeat(last, np.diff(np.concatenate([begin, [len(met)]])))
        met, rows_ = met[some], rows_[some]
        exact = np.concatenate([(x[rows_[k : k + 4096]] * q[met[k : k + 4096]]).sum(axis=1) for k in range(0, len(met), 4096)])  # the same sum wherever the row stands
        order = np.lexsort((ids[rows_], -exact, met))
        met, rows_, exact = met[order], rows_[order], exact[order]
        begin = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        place = np.arange(len(met)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(met)]])))
        some = place <= near
        met, rows_, exact = met[some], rows_[some], exact[some]
        return pd.DataFrame(dict(zip(names, (q1[met], q2[met], h1[rows_], h2[rows_], ids[rows_], exact, shift[met].astype(np.int64)))))

    found = asked.groupBy("bin", "part").cogroup(offered.groupBy("bin", "part")).applyInPandas(rank, "q1 long, q2 long, h1 long, h2 long, first_id long, score double, shift long")

    def top(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    best = top(found, near + 1, ["q1", "q2"], F.desc("score"), "first_id").drop("rank", "first_id")
    ids = rows.select("h1", "h2", "vec_id").distinct()
    # of equal vectors only the first few ids can be among the nearest; queries that are equal share one list, one longer than asked for
    few = top(ids, near + 1, ["h1", "h2"], "vec_id").drop("rank")
    listed = top(best.join(few, ["h1", "h2"]), near + 1, ["q1", "q2"], F.desc("score"), "vec_id").drop("rank", "h1", "h2")
    asking = ids.where(F.col("vec_id") % every == 0).select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("vec_id").alias("query_id"))
    # an id of several vectors is found or asked with each of them: its best score counts
    half = F.floor(F.col("shift") / 2)
    true = F.col("score") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.col("shift") - half)
    beyond = F.when(F.abs(true) == F.lit(float("inf")), F.col("score"))  # what orders scores that no double can hold
    both = asking.join(listed, ["q1", "q2"]).where("vec_id <> query_id").select("query_id", "vec_id", F.struct(true.alias("score"), beyond.alias("beyond")).alias("s"))
    ranked = top(both.groupBy("query_id", "vec_id").agg(F.max("s").alias("s")), near, ["query_id"], F.desc("s"), "vec_id")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "s.score")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))
