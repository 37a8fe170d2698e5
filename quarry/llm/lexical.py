"""Ranked lexical search: exact inner products over sparse ball trees of documents.

A document is the sparse vector x[t] = (10 ** 9 * tf) div (1000 * tf + 8 * m) over the terms that the asked items hold, m = 10 + (90 * n * N) div L;
an item is the vector of its terms' weights w. Documents are arranged by their two heaviest terms and stored; each task cuts its share into trees
of at most TREE_DOCS documents and TREE_ENTRIES entries. A node keeps its documents' centroid c and radius r; q . x <= q . c + \\|q\\| * r for all of
them, and q . x <= q . (largest value by coordinate); the smaller of both, rounded up by a margin far above the error of doubles, is the node's
bound. A tree is searched best-first by a heap of bounds for each item, and a subtree is left when its bound cannot beat what the item has. Leaves
are scored in 64-bit integers.

Two passes share one search: the first visits each item's best leaf of each tree, which gives the item real scores of ten different documents,
so the tenth is a score below which nothing is asked for any more; the second searches all trees from there. A task returns at most ten rows an
item, whatever its documents.

The items are the asked side: they are gathered in batches of about PAIRS item terms, each of which is run against all documents, and are the only
thing broadcast. Documents are never gathered. Each batch of items reads the documents' term counts once; more than PAIRS item terms need
more passes.

Defined cases: a null or wordless text holds no term, is no document of N and is never listed; an item without terms, or whose terms no document
holds, has no row; rows of documents that repeat are documents of their own, each with its rank; items of one item_id are one item with all their
terms; a null doc_id comes after all others of its score; very long texts are counted whole; an empty table on either side gives no row; other
columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read_table
from quarry.sources.tables import Scratch, Stored

TOP = 10
TREE_DOCS, TREE_ENTRIES, LEAF = 8_192, 1_000_000, 64
PAIRS = 50_000
#: Items whose bounds are computed together.
TOGETHER = 64
#: Entries of a task's share of the arranged documents.
SHARE = 500_000
MARGIN = 1e-9
#: Bytes of terms keep their value, A-Z in lower case; all others separate. Bytes from 0x80 on belong to code points above 0x7F.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


class Items(NamedTuple):
    """Asked items of one batch; item i holds terms[starts[i] : starts[i + 1]] with their weights."""

    ids: list[int | None]
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def asked(benchmark: DataFrame) -> DataFrame:
    """(item_id, term): the terms of each item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, w) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(words_of(text or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], ["item_id", "term"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return benchmark.select(F.col("item_id").cast("long"), text).mapInArrow(run, "item_id long, term binary").distinct()


def lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs) of each document with a term at all: how often it holds the asked terms, by their number."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        for batch in batches:
            rows, ns, starts, ids, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                found = Counter(words_of(text.as_py() or b""))
                if not found:
                    continue
                own = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                rows.append(row)
                ns.append(found.total())
                ids += [x[0] for x in own]
                tfs += [x[1] for x in own]
                starts.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), lists(starts, np.array(ids, np.int32)), lists(starts, np.array(tfs, np.int64))], ["doc_id", "n", "ids", "tfs"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def arranged(counts: DataFrame, weights: np.ndarray, n_docs: int, total: int, shares: int) -> DataFrame:
    """(doc_id, ids, x) of the documents with an asked term, dealt and sorted by their two heaviest terms."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            ids, tfs = batch.column(2), batch.column(3)
            starts = ids.offsets.to_numpy()
            own, tf = ids.values.to_numpy()[starts[0] : starts[-1]], tfs.values.to_numpy()[starts[0] : starts[-1]]
            starts = starts - starts[0]
            m = np.array([10 + 90 * n * n_docs // total for n in batch.column(1).to_pylist()], np.int64)  # integers of any size
            x = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(starts)))
            heavy = w[own] * x
            first, second = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                two = np.argsort(-heavy[a:b], kind="stable")[:2]
                first.append(int(own[a + two[0]]))
                second.append(int(own[a + two[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(starts, own), lists(starts, x), pa.array(first, pa.int32()), pa.array(second, pa.int32())], ["doc_id", "ids", "x", "first", "second"])

    found = counts.where(F.size("ids") > 0).mapInArrow(run, "doc_id long, ids array<int>, x array<long>, first int, second int")
    spread = F.xxhash64("doc_id")  # a pair of terms that very many documents share goes to several tasks
    return found.repartitionByRange(shares, "first", "second", spread).sortWithinPartitions("first", "second").select("doc_id", "ids", "x")


class Docs(NamedTuple):
    """Documents of one tree, by rows: values x of the columns cols, entries starts[i] to starts[i + 1]."""

    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    cols: np.ndarray
    x: np.ndarray

    def take(self, rows: np.ndarray) -> Docs:
        size = (self.starts[1:] - self.starts[:-1])[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], size) + np.repeat(self.starts[rows], size)
        return Docs(self.ids[rows], self.null[rows], starts, self.cols[at], self.x[at])

    def times(self, dense: np.ndarray) -> np.ndarray:
        """Each document's inner product with a vector, in the vector's type. Every document has an entry."""
        return np.add.reduceat(self.x * dense[self.cols], self.starts[:-1])


class Tree:
    """Nodes by number, the root first; a node's documents are lo to hi of the tree's order, and its children come after it."""

    def __init__(self, docs: Docs, width: int):
        self.lo, self.hi, self.child, centroid, top, self.radius, self.least = [], [], [], [], [], [], []
        norm = np.add.reduceat(docs.x.astype(float) ** 2, docs.starts[:-1])
        order, todo = np.arange(len(docs.ids)), [(0, len(docs.ids), None)]
        while todo:
            lo, hi, parent = todo.pop()
            if parent is not None:
                self.child[parent].append(len(self.lo))
            own = docs.take(order[lo:hi])
            c = np.bincount(own.cols, own.x, width) / (hi - lo)
            largest = np.zeros(width)
            np.maximum.at(largest, own.cols, own.x)
            size, square = norm[order[lo:hi]], float(c @ c)
            apart = np.maximum(size - 2 * own.times(c) + square, 0) + MARGIN * (size + square)  # what cancels is less than the margin
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([])
            centroid.append(c)
            top.append(largest)
            self.radius.append(math.sqrt(apart.max()))
            self.least.append(min(zip(own.null.tolist(), own.ids.tolist())))
            if hi - lo > LEAF:
                far = self._dense(own, int(apart.argmax()), width)
                other = self._dense(own, int((size - 2 * own.times(far)).argmax()), width)
                order[lo:hi] = order[lo:hi][np.argsort(own.times(far - other), kind="stable")]
                middle = (lo + hi) // 2
                todo += [(lo, middle, len(self.lo) - 1), (middle, hi, len(self.lo) - 1)]
        self.docs, self.centroid, self.top, self.radius = docs.take(order), np.array(centroid), np.array(top), np.array(self.radius)

    @staticmethod
    def _dense(docs: Docs, i: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[docs.cols[docs.starts[i] : docs.starts[i + 1]]] = docs.x[docs.starts[i] : docs.starts[i + 1]]
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and node: a number that no document of the node exceeds."""
        q = queries.astype(float)
        ball = q @ self.centroid.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radius[None, :]
        return np.minimum(ball, q @ self.top.T) * (1 + MARGIN) + 1

    def leaf(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, null flags and ids of a leaf's documents."""
        lo, hi, d = self.lo[node], self.hi[node], self.docs
        a, b = d.starts[lo], d.starts[hi]
        return np.add.reduceat(d.x[a:b] * query[d.cols[a:b]], d.starts[lo:hi] - a), d.null[lo:hi], d.ids[lo:hi]

    def search(self, query: np.ndarray, bound: np.ndarray, best: list[tuple], floor: int, one_leaf: bool) -> None:
        """Put the best documents into best, a heap of (score, not null, -doc_id), worst first, of at most TOP; none below floor."""
        open_ = [(-bound[0], 0)]
        while open_:
            limit, node = heapq.heappop(open_)
            if -limit < floor or len(best) == TOP and -limit < best[0][0]:
                return
            if self.child[node]:
                for x in self.child[node]:
                    heapq.heappush(open_, (-bound[x], x))
                continue
            null, doc_id = self.least[node]
            if len(best) == TOP and (math.floor(-limit), not null, -doc_id) < best[0]:
                continue  # not even a tie with a smaller doc_id
            score, nulls, ids = self.leaf(node, query)
            for i in np.flatnonzero(score >= max(floor, 1)):
                entry = (int(score[i]), not nulls[i], -int(ids[i]))
                if len(best) < TOP:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if one_leaf:
                return


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Docs, np.ndarray]]:
    """Documents enough for a tree each, with the terms that stand for their columns."""
    held: list[tuple] = []
    n_docs = n_entries = 0

    def cut() -> tuple[Docs, np.ndarray]:
        sizes = np.concatenate([np.diff(h[2]) for h in held])
        terms, cols = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
        return Docs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(sizes)]), cols.astype(np.int64), np.concatenate([h[4] for h in held])), terms

    for batch in batches:
        starts = batch.column(1).offsets.to_numpy().astype(np.int64)
        ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        cols, x = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(starts, starts[at] + TREE_ENTRIES - n_entries, "right")) - 1 - at
            take = max(min(room, TREE_DOCS - n_docs, batch.num_rows - at), 0 if held else 1)
            if take:
                to = at + take
                held.append((ids[at:to], null[at:to], starts[at : to + 1], cols[starts[at] : starts[to]], x[starts[at] : starts[to]]))
                n_docs, n_entries, at = n_docs + take, n_entries + int(starts[to] - starts[at]), to
            if at < batch.num_rows:
                yield cut()
                held, n_docs, n_entries = [], 0, 0
    if held:
        yield cut()


def best_of(spark: SparkSession, docs: DataFrame, items: Items, floors: np.ndarray, one_leaf: bool) -> DataFrame:
    """(item, score, doc_id): the best rows of each task for each item."""
    shared = spark.sparkContext.broadcast((items.starts, items.terms, items.weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, weights, floors = shared.value
        best: list[list[tuple]] = [[] for _ in floors]
        for found, columns in trees(batches):
            tree = Tree(found, len(columns))
            at = np.minimum(np.searchsorted(columns, terms), len(columns) - 1)
            there = columns[at] == terms
            for first in range(0, len(floors), TOGETHER):
                last = min(first + TOGETHER, len(floors))
                queries = np.zeros((last - first, len(columns)), np.int64)
                a, b = starts[first], starts[last]
                rows = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))[there[a:b]]
                queries[rows, at[a:b][there[a:b]]] = weights[a:b][there[a:b]]
                for i, (query, bound) in enumerate(zip(queries, tree.bounds(queries)), first):
                    tree.search(query, bound, best[i], int(floors[i]), one_leaf)
        rows = [(i, score, None if not known else -doc_id) for i, heap in enumerate(best) for score, known, doc_id in heap]
        for first in range(0, len(rows), 50_000):
            part = rows[first : first + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], ["item", "score", "doc_id"])

    return docs.mapInArrow(run, "item int, score long, doc_id long")


def ranked(found: DataFrame, by: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def searched(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items in pairs (item_id, term), which the driver gathers."""
    spark = docs.sparkSession
    by_item: dict[int | None, list[bytes]] = {}
    for item_id, term in pairs.toLocalIterator():
        by_item.setdefault(item_id, []).append(bytes(term))
    vocabulary = sorted({t for own in by_item.values() for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    with Scratch() as scratch:
        counts = scratch.keep(counted(docs, vocabulary))
        n_docs, total, entries = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("ids"))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, held in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1))).collect():  # as long as the items' terms
            df[term] = held
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        ids = sorted(by_item, key=lambda i: (i is None, i or 0))
        terms = [np.array(sorted(number[t] for t in by_item[i]), np.int64) for i in ids]
        flat = np.concatenate([*terms, np.zeros(0, np.int64)])
        items = Items(ids, np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64), flat, weights[flat])
        own = scratch.keep(arranged(counts, weights, n_docs, total or 1, max(1, -(-(entries or 0) // SHARE))))
        floors = np.ones(len(ids), np.int64)
        seeds = ranked(best_of(spark, own, items, floors, True), "item").groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).where(F.col("c") == TOP)
        for item, _, score in seeds.collect():  # one number an item
            floors[item] = score
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        found = ranked(best_of(spark, own, items, floors, False), "item").join(F.broadcast(named), "item")
        return Stored(found.select("item_id", "rank", "doc_id", "score")).df


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The TOP best documents of each item, of all documents: (item_id, rank, doc_id, score)."""
    with Scratch() as scratch:
        pairs = scratch.keep(asked(benchmark))
        batches = max(1, -(-pairs.count() // PAIRS))
        parts = [searched(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b)) for b in range(batches)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s),
m AS (SELECT doc_id, 10 + (90 * len(w) * n_docs) // total AS m FROM d, s WHERE len(w) > 0),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""
