"""Quality classifier by importance resampling.

Two hashed n-gram bags are counted over whole texts: one over every document (the raw text), one over the documents that the
labels call good and not toxic (the target). A document's log importance weight is the log ratio of the two generative models, that
is the sum over its n-grams of log p_target - log p_raw. Perturbed by Gumbel noise, the k largest keys are a sample without
replacement by importance.

k is a budget that no key has a part in: labelled rows that are good count as they are, and of all other rows so large a part as the
upper bound (Clopper-Pearson, CONFIDENCE) of good ones among labelled documents. A toxic document of good quality is a good one here
(the labels keep the two apart), but is no model for the target.

Defined cases: a null text counts as empty; a text without a token has log weight 0; a null doc_id is a document like any other;
rows that repeat both doc_id and text get the same key, and rows that tie with the k-th key all stay; the lowest quality counts where
a document has several labels; extra columns pass through; with no good labelled document at hand every document stays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import ROW, packed, read_table, segments, uniform, unpacked, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 10_000
#: Labelled documents that fit the target model: at most so many, the first in the order of a hash of doc_id.
MAX_LABELS = 20_000
#: Of the bound on the share of good documents.
CONFIDENCE = 0.975
_MIX, _PAIR, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Ids(dict):
    """Token to 32-bit hash; emptied when large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def grams(text: str | None, ids: _Ids) -> Iterator[np.ndarray]:
    """The hashed 1-grams and 2-grams of a whole text as bucket numbers, piece by piece. A token that repeats the one before makes one and the same 2-gram."""
    last = None
    for piece in segments((text or "").lower()):
        tokens = TOKEN.findall(piece)
        if not tokens:
            continue
        one = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
        before = np.concatenate([[last], one[:-1]]).astype(np.uint64) if last is not None else one[:-1]
        after = one if last is not None else one[1:]
        two = np.where(before == after, _REPEAT, (before * _PAIR) ^ (after + _MIX))
        last = one[-1]
        both = np.concatenate([one, two]) * _MIX
        yield ((both >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def judged(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic), one row for each labelled document."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.min("quality") > 0).alias("good"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic"))
    )


def target_ids(labels: DataFrame, limit: int = MAX_LABELS) -> set[int]:
    rows = judged(labels).where("good AND NOT toxic").orderBy(F.xxhash64("label_id"), "label_id").limit(limit).collect()
    return {r.label_id for r in rows}


def fit(docs: DataFrame, wanted: set[int]) -> np.ndarray:
    """Log ratio of target to raw for each bucket. Counts come from all documents; each task sends one number pair for each bucket it met."""
    held = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, target = _Ids(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in grams(text.as_py(), ids):
                    found = np.bincount(found, minlength=BUCKETS)
                    raw += found
                    if doc_id in held.value:
                        target += found
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(count, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()  # BUCKETS rows at most
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    # pseudo-counts spread as the raw text is, so that rare buckets say little; fewer of them where there is little target text
    prior = min(5.0 * BUCKETS, 0.5 * target.sum()) * (raw + 0.1) / (raw + 0.1).sum()
    q, p = (target + prior) / (target + prior).sum(), (raw + prior) / (raw + prior).sum()
    return np.log(q) - np.log(p)


def weights(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """rows, whose texts are in their first column or in the row packed there, with log_weight as a last column; one pass over whole texts."""
    held = rows.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))
    schema = T.StructType([*rows.schema.fields, T.StructField("log_weight", T.DoubleType())])
    inside = rows.columns[0] == ROW

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            texts = batch.column(0).field("text") if inside else batch.column(0)
            out = [sum((float(held.value[found].sum()) for found in grams(text.as_py(), ids)), 0.0) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema.names)

    return rows.mapInArrow(weigh, schema)


def gumbel(*columns: Column | str, seed: int = 0) -> Column:
    return -F.log(-F.log(uniform(*columns, seed=seed)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The exact k-th largest value of a column: histograms of a fixed number of bins narrow the range, then a few values are sorted."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return lo if n else -math.inf
    above = 0  # values over hi
    while True:
        inside = df.where(F.col(column).between(lo, hi))
        width = (hi - lo) / bins
        left = k - above
        if width <= 0 or lo + width == lo:
            return hi
        counts = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b][0] >= left:
                break
            left -= counts[b][0]
            above += counts[b][0]
        size, lo, hi = counts[b]
        if size <= few:
            values = sorted((r[0] for r in inside.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
            return values[left - 1]


def upper_bound(good: int, n: int, confidence: float = CONFIDENCE) -> float:
    """The largest share of good ones that n labels with so many good ones do not rule out (Clopper-Pearson), by bisection."""
    if good >= n:
        return 1.0

    def at_most(p: float) -> float:
        """The lower tail at a share above good / n: terms fall from the last one down, and are added until no more are felt."""
        total, term, i = 1.0, 1.0, good
        while i > 0 and term > 1e-18 * total:
            k = np.arange(i, max(i - 65_536, 0), -1, dtype=float)
            terms = term * np.cumprod(k / (n - k + 1) * ((1 - p) / p))
            total, term, i = total + float(terms.sum()), float(terms[-1]), i - len(k)
        last = math.lgamma(n + 1) - math.lgamma(good + 1) - math.lgamma(n - good + 1) + good * math.log(p) + (n - good) * math.log1p(-p)
        return math.exp(last) * total

    lo, hi = good / n, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(min(max(mid, 1e-12), 1 - 1e-12)) > 1 - confidence else (lo, mid)
    return hi


def budget(docs: DataFrame, labels: DataFrame) -> int | None:
    """How many rows of docs (a column doc_id is enough) to keep; None, all, where no good labelled document is among them."""
    met = docs.select(F.col("doc_id").cast("long").alias("label_id")).groupBy("label_id").agg(F.count(F.lit(1)).alias("rows")).join(judged(labels), "label_id", "left")
    n = met.agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("good").isNotNull(), F.col("rows"))).alias("judged"), F.sum(F.when(F.col("good"), F.col("rows"))).alias("good_rows"), F.count("good").alias("documents"), F.count_if("good").alias("good")
    ).first()
    if not n.good:
        return None
    return n.good_rows + math.ceil((n.rows - n.judged) * upper_bound(n.good, n.documents))


def sampled(keys: DataFrame, k: int | None) -> tuple[DataFrame, float]:
    """keys with kept: whether its gumbel_key is among the k largest (None: all are); and the k-th largest."""
    at = -math.inf if k is None else kth_largest(keys, "gumbel_key", k) if k else math.inf
    return keys.withColumn("kept", F.col("gumbel_key") >= F.lit(at)), at


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    rated = weights(docs.select("text", "doc_id", gumbel("doc_id", "text").alias("noise")), fit(docs, target_ids(labels)))
    keys = written(rated.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key")))
    return sampled(keys, budget(docs, labels))[0]


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are sampled. They are written once with their keys, and read again by the k-th largest key."""
    ratio = fit(docs.select("doc_id", "text"), target_ids(labels))
    rated = weights(packed(docs, gumbel("doc_id", "text").alias("noise")), ratio)
    table = written(rated.select(ROW, (F.col("log_weight") + F.col("noise")).alias("gumbel_key")))
    return unpacked(sampled(table, budget(docs, labels))[0].where("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return select(docs, read_table(spark, sf_dir, "labels"))
