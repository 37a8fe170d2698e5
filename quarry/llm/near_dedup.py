"""Near duplicates by Order MinHash.

A text is its sequence of five-word shingles, each labelled with how often it has occurred before. A sketch takes the few labelled
shingles that are smallest under one hash function and keeps them in text order, so equal sketches speak for similar order, not
only similar content. Texts that share a sketch are candidates; an alignment of their words decides: with m words aligned in order,
texts of a and b words are linked if m / (a + b - m) is at least 0.8. Every pair whose shingles align that well has words that do, and so
has one with a word in ten replaced, whatever its length.

Equal texts (by words, letter case aside) are one node throughout. In a bucket of equal sketches every node is compared with the
smallest one. Where that leaves several components in a bucket, its pairs across components are compared block by block, as long as it
has at most WIDE nodes. The nodes of a wider one are dealt into narrower buckets within it first: of each node's labelled words, rarest
first, as many as a text of similarity 0.8 cannot all lack (prefix filter); those are treated alike. Pairs meet there only if they share the
sketch too, so the rule is one at every size: links are the pairs that share a sketch and align, as far as components need them. A group
of g copies costs about g comparisons, and a passage that very many texts share does not make pairs.

Two texts that share a part J of their labelled shingles share one sketch of SHINGLES with probability about J ** SHINGLES; SKETCHES of them
miss a link with probability 3e-6 at J = 0.8 and 0.02 at J = 0.63, which is one word in twenty replaced. Texts of fewer than SHORT shingles have
sketches of SHORT_SHINGLES as well or instead, since one word replaced costs them more: of 16 shingles it leaves J = 0.5, which 24 sketches of 2
miss with 0.001.

Defined cases: a null or wordless text is linked to nothing; texts of fewer than five words are one shingle, so only equal ones
are linked, as with all texts of at most three shingles; a null doc_id ranks last; rows that repeat are copies; a type other than
text is read as its string; extra columns pass through ``dedup``; an empty table has no class.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import ROW, WORD, Written, packed, read_table, segments, unpacked, written
from quarry.sources.tables import Scratch

WORDS = 5
SHINGLES = 4
SKETCHES = 24
#: Texts of fewer than SHORT labelled shingles have sketches of SHORT_SHINGLES; those of at least LONG have sketches of SHINGLES; some have both.
SHORT_SHINGLES, SHORT, LONG = 2, 64, 12
#: Nodes of a block when a bucket's remaining pairs are compared, and bytes of their sequences, about.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Words of a text that an alignment takes at once.
STRIP = 8_192
#: Nodes of a bucket whose pairs are compared as they are; a wider one is narrowed first.
WIDE = 32 * BLOCK
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        data = word.encode("utf-8", "surrogatepass")
        value = self[word] = zlib.crc32(data) << 32 | zlib.adler32(data)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_ids(text: str | None, ids: _Ids) -> np.ndarray:
    parts = []
    for piece in segments((text or "").lower()):
        found = WORD.findall(piece)
        parts.append(np.fromiter(map(ids.__getitem__, found), np.uint64, len(found)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The labelled shingles of a sequence of words, in order; all different."""
    if not len(words):
        return words
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mixed(h + words[i : i + n] + _A)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    label = np.empty(n, np.uint64)
    label[order] = np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))
    return mixed(h ^ (label * _A))


def sketches(own: np.ndarray) -> np.ndarray:
    """64-bit keys, one for each sketch; none for texts so short that only equal ones are similar."""
    if len(own) < 4:
        return np.zeros(0, np.int64)
    takes = [t for t, wanted in ((SHORT_SHINGLES, len(own) < SHORT), (SHINGLES, len(own) >= LONG)) if wanted]
    return np.concatenate([_sketches(own, take) for take in takes])


def _sketches(own: np.ndarray, take: int) -> np.ndarray:
    if len(own) <= 20_000:
        at = np.argpartition(mixed(own[None, :] ^ _SEEDS), take - 1, axis=1)[:, :take]
    else:  # a row at a time, to hold less
        at = np.stack([np.argpartition(mixed(own ^ seed), take - 1)[:take] for seed in _SEEDS[:, 0]])
    at.sort(axis=1)
    key = _SEEDS[:, 0] + np.uint64(take)
    for i in range(take):
        key = mixed(key + own[at[:, i]] * _A)
    return key.view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The most words that can be aligned in order: the longest common subsequence, by bits, STRIP words of a at a time."""
    if len(a) > len(b):
        a, b = b, a
    words, carry, total = b.tolist(), [0] * len(b), 0
    for first in range(0, len(a), STRIP):
        strip = a[first : first + STRIP].tolist()
        masks: dict[int, int] = {}
        for i, w in enumerate(strip):
            masks[w] = masks.get(w, 0) | 1 << i
        size, full = len(strip), (1 << len(strip)) - 1
        row = full  # a bit is 0 where the alignment grows by one word
        for j, w in enumerate(words):
            met = row & masks.get(w, 0)
            summed = row + met + carry[j]
            carry[j] = summed >> size
            row = (summed | (row - met)) & full
        total += size - row.bit_count()
    return total


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, as often as both have them, in any order."""
    n = len(a)
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.minimum(np.bincount(at[:n], minlength=at.max() + 1), np.bincount(at[n:], minlength=at.max() + 1)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether an alignment of two sequences of words reaches 0.8; what the ends have in common is aligned first."""
    n, least = len(a) + len(b), min(len(a), len(b))
    need = -(-4 * n // 9)
    if least < need:
        return False
    apart = np.flatnonzero(a[:least] != b[:least])
    start = int(apart[0]) if len(apart) else least
    a, b, least = a[start:], b[start:], least - start
    if least:
        apart = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
        end = int(apart[0]) if len(apart) else least
        a, b, start = a[: len(a) - end], b[: len(b) - end], start + end
    if start >= need:
        return True
    if not len(a) or not len(b) or start + overlap(a, b) < need:
        return False
    return start + common(a, b) >= need


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, keys): node is a 128-bit hash of the words, null where there are none; h is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                nodes, keys = [], []
                for text in part.column(2):
                    words = word_ids(text.as_py(), ids)
                    nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                    keys.append(sketches(shingles(words)) if len(words) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "node", "keys"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, node binary, keys array<long>")


def sequences(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, seq, bytes): the words of each node, 4 bytes each, read from one of its documents."""
    text = F.col("text").cast("string")
    joined = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text")).join(
        places.select(F.col("at.doc_id").alias("p_id"), F.col("at.h").alias("p_h"), "node"), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [(mixed(word_ids(t.as_py(), ids)) >> np.uint64(32)).astype(np.uint32).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "seq"])

    return joined.select("node", "text").mapInArrow(run, "node binary, seq binary").dropDuplicates(["node"]).withColumn("bytes", F.octet_length("seq"))


def words_in(seq: bytes) -> np.ndarray:
    return np.frombuffer(seq, np.uint32)


def labelled(seq: bytes) -> np.ndarray:
    """Each word with how often it has come before, as one number; all different but for chance."""
    a = words_in(seq).astype(np.uint64)
    order = np.argsort(a, kind="stable")
    s = a[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    label = np.empty(len(a), np.uint64)
    label[order] = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
    return np.unique(mixed(mixed(a) ^ (label * _A))).view(np.int64)


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose alignment is similar enough."""
    both = pairs.join(seqs.select(F.col("node").alias("u"), F.col("seq").alias("seq_u")), "u").join(seqs.select(F.col("node").alias("v"), F.col("seq").alias("seq_v")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            keep = []
            for u, v, a, b in zip(*(batch.column(i) for i in range(4))):
                v = v.as_py()
                if v not in known:
                    known = {v: words_in(b.as_py())}
                keep.append(similar(words_in(a.as_py()), known[v]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "seq_u", "seq_v").mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: label is the smallest node it is connected with.

    Rounds of large and small stars, each written; their number grows as the logarithm of the longest path.
    """
    now = Written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, last = mark, now
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        now = Written(small.distinct())
        last.drop()


def remaining(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """Similar pairs across components (label) within buckets (key), compared block by block, two blocks of BLOCK nodes to a task's group."""
    sized = members.join(seqs.select("node", "bytes"), "node")
    counts = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    own = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = own.select("key", "node", "label", "block", F.explode(pairs).alias("p")).select("key", "p.x", "p.y", "node", "label", "block").join(seqs.select("node", "seq"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        rows = [(n, g, b, words_in(s)) for n, g, b, s in zip(pdf["node"], pdf["label"], pdf["block"], pdf["seq"])]
        left, right = [r for r in rows if r[2] == x], [r for r in rows if r[2] == y]
        joined: dict[bytes, bytes] = {}  # labels that a link of this group has joined

        def top(g):
            while g in joined:
                g = joined[g]
            return g

        out = []
        for i, (u, g, _, a) in enumerate(left):
            for v, o, _, b in right[i + 1 :] if x == y else right:
                if top(g) != top(o) and similar(a, b):
                    joined[top(g)] = top(o)
                    out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"])

    return dealt.groupBy("key", "x", "y").applyInPandas(compare, "u binary, v binary")


def prefixes(seqs: DataFrame) -> DataFrame:
    """(item, node): of each node's labelled words, rarest first, so many that a similar text has at least one of them among its own."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "items"])

    each = written(seqs.select("node", "seq").mapInArrow(items, "node binary, items array<long>").select("node", F.explode("items").alias("item")))
    # counts are a table of their own, so that the join's two sides are dealt alike and a very common word's rows can be split
    counts = written(each.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    ranked = each.join(counts, "item", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "item"))).alias("i"))
    wanted = F.size("i") - F.ceil(F.size("i") * F.lit(0.8)).cast("int") + 1
    return ranked.select("node", F.explode(F.slice("i", F.lit(1), wanted)).alias("x")).where("x.c > 1").select(F.col("x.item").alias("item"), "node")


def gathered(buckets: DataFrame) -> DataFrame:
    """(key, node, lead, c) of the buckets (key, node) that hold several nodes: lead is the smallest of them, c their number."""
    shared = written(buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1"))  # a table of its own, so that a hot key's rows can be split
    return buckets.join(shared, "key")


def starred(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """The similar pairs among those of each node with its bucket's lead."""
    return verified(members.where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct(), seqs)


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, c) of buckets that hold several components; buckets of two are decided by their star."""
    held = members.where("c > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "c")
    several = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return held.join(several, "key", "left_semi")


def decided(members: DataFrame, seqs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, label) of all nodes that are linked with another, and the links (u, v) that were found, which join all of them."""
    edges = scratch.keep(starred(members, seqs))
    labels = components(edges)
    open_ = scratch.keep(undecided(members, labels))
    if open_.isEmpty():
        return labels, edges
    edges = scratch.keep(edges.unionByName(remaining(open_.where(F.col("c") <= WIDE), seqs)))
    wide = scratch.keep(open_.where(F.col("c") > WIDE).select("key", "node"))
    if not wide.isEmpty():
        held = scratch.keep(seqs.join(wide.select("node").distinct(), "node", "left_semi"))
        items = scratch.keep(prefixes(held))
        narrow = scratch.keep(gathered(wide.join(items, "node").select(F.xxhash64("key", "item").alias("key"), "node")))
        edges = scratch.keep(edges.unionByName(starred(narrow, held)))
        edges = scratch.keep(edges.unionByName(remaining(undecided(narrow, components(edges)), held)))
    return components(edges), edges


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, kept_id, kept_h, size, links, link_id) for each row of docs: which document of its class stays, the class's number of rows,
    with how many other texts its own was found linked, and the document that stands for the first of them."""
    rows = written(sketched(docs))
    nodes = written(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("at"), F.count(F.lit(1)).alias("n"))
    )
    with Scratch() as scratch:
        members = scratch.keep(gathered(nodes.select("node", F.explode("keys").alias("key"))))
        places = nodes.select("node", "at").join(members.select("node").distinct(), "node", "left_semi")
        seqs = scratch.keep(sequences(docs, places))
        labels, edges = decided(members, seqs, scratch)
        pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        both = pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("other")))
        linked = written(both.groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.min("other").alias("other")))
    to = nodes.select(F.col("node").alias("other"), F.col("at.doc_id").alias("link_id"))
    linked = linked.join(to, "other").select("node", "links", "link_id")
    grouped = nodes.select("node", "at", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = grouped.groupBy("label").agg(F.min("at").alias("kept"), F.sum("n").alias("size"))
    by_node = grouped.select("node", "label").join(kept, "label").join(linked, "node", "left").select("node", "kept", "size", F.coalesce("links", F.lit(0)).alias("links"), "link_id")
    return (
        rows.select("doc_id", "h", "node")
        .join(by_node, "node", "left")
        .select(
            "doc_id", "h", "node",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("kept_id"),
            F.when(F.col("node").isNull(), F.col("h")).otherwise(F.col("kept.h")).alias("kept_h"),
            F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("links", F.lit(0)).alias("links"), "link_id",
        )
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the smallest doc_id (null last), then the smallest text hash. Rows without words stay as often as they come."""
    found = classes(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")))
    keys = written(found.groupBy("doc_id", "h").agg(F.max(F.col("node").isNotNull()).alias("one"), F.count(F.lit(1)).alias("rows")))
    own = packed(docs, F.col("doc_id").cast("long").alias("d_id"), F.xxhash64(F.col("text").cast("string")).alias("d_h"))
    met = F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_h") == F.col("h"))
    out = own.join(keys.where("rows = 1 OR NOT one"), met).select(ROW)
    several = keys.where("rows > 1 AND one")
    if not several.isEmpty():  # rows that repeat doc_id and text: reduced to one in every task before they travel
        out = out.unionByName(own.join(several, met).groupBy("d_id", "d_h").agg(F.first(ROW).alias(ROW)).select(ROW))
    return unpacked(out)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("kept_id").alias("class_id"), F.col("size").cast("long").alias("class_size"), F.col("links").alias("n_links"), "link_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)
