"""Audit of how far the sources of a language diverge: CountVectorizer vectors, sums by group, sparse evaluation of pairs.

Terms are tagged with their document's lang, so one ``CountVectorizer`` (minDF, vocabSize the largest integer) holds the vocabularies of all
languages, each with exactly the terms in at least MIN_DF of its documents, however many languages there are. A task counts the terms of the
documents that it reads by lang and source, and by lang the documents that hold each; what the vectorizer gets are these counts, digit by
binary digit. Its sparse vectors are added up by lang, source and index, and what follows works on these sums.

A group's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), and two shares p, q diverge by floor((p - q) ** 2 / q). Pairs of
sources are evaluated sparsely: D(g, h) = V * f(p0, q0) + sum over g's terms of f(p, q0) - f(p0, q0) + sum over h's terms of f(p*, q) - f(p*, q0)
where p0, q0 are the shares of an absent term and p* is g's share of the term that h holds. Entries are dealt by term into chunks of about
ENTRIES and by blocks of about BLOCK sources, so a task's memory is bounded however large a group of documents is; a chunk returns one number
for each pair. All arithmetic is in 64-bit integers, counts past 9e9 in decimals.

The model is held by the driver and broadcast, so its size is checked first: the vocabulary is counted as a table, and past MAX_TERMS tagged
terms (a parameter; about 100 MB) the sums come from a join with that table instead. Both ways give the same rows.

Defined cases: null text, lang and source are ''; every row is a document of its own, so rows that repeat count as often as they come; a group
without a kept term has N = 0 and still pairs with the others; a lang without kept terms has V = 0 and value 0 for all pairs, no term rows; a very
long text is split by itself; ties rank by item in UTF-8 order; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read_table
from quarry.sources.tables import Scratch, Stored

MIN_DF, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Tagged terms that a model may hold; more stay in a table.
MAX_TERMS = 1_000_000
ENTRIES, BLOCK = 20_000, 256
#: Entries of sums that a task holds before it hands them on, and entries that wait until they are added up, at least.
HELD, WAITING = 1_000_000, 200_000
#: Terms in the documents of a bucket of sums, about, and the number of buckets at most.
BUCKET, MOST_BUCKETS = 2_000_000, 2_048
#: Between lang and term; no term holds it, so the last one in a tagged term is this one.
TAG = " "
#: Bytes of terms keep their value, A-Z in lower case; all others separate. Bytes from 0x80 on belong to code points above 0x7F.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Sums:
    """Counts by key, a group's number << 31 | a term's index, as sorted arrays."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, str], int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def groups(self, names: Iterable[tuple[str, str]]) -> np.ndarray:
        return np.array([self.numbers.setdefault(n, len(self.numbers)) for n in names], np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(WAITING, len(self.keys) // 2):
            self.settle()

    def settle(self) -> None:
        """Add up what has come since; before that it is in neither keys nor counts."""
        keys, counts = (np.concatenate([own, *[w[i] for w in self.waiting]]) for i, own in enumerate((self.keys, self.counts)))
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def batch(self, at: np.ndarray | slice, names: list[str]) -> pa.RecordBatch:
        """(lang, source, index, c) of the entries at these places."""
        known = list(self.numbers)
        own = pa.array(self.keys[at] >> 31)
        columns = [pa.array([n[k] for n in known], pa.string()).take(own) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array((self.keys[at] & (2**31 - 1)).astype(np.int32)), pa.array(self.counts[at])], names)


ENTRY = ["lang", "source", "index", "c"]


PART_ROWS, PART_BYTES = 1_000, 16_000_000


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PART_ROWS rows and, but for single rows, PART_BYTES of text."""
    upto, first = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while first < batch.num_rows:
        last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PART_BYTES, side="right"))
        last = min(max(last, first + 1), first + PART_ROWS)
        yield batch.slice(first, last - first)
        first = last


class Counted:
    """Terms of documents: occurrences by lang and source, and numbers of documents by lang."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.sums, self.held_by = Sums(), Sums()
        self.n = np.zeros(0, np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
        lists = pc.ascii_split_whitespace(pa.array([t.as_py().translate(_LETTERS) for t in part.column(2)], pa.large_binary()).view(pa.large_string()))
        flat = lists.flatten().dictionary_encode()
        known = np.array([self.words.setdefault(w, len(self.words)) if w else -1 for w in flat.dictionary.to_pylist()], np.int64)
        code, document = known[flat.indices.to_numpy()], np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        some = code >= 0  # blanks at an end have an empty word beside them
        pairs, counts = np.unique(document[some] << 31 | code[some], return_counts=True)
        document, code = pairs >> 31, pairs & (2**31 - 1)
        group, lang = self.sums.groups(zip(langs, sources)), self.held_by.groups((g, "") for g in langs)
        self.n = np.concatenate([self.n, np.zeros(len(self.sums.numbers) - len(self.n), np.int64)])
        np.add.at(self.n, group[document], counts)
        self.sums.add(group[document] << 31 | code, counts)
        self.held_by.add(lang[document] << 31 | code, np.ones(len(code), np.int64))

    def batches(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(list(self.words), pa.string())
        for sums, of_groups in ((self.sums, True), (self.held_by, False)):
            sums.settle()
            names, group = list(sums.numbers), sums.keys >> 31
            digits = range(int(sums.counts.max(initial=1)).bit_length()) if of_groups else range(1)
            at = [np.flatnonzero(sums.counts >> d & 1) if of_groups else np.arange(len(sums.keys)) for d in digits]
            key = np.concatenate([group[x] + d * len(names) for d, x in zip(digits, at)])
            at, rows = np.concatenate(at), np.union1d(np.arange(len(names)), key)
            lang = pa.array([n[0] for n in names], pa.string())
            terms = pc.binary_join_element_wise(lang.take(pa.array(group[at])), words.take(pa.array(sums.keys[at] & (2**31 - 1))), TAG)
            starts = pa.array(np.searchsorted(key, np.append(rows, rows[-1] + 1 if len(rows) else 0)).astype(np.int32))
            own, digit = pa.array(rows % max(len(names), 1)), (rows // max(len(names), 1)).astype(np.int32)
            nothing = lambda kind: pa.nulls(len(rows), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.take(own), pa.array([n[1] for n in names], pa.string()).take(own) if of_groups else nothing(pa.string()), pa.array(digit) if of_groups else nothing(pa.int32()),
                    pa.ListArray.from_arrays(starts, terms), nothing(pa.list_(pa.int64())) if of_groups else pa.ListArray.from_arrays(starts, pa.array(sums.counts[at])),
                    pa.array(np.where(digit == 0, self.n[rows % max(len(names), 1)], 0) if of_groups else np.zeros(len(rows), np.int64)),
                ],
                ["lang", "source", "digit", "terms", "df", "n"],
            )


def terms_of(docs: DataFrame) -> DataFrame:
    """(lang, source, digit, terms, df, n): terms, tagged with their lang, of the documents that a task reads together.

    A row with a digit has the terms whose number of occurrences in its lang and source has that binary digit: each occurrence counts, yet a term
    comes once for a digit and not once for an occurrence. Every group has a row of digit 0, with its number n of terms. A row without a digit
    has all terms of a lang and the number of documents that hold each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted()
        for batch in batches:
            for part in parts(batch):
                counted.add(part)
                if len(counted.sums.keys) > HELD:
                    yield from counted.batches()
                    counted = Counted()
        yield from counted.batches()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, digit int, terms array<string>, df array<long>, n long")


def vocabulary(documents: DataFrame) -> DataFrame:
    """(term, lang) of the tagged terms in at least MIN_DF documents of their lang."""
    each = documents.where("df IS NOT NULL").select(F.inline(F.arrays_zip("terms", "df")))
    found = each.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")).where(F.col("df") >= MIN_DF).select("term")
    return found.withColumn("lang", F.expr("left(term, length(term) - length(substring_index(term, ' ', -1)) - 1)"))


def summed(vectors: DataFrame, buckets: int) -> DataFrame:
    """(lang, source, index, c): sparse vectors (lang, source, digit, indices, values) added up by group, each worth two to its digit.

    A task adds up what it reads and hands it on as one row of arrays for each bucket of indices; a bucket's rows are added up as they arrive,
    so it holds its own sums alone, terms by groups, however many documents there are.
    """

    def cut(sums: Sums) -> Iterator[pa.RecordBatch]:
        sums.settle()
        of = (sums.keys & (2**31 - 1)) % buckets
        order = np.argsort(of, kind="stable")
        found, first = np.unique(of[order], return_index=True)
        names = list(sums.numbers)
        for bucket, at in zip(found, np.split(order, first[1:])):
            own, code = np.unique(sums.keys[at] >> 31, return_inverse=True)
            arrays = [[[names[g][k] for g in own]] for k in (0, 1)]
            packed = [[code.astype(np.int32).tobytes()], [(sums.keys[at] & (2**31 - 1)).astype(np.int32).tobytes()], [sums.counts[at].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), *[pa.array(a, pa.list_(pa.string())) for a in arrays], *[pa.array(x, pa.binary()) for x in packed]], ["bucket", "langs", "sources", "own", "index", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            group = sums.groups(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            keys = np.repeat(group, sizes) << 31 | batch.column(3).flatten().to_numpy()
            sums.add(keys, batch.column(4).flatten().to_numpy().astype(np.int64) << np.repeat(batch.column(2).to_numpy(), sizes))
            if len(sums.keys) > HELD:
                yield from cut(sums)
                sums = Sums()
        yield from cut(sums)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for _, langs, sources, own, index, c in zip(*(batch.column(i).to_pylist() for i in range(6))):
                group = sums.groups(zip(langs, sources))
                sums.add(group[np.frombuffer(own, np.int32)] << 31 | np.frombuffer(index, np.int32), np.frombuffer(c, np.int64))
        sums.settle()
        for first in range(0, len(sums.keys), 50_000):
            yield sums.batch(slice(first, first + 50_000), ENTRY)

    rows = vectors.mapInArrow(run, "bucket int, langs array<string>, sources array<string>, own binary, index binary, c binary")
    return rows.groupBy("bucket").applyInArrow(merge, "lang string, source string, index int, c long")


def vector_sums(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, source, term, c): sparse count vectors of the documents' terms, digit by digit, summed by group.

    The vectorizer is fitted on the vocabulary's table, in which each term has its least number of documents, so that it learns what it would
    learn from the corpus without reading that once more.
    """
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DF), vocabSize=2**31 - 1)
    model = counter.fit(vocab.select(F.explode(F.array_repeat(F.array("term"), MIN_DF)).alias("terms")))
    entries = F.unwrap_udt(F.col("vector"))
    vectors = model.transform(documents.where("digit >= 0")).select("lang", "source", "digit", entries.alias("v")).select("lang", "source", "digit", "v.indices", "v.values")
    names = model.transform(vocab.select("term", F.array("term").alias("terms"))).select("term", F.unwrap_udt(F.col("vector"))["indices"][0].alias("index"))
    buckets = min(MOST_BUCKETS, -(-(documents.agg(F.sum("n")).first()[0] or 1) // BUCKET))
    return summed(vectors, buckets).join(names, "index").select("lang", "source", "term", "c")


def table_sums(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same from the vocabulary's table, of any size."""
    each = documents.where("digit >= 0").select("lang", "source", F.explode("terms").alias("term"), F.expr("shiftleft(1L, digit)").alias("c"))
    sums = each.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"))
    return sums.join(vocab.select("term"), "term", "left_semi").select("lang", "source", "term", "c")


def share(c: Column, n: Column, v: Column) -> Column:
    whole = lambda x, kind: (F.lit(SCALE).cast(kind) * (x + 1).cast(kind))
    small = F.call_function("div", whole(c, "long"), n + v)
    large = F.floor(F.call_function("div", whole(c, "decimal(19,0)"), (n + v).cast("decimal(20,0)")))
    return (F.when(c < 9_000_000_000, small).otherwise(large) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def sparse_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one chunk of terms and two blocks of sources: each ordered pair's part of D; rows without a term are the groups themselves."""
    f = lambda p, q: (p - q) * (p - q) // q
    heads = pdf[pdf["term"].isna()].drop_duplicates("source")
    sources, absent, blocks = heads["source"].tolist(), heads["p"].to_numpy(np.int64), heads["block"].to_numpy()
    base = heads["v"].to_numpy(np.int64)
    number = {s: i for i, s in enumerate(sources)}
    held = pdf[pdf["term"].notna()]
    own = held["source"].map(number).to_numpy(np.int64)
    order = np.argsort(own, kind="stable")
    own, share_of = own[order], held["p"].to_numpy(np.int64)[order]
    codes, names = pd.factorize(held["term"].to_numpy()[order])
    bounds = np.searchsorted(own, np.arange(len(sources) + 1))
    present = np.flatnonzero(np.diff(bounds))  # sources with entries here
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    out: list[tuple[str, str, int, int]] = []
    for g, source in enumerate(sources):
        others = np.flatnonzero((blocks == (y if blocks[g] == x else x)) & (np.arange(len(sources)) != g))
        if not len(others):
            continue
        nothing = f(absent[g], absent)
        mine = slice(bounds[g], bounds[g + 1])
        values, times = np.unique(share_of[mine], return_counts=True)
        total = ((f(values[:, None], absent[None, :]) - nothing[None, :]) * times[:, None]).sum(axis=0)
        at = np.full(len(names), absent[g])
        at[codes[mine]] = share_of[mine]
        p = at[codes]
        if len(present):
            total[present] += np.add.reduceat(f(p, share_of) - f(p, absent[own]), bounds[present])
        out += [(source, sources[h], int(total[h]), int(base[g] * nothing[h])) for h in others]
    lang = pdf["lang"].iloc[0]
    kinds = {"lang": object, "source": object, "item": object, "part_sum": np.int64, "base": np.int64}
    return pd.DataFrame({c: pd.Series([(lang, *r)[i] for r in out], dtype=kind) for i, (c, kind) in enumerate(kinds.items())})


def pairs(groups: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chunks = entries.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("chunks"))
    # a table of its own, so that its size is known and the rows of a very common lang need not meet
    plan = scratch.keep(sizes.join(chunks, "lang", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))))
    heads = groups.join(plan, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1)))).otherwise(1).alias("p"), "v", "blocks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    held = entries.join(plan, "lang").select("lang", "source", "term", "p", F.lit(0).cast("long").alias("v"), "blocks", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = heads.unionByName(held).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = dealt.select("lang", "source", "term", "p", "v", "chunk", "block", F.explode(met).alias("m")).select("lang", "chunk", "m.x", "m.y", "source", "term", "p", "v", "block")
    found = dealt.groupBy("lang", "chunk", "x", "y").applyInPandas(sparse_pairs, "lang string, source string, item string, part_sum long, base long")
    return found.groupBy("lang", "source", "item").agg((F.sum("part_sum") + F.first("base")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module's docstring; part ``pair`` ranks sources, part ``term`` the terms a source holds above its lang."""
    with Scratch() as scratch:
        documents = scratch.keep(terms_of(docs))
        vocab = scratch.keep(vocabulary(documents))
        n_terms = vocab.count()
        sums = scratch.keep((vector_sums if n_terms <= MAX_TERMS else table_sums)(documents, vocab))
        there = documents.where("digit = 0").select("lang", "source").distinct()
        sizes = sums.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        kept = scratch.keep(vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v")))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        groups = scratch.keep(there.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", zero("n"), zero("v")))
        entries = sums.join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("v"))).select("lang", "source", "term", "c", "p", "v")
        entries = scratch.keep(entries)
        whole = scratch.keep(groups.groupBy("lang").agg(F.sum("n").alias("all"), F.max("v").alias("v")))
        totals = sums.groupBy("lang", "term").agg(F.sum("c").alias("t")).join(whole, "lang").select("lang", "term", share(F.col("t"), F.col("all"), F.col("v")).alias("q"))
        above = entries.join(totals, ["lang", "term"]).where("p > q")
        bare = F.substring_index("term", " ", -1)
        terms = above.select("lang", "source", F.lit("term").alias("part"), bare.alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        both = pairs(groups, entries, scratch).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS).unionByName(both.withColumn("rank", F.row_number().over(order)))
        return Stored(ranked).df


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


#: Whole counts for every group and kept term, absent ones too, and every pair over every term.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, term, count(*) AS c FROM e SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN s USING (lang, source) GROUP BY lang, source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (n.n + v.v) AS BIGINT) AS p
      FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source, term)),
t AS (SELECT lang, term, sum(c) AS c FROM s GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (t.c + 1) // (m.n + v.v) AS BIGINT) AS q
      FROM t JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m USING (lang) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""
