"""Personal data by candidate gradient boosting.

Base spans come from fixed formats and always count. High-recall generators propose further, overlapping spans; boosted trees rate
each one by the words around it and by what it looks like once its format is masked; spans over a threshold that was calibrated on
held-out documents are added where they overlap nothing already chosen.

The trees learn from all candidates as from positive and unlabelled ones. Candidates with equal features are counted, and trees, bars,
calibration and thresholds need sums of those counts alone; where more than HELD differ, tasks sum them over the table, with the same
result. A candidate that coincides with a base span is a positive. One that overlaps a base span of another kind is a negative. Any other is unlabelled, as it
may be personal data in a format that no base pattern reads: it counts as a negative only where first trees, which were given a part
of the positives as unlabelled (spies), rate it below nearly all spies of its kind; the rest is left out of learning and calibration.
Features must not tell a base format from another, so signs for '@' and '.', a phone's '+' and country code, and a card's or an
address's separators are masked. The check digit of a card and the range of an IP's numbers stay: they are no format, a number that
fails them is no card or IP however it is written.

One pass over whole texts finds base spans and candidates; it is written once, without the texts, and the trees are fitted on and
applied to that table.

Defined cases: a null text counts as empty; offsets are code points, ends exclusive; with too few candidates to train on, base
spans alone are returned; rows that repeat are searched each for itself; extra columns pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.boosting import LIMIT, UNIT, BoostedTrees, Rows, edges_of, grow, quantiles
from quarry.llm.common import ROW, packed, read_table, unpacked, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates that differ in features, standing or half, of which the driver may hold so many while trees grow; more stay in a table.
HELD = 200_000
#: The precision that held-out candidates over a kind's threshold must show, as a lower bound.
PRECISION = 0.97
#: One of so many positives is a spy; an unlabelled candidate is a negative if its rate is under this quantile of its kind's spies.
SPIES, QUANTILE = 5, 0.05
#: How a candidate meets the base spans.
FREE, BASE, OTHER_KIND, SAME_KIND = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")

#: Generators: an address with a sign or a word in brackets for it, with or without a domain's end; one in words alone; digits in groups.
#: Every repeat is bounded.
_DOT = r"(?:\.|[\x20]?[\[(](?:dot|punkt|point|punto)[\])][\x20]?|[\x20](?:dot|punkt|point|punto)[\x20])"
_ADDRESS = re.compile(rf"[\w.%+-]{{1,64}}(?:@|[\x20]?[\[(](?:at|arobase|arroba)[\])][\x20]?)[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{0,5}}", re.IGNORECASE)
_SPOKEN = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}[\x20](?:at|arobase|arroba)[\x20][\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,5}}", re.IGNORECASE)
_SIGN = re.compile(r"@|[\[(](?:at|arobase|arroba)[\])]", re.IGNORECASE)
_WORD_FOR_AT = re.compile(r"[\x20](?:at|arobase|arroba)[\x20]", re.IGNORECASE)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){5,24}")
_ANY_AT = re.compile(r"@|[\x20]?[\[(](?:at|arobase|arroba)[\])][\x20]?|[\x20](?:at|arobase|arroba)[\x20]", re.IGNORECASE)
_ANY_DOT = re.compile(_DOT, re.IGNORECASE)
#: A country code, as '+1 ', '001 ' or '1 '.
_PREFIX = re.compile(r"(?:(?:\+|00)[0-9]{1,3}|1)(?=[\x20(.\-/])[\x20.\-/]*")
#: Words near a span that speak for a kind, in the languages at hand.
CUES = (
    re.compile(r"mail|contact|kontakt|correo|courriel|write|schreib"),
    re.compile(r"\bip\b|host|server|serveur|servidor|address|adresse"),
    re.compile(r"card|karte|carte|tarjeta|visa|credit|pay|zahl"),
    re.compile(r"phone|tel|call|fax|mobil|ruf|appel|llam"),
)
FEATURES = 21


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, leftmost and without overlap within each kind; what fails its test is dropped."""
    found = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, EMAIL, m.end()))
            used = m.end()
            at = text.find("@", used)
        else:
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), PHONE, m.end()))
    found.sort()
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that a generator proposes; spans may overlap."""
    found = []
    if _SIGN.search(text):
        found += [(m.start(), EMAIL, m.end()) for m in _ADDRESS.finditer(text)]
    if _WORD_FOR_AT.search(text):
        found += [(m.start(), EMAIL, m.end()) for m in _SPOKEN.finditer(text)]
    for m in _NUMBER.finditer(text) if _DIGIT.search(text) else ():
        digits = sum(c.isdigit() for c in m[0])
        if m[0].count(".") == 3 and digits <= 12:
            found.append((m.start(), IP, m.end()))
        if digits >= 11:
            found.append((m.start(), CARD, m.end()))
        if 7 <= digits <= 15:
            found.append((m.start(), PHONE, m.end()))
    return found + swallowed(text)


def swallowed(text: str) -> list[tuple[int, int, int]]:
    """Cards in longer runs of digit groups, which the base pattern reads as one number and drops: whole groups next to one another whose check digit is right."""
    found = []
    for m in _CARD.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() < 13:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _DIGITS.finditer(m[0])]
        if len(groups) < 2:
            continue
        for i, (start, _) in enumerate(groups):
            digits = ""
            for a, end in groups[i:]:
                digits += text[a:end]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and (start, end) != m.span() and luhn(digits):
                    found.append((start, CARD, end))
    return found


def masked(span: str, kind: int) -> str:
    """The span as it would look in any format: what only a base pattern asks for is gone."""
    if kind == EMAIL:
        return _ANY_DOT.sub(".", _ANY_AT.sub("@", span, count=1))
    if kind == PHONE:
        return _PREFIX.sub("", span).lstrip("+")
    return _NOT_DIGIT.sub(" ", span)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """What a masked span and its neighbourhood look like; no feature tells whether it is a base span."""
    span = masked(text[start:end], kind)
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    side = lambda c: 0.0 if not c or c.isspace() else 3.0 if c.isdigit() else 2.0 if c.isalpha() else 1.0
    numbers = [int(g) for g in span.split() if len(g) < 6] if kind == IP else []
    name, _, domain = span.partition("@") if kind == EMAIL else ("", "", "")
    labels = domain.split(".")
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(kind == PHONE and span.count(" ")),
        float(kind == PHONE and sum(map(span.count, ".-/"))), float("(" in span), float(kind == CARD and 12 <= len(digits) <= 19 and luhn(digits)), float(max(numbers, default=0)),
        float(len(name)), float(len(labels)), float(len(labels[-1]) if labels[-1].isalpha() else 0), side(text[start - 1 : start] if start else ""), side(text[end : end + 1]),
        *[float(bool(c.search(before)) + bool(c.search(after))) for c in CUES], float(kind == CARD and digits[:1] or 0),
    ]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def standing(span: tuple[int, int, int], own: list[list[tuple[int, int]]]) -> int:
    """How a candidate meets the base spans, which are given as (start, end) in order for each kind."""
    start, kind, end = span
    over = []
    for k, spans in enumerate(own):
        at = bisect_left(spans, (end, 0)) - 1
        if at >= 0 and spans[at][1] > start:
            if k == kind:
                return BASE if spans[at] == (start, end) else SAME_KIND
            over.append(k)
    return OTHER_KIND if over else FREE


_FOUND = T.StructType(
    [T.StructField("_base", T.ArrayType(T.IntegerType())), T.StructField("_more", T.ArrayType(T.IntegerType())), T.StructField("_features", T.ArrayType(T.FloatType()))]
)


def find(texts: DataFrame) -> DataFrame:
    """texts (text, doc_id and what goes along) without text, with base spans and candidates, as flat lists of start, kind, end (candidates: and how they meet the base spans) and of features."""
    at = texts.columns.index("text")
    kept = [i for i in range(len(texts.columns)) if i != at]
    schema = T.StructType([texts.schema.fields[i] for i in kept] + _FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more, rated = [], [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                own = base_spans(text)
                known = [[(a, b) for a, k, b in own if k == kind] for kind in range(len(KINDS))]
                base.append([x for s in own for x in s])
                spans, rows = [], []
                for s in candidates(text):
                    spans += [*s, standing(s, known)]
                    rows += features(text, *s)
                more.append(spans)
                rated.append(rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(base, pa.list_(pa.int32())), pa.array(more, pa.list_(pa.int32())), pa.array(rated, pa.list_(pa.float32()))], schema.names)

    return texts.mapInArrow(run, schema)


def each_candidate(found: DataFrame) -> DataFrame:
    """(h, half, spy, stands, x) of every candidate that may be learnt from; a document's candidates are in one half."""
    of = F.transform(F.sequence(F.lit(0), F.floor(F.size("_more") / 4).cast("int") - 1), lambda i: F.struct(F.slice("_more", 4 * i + 1, F.lit(4)).alias("more"), F.slice("_features", FEATURES * i + 1, F.lit(FEATURES)).alias("x")))
    each = found.where(F.size("_more") > 0).select("doc_id", F.explode(of).alias("c")).where(F.col("c.more")[3] != SAME_KIND)
    spy = (F.pmod(F.xxhash64(F.lit(2), "doc_id", "c.more"), F.lit(SPIES)) == 0) & (F.col("c.more")[3] == BASE)
    return each.select(F.xxhash64("doc_id", "c.more").alias("h"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).alias("half"), spy.alias("spy"), F.col("c.more")[3].alias("stands"), "c.x")


def drawn(found: DataFrame, limit: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, standing and half of at most limit candidates, all of equal chance: for a look at them, nothing is learnt from these."""
    rows = each_candidate(found).orderBy("h", "stands", "half", "x").limit(limit).collect()
    return np.array([r.x for r in rows], np.float64).reshape(-1, FEATURES), np.array([r.stands for r in rows], int), np.array([r.half for r in rows], int)


class Halves:
    """Trees of each half of the documents; a span must be rated by both."""

    def __init__(self, models: list[BoostedTrees]):
        self.models = models

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([m.probability(x) for m in self.models])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Rows:
    half, spy, stands, x, n = (batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy() for i in range(5))
    x = np.stack(x).astype(np.float64) if len(x) else np.zeros((0, FEATURES))
    return Rows(x, n.astype(np.int64), half=half.astype(int), spy=spy.astype(bool), stands=stands.astype(int), kind=x[:, 0].astype(int))


def summing(counted: DataFrame) -> Callable:
    """total(f): the sum of f(rows), an array of whole numbers, over all rows of the table; on the driver where they are no more than HELD, else by tasks."""
    if counted.count() <= HELD:
        rows = rows_of(counted.toArrow())
        return lambda f: f(rows)
    none = rows_of(pa.RecordBatch.from_pylist([], counted.limit(0).toArrow().schema))

    def total(f: Callable) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = 0
            for batch in batches:
                sums = sums + f(rows_of(batch))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([np.ravel(sums)[at].tobytes()], pa.binary())], ["at", "sums"])

        out = np.zeros(np.shape(f(none)), np.int64)
        for r in counted.mapInArrow(run, "at binary, sums binary").collect():
            out.ravel()[np.frombuffer(r.at, np.int64)] += np.frombuffer(r.sums, np.int64)
        return out

    return total


def negatives(rows: Rows, first: BoostedTrees, bars: np.ndarray) -> np.ndarray:
    return (rows.stands == OTHER_KIND) | ((rows.stands == FREE) & (rows.margin(first) < bars[rows.kind]))


def margins(rows: Rows, model: BoostedTrees, used: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """How many of the rows used have each margin, by kind and by what else is given, which is 0 or 1."""
    out = np.zeros((len(KINDS), *[2 for _ in by], 2 * LIMIT + 1), np.int64)
    np.add.at(out, (rows.kind[used], *[x[used].astype(int) for x in by], rows.margin(model)[used] + LIMIT), rows.n[used])
    return out


def train(found: DataFrame) -> tuple[Halves, list[float]] | None:
    """The trees and each kind's threshold, from all candidates: the trees of each half are calibrated on the other.

    Trees are grown over positives and sure negatives; first trees and each kind's bar, under which they call an unlabelled candidate a
    negative, come before. A threshold shows the precision among held-out positives and sure negatives, and is not under PRECISION, or what
    nearly all held-out positives reach if that is less.
    """
    counted = written(each_candidate(found).groupBy("half", "spy", "stands", "x").agg(F.count(F.lit(1)).alias("n")))
    total, halves = summing(counted), range(2)

    def sizes(rows: Rows) -> np.ndarray:
        own = [rows.half == i for i in halves]
        return np.array([[rows.n[o].sum(), rows.n[o & (rows.stands == BASE)].sum(), rows.n[o & (rows.stands == BASE) & ~rows.spy].sum()] for o in own], np.int64)

    sized = total(sizes)
    if sized[:, 0].sum() < 40 or (sized[:, 2] == 0).any() or (sized[:, 1] == sized[:, 0]).any():
        return None
    values = [[] for _ in range(FEATURES)]
    for r in counted.select(F.posexplode("x").alias("j", "value"), "n").groupBy("j", "value").agg(F.sum("n").alias("n")).collect():
        values[r.j].append((r.value, r.n))
    edges = [edges_of(*np.array(v, np.float64).T) for v in values]
    first = [BoostedTrees() for _ in halves]
    grow(first, edges, total, lambda rows, i: (rows.half == i, (rows.stands == BASE) & ~rows.spy))
    place, bars = np.arange(-LIMIT, LIMIT + 1), np.full((2, len(KINDS)), -np.inf)
    spies = total(lambda rows: np.stack([margins(rows, first[i], rows.spy & (rows.half == i)) for i in halves]))
    for i, kind in np.argwhere(spies.any(axis=2)):
        bars[i, kind] = quantiles(place.astype(float), spies[i, kind], QUANTILE)
    known = lambda rows, i: (rows.stands == BASE) | negatives(rows, first[i], bars[i])
    used = total(lambda rows: np.array([[rows.n[o].sum(), rows.n[o & (rows.stands == BASE)].sum()] for o in ((rows.half == i) & known(rows, i) for i in halves)], np.int64))
    if (used[:, 0] == used[:, 1]).any():
        return None
    models = [BoostedTrees() for _ in halves]
    grow(models, edges, total, lambda rows, i: ((rows.half == i) & known(rows, i), rows.stands == BASE))
    held = total(lambda rows: np.stack([margins(rows, models[i], (rows.half != i) & known(rows, i), rows.stands == BASE) for i in halves]))
    if (held.sum(axis=(1, 3)) == 0).any():
        return None
    p, y, n, kinds = [], [], [], []
    for model, own in zip(models, held):
        kind, met, at = np.nonzero(own)
        m, many = place[at] / UNIT, own[kind, met, at]
        model.calibrate_margins(m, met.astype(float), many.astype(float))
        p, y, n, kinds = [*p, model.rated(m)], [*y, met], [*n, many], [*kinds, kind]
    p, y, n, kinds = map(np.concatenate, (p, y, n, kinds))
    thresholds = []
    for kind in range(len(KINDS)):
        own, met = kinds == kind, (kinds == kind) & (y > 0)
        thresholds.append(max(threshold(p[own], y[own], n[own]), min(float(quantiles(p[met], n[met], QUANTILE)), PRECISION)) if met.any() else 2.0)
    return Halves(models), thresholds


def threshold(p: np.ndarray, y: np.ndarray, times: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability over which the lower bound (Wilson, 95 %) of precision holds; 2, over all, where none does. Each p stands for as many as times says."""
    rates, at = np.unique(-p, return_inverse=True)
    hits, n, z = np.cumsum(np.bincount(at, times * y)), np.cumsum(np.bincount(at, times)), 1.645
    share = hits / n
    low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = np.flatnonzero(low >= precision)
    return float(-rates[good[-1]]) if len(good) else 2.0


def select(found: DataFrame, model: tuple[Halves, list[float]] | None) -> DataFrame:
    """found with n_email, n_ip, n_card, n_phone, base_sha256 and spans; added spans are the most probable first, each clear of those before."""
    inner = [found.columns.index(c) for c in ("_base", "_more", "_features")]
    kept = [i for i in range(len(found.columns)) if i not in inner]
    schema = T.StructType([found.schema.fields[i] for i in kept] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more, rated = (batch.column(i).to_pylist() for i in inner)
            p = model[0].probability(np.array([v for r in rated for v in r], np.float64).reshape(-1, FEATURES)) if model else np.zeros(0)
            counts, sha, spans, at = [[] for _ in KINDS], [], [], 0
            for own, proposed in zip(base, more):
                chosen = list(zip(own[0::3], own[1::3], own[2::3]))
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in chosen))
                sha.append(hashlib.sha256(digest(chosen).encode()).hexdigest())
                n = len(proposed) // 4
                if model:
                    rated_now, added = p[at : at + n], []
                    for i in np.argsort(-rated_now, kind="stable"):
                        start, kind, end, stands = proposed[4 * i : 4 * i + 4]
                        if stands == FREE and rated_now[i] >= model[1][kind]:
                            place = bisect_left(added, (end, 0, 0))
                            if not place or added[place - 1][2] <= start:
                                insort(added, (start, kind, end))
                    chosen += added
                at += n
                spans.append(digest(chosen))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())], schema.names)

    return found.mapInArrow(run, schema)


def added(selected: DataFrame) -> DataFrame:
    """One row: documents, base_spans, and added_email, added_ip, added_card, added_phone, which came on top of them."""
    spans = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    of = [F.size(F.filter(F.transform(F.col("_spans"), lambda x: F.substring_index(x, ":", 1)), _same(k))) for k in KINDS]
    return selected.withColumn("_spans", spans).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(sum(F.col(f"n_{k}") for k in KINDS)), F.lit(0)).alias("base_spans"),
        *[F.coalesce(F.sum(n - F.col(f"n_{k}")), F.lit(0)).alias(f"added_{k}") for k, n in zip(KINDS, of)],
    )


def _same(kind: str):
    return lambda x: x == F.lit(kind)


ADDED = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]


def redact(docs: DataFrame) -> DataFrame:
    """docs with every chosen span of its text replaced by its kind in brackets, and the columns that select adds."""
    found = written(find(packed(docs, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))))
    chosen = select(found, train(found)).select(F.col(ROW)["text"].alias("text"), ROW, *ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(0), batch.column(batch.num_columns - 1)):
                text, out, done = text.as_py(), [], 0
                for kind, a, b in (s.split(":") for s in spans.as_py().split(",") if s):
                    if int(b) > done:
                        out += [text[done : max(int(a), done)], f"[{kind}]"]
                        done = int(b)
                texts.append(text if text is None else "".join(out) + text[done:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    return unpacked(chosen.mapInArrow(run, chosen.schema), F.col("text").alias("text"), *[F.col(c) for c in ADDED])


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(find(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return select(found, train(found))
