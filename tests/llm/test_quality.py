import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_resample as q
from quarry.llm import quality_rules as r
from tests.llm.conftest import DOCS, by_sql, prose, untouched

LABELS = "doc_id long, quality int, toxic int"


def good_and_bad(spark, n=120):
    rows = [(i, prose(i, 60, 200) if i % 4 else " ".join(f"z{i}{j}$$$" for j in range(60)), "en", "a", 1) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(n) if i // 4 % 2 == 0]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def plain_weight(text, ratio):
    """The log ratio of the two models over a text's uni- and bigrams, token by token."""
    m, tokens = (1 << 64) - 1, [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    pairs = [0x165667B19E3779F9 if a == b else ((a * 0xC2B2AE3D27D4EB4F) & m) ^ ((b + 0x9E3779B97F4A7C15) & m) for a, b in zip(tokens, tokens[1:])]
    return sum(ratio[(((g * 0x9E3779B97F4A7C15) & m) >> 33) % q.BUCKETS] for g in tokens + pairs)


def test_weights_keys_and_the_sample_equal_a_plain_count(spark, folder):
    docs, labels = good_and_bad(spark)
    rows, told = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    ratio = q.fit(docs, q.target_ids(labels))
    raw, target = Counter(), Counter()
    unit = np.zeros(q.BUCKETS)
    for r in rows:  # counts by weights of one bucket at a time would be slow: the model is recounted from grams
        for found in q.grams(r.text, q._Ids()):
            raw.update(found.tolist())
            if told.get(r.doc_id):
                target.update(found.tolist())
    n, t = sum(raw.values()), sum(target.values())
    prior = min(5.0 * q.BUCKETS, 0.5 * t)
    smooth = [(raw[b] + 0.1) / (n + 0.1 * q.BUCKETS) * prior for b in range(q.BUCKETS)]
    for b in range(q.BUCKETS):
        unit[b] = math.log((target[b] + smooth[b]) / (t + prior)) - math.log((raw[b] + smooth[b]) / (n + prior))
    assert np.allclose(unit, ratio)
    out = {r.doc_id: r for r in q.op1_query(spark, folder(documents=docs, labels=labels)).collect()}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", q.gumbel("doc_id", "text").alias("g")).collect()}
    for r in rows:
        assert out[r.doc_id].log_weight == pytest.approx(plain_weight(r.text, ratio), abs=1e-6)
        assert out[r.doc_id].gumbel_key == pytest.approx(out[r.doc_id].log_weight + noise[r.doc_id])
    k = q.budget(docs, labels)
    assert k == 45 + math.ceil(60 * q.upper_bound(45, 60))
    assert {i for i, r in out.items() if r.kept} == set(sorted(out, key=lambda i: -out[i].gumbel_key)[:k])
    # all good documents are kept, those without a label too; the budget is no cut between the classes, so some bad ones may be
    assert all(out[i].kept for i in out if i % 4) and sum(out[i].kept for i in out if i % 4 == 0) == k - 90


def test_a_budget_ignores_keys_and_counts_rows(spark):
    docs = spark.createDataFrame([(i % 10,) for i in range(100)] + [(99,)] * 50, "doc_id long")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (99, 0, 0), (99, 1, 0), (500, 1, 0)], LABELS)
    assert q.budget(docs, labels) == 20 + math.ceil(70 * q.upper_bound(2, 4))
    assert q.budget(docs, labels.where("quality = 0")) is None


def test_upper_bound_is_exact():
    for good, n in ((0, 10), (5, 60), (45, 60), (59, 60), (3000, 4000)):
        p = q.upper_bound(good, n)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(good + 1))
        assert tail == pytest.approx(1 - q.CONFIDENCE, rel=1e-6)
    assert q.upper_bound(7, 7) == 1.0
    # far more labels than the terms that are felt: the normal distribution's bound is as good there
    n, good = 400_000_000, 300_000_000
    assert abs(q.upper_bound(good, n) - (0.75 + 1.959964 * math.sqrt(0.75 * 0.25 / n))) < 1e-7


def test_classes_are_told_apart_on_rows_without_labels(spark, folder):
    docs, labels = good_and_bad(spark, 2000)
    out = {r.doc_id: r for r in q.op1_query(spark, folder(documents=docs, labels=labels)).collect()}
    free = [i for i in out if i // 4 % 2 and i % 4]
    assert min(out[i].gumbel_key for i in out if i % 4) > max(out[i].gumbel_key for i in out if i % 4 == 0)
    assert all(out[i].kept for i in free)


def test_kth_largest_is_exact(spark):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.gauss(0, 1), 0.25, rnd.gauss(0, 1000)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").cache()
    for k in (1, 2, 500, 1500, 2999, 3000):
        assert q.kth_largest(df, "x", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]


def test_gumbel_top_k_takes_k_and_reruns_agree(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (q.gumbel("id")).alias("gumbel_key"))
    a, b = (q.sampled(df, 300)[0].where("kept").select("doc_id").collect() for _ in range(2))
    assert len(a) == 300 and sorted(a) == sorted(b)
    assert q.sampled(df, 0)[0].where("kept").count() == 0 and q.sampled(df, None)[0].where("kept").count() == 2000


def test_classifier_on_odd_rows_and_empty_tables(spark, odd, empty, folder, clashing):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0), (77, 1, None)], LABELS)
    path = folder(documents=odd, labels=none)
    assert all(row.kept for row in q.op1_query(spark, path).collect())
    kept = q.stage(spark, odd, path)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert q.stage(spark, empty, path).count() == 0
    some = spark.createDataFrame([(i, int(i > 9), 0) for i in range(20)], LABELS)
    assert len(untouched(clashing, q.select(clashing, some))) == q.budget(clashing, some)


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + d for i, w in enumerate(windows) if w in many for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_measures_equal_a_plain_count(spark, odd):
    texts = [None, "", "a b c a b c", "x\nx\n\nx y\n \nx y", "## $ a|b <c>", "a a a a", "é 😀 é 😀 é", "  b\x0bc\x1cd", prose(5, 300, 6), "a b", "a b c"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for row in r.measures(df).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(row.text)
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (10, 3, 0.1), (2000, 5, 0.0075), (100_000, 700, 0.0075), (5, 5, 0.5), (1, 0, 0.3)]
    for n, x, p in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(x + 1))
        got = spark.range(1).select(r.binomial_tail(F.lit(n).cast("long"), F.lit(x).cast("long"), p)).first()[0]
        assert got == pytest.approx(min(exact, 1.0), rel=1e-6)


def test_thresholds_hold_the_risk_and_reject_outliers(spark, folder):
    rows = [(i, prose(i, 60, 5000) + (" # " * 60 if i % 10 == 0 else ""), "en", "a", 1) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 3000)], LABELS)
    path = folder(documents=spark.createDataFrame(rows, DOCS), labels=labels)
    out = {row.doc_id: row.kept for row in r.op9_query(spark, path).collect()}
    good = [k for i, k in out.items() if i % 10]
    assert sum(not k for k in good) <= r.RISK * len(good)
    assert not any(k for i, k in out.items() if i % 10 == 0)


def test_strata_with_few_hundred_labels_get_cutoffs(spark, folder):
    langs = ["en"] * 12 + ["de"] * 2 + ["fr"] * 2 + ["tiny"] * 1
    rows = [(i, prose(i, 60, 5000) + (" # " * 60 if i % 10 == 0 else ""), langs[i // 10 % 17] if i < 3800 else "tiny", "a", 1) for i in range(3800)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(3800)], LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    out = {row.doc_id: row.kept for row in r.op9_query(spark, folder(documents=docs, labels=labels)).collect()}
    for lang in ("en", "de", "fr"):
        good = [out[i] for i, _, own, *_ in rows if own == lang and i % 10]
        bad = [out[i] for i, _, own, *_ in rows if own == lang and i % 10 == 0]
        assert not any(bad) and sum(not k for k in good) <= r.RISK * len(good)
    measured = r.written(r.measures(docs))
    chosen = r.thresholds(measured, labels).collect()
    assert sorted((x.stratum, x.rule) for x in chosen) == sorted((s, rule) for s in ("en", "de", "fr", "tiny") for rule in r.RULES)
    few = labels.where("doc_id < 600")
    assert {x.stratum for x in r.thresholds(measured, few).collect()} == {"en"}


def test_the_first_step_that_fails_ends_the_sequence(spark):
    # three good documents in a hundred have symbols, each more than the one before: a rule may reject none or few, all rules together under 3 %
    rows = [(i, prose(i, 60, 5000) + " #" * (i // 4 % 50 if i % 25 == 3 else 0), "en", "a", 1) for i in range(2000)]
    docs = r.written(r.measures(spark.createDataFrame(rows, DOCS)))
    chosen = r.thresholds(docs, spark.createDataFrame([(i, 1, 0) for i in range(2000)], LABELS))
    kept = [x.kept for x in r.verdicts(docs, chosen).collect()]
    assert chosen.count() == len(r.RULES) and 0 < sum(not k for k in kept) <= r.RISK * len(kept)


def test_rules_on_odd_rows_and_empty_tables(spark, odd, empty, folder):
    path = folder(documents=odd, labels=spark.createDataFrame([(None, None, None), (1, 1, 0)], LABELS))
    out = r.op9_query(spark, path).collect()
    assert len(out) == odd.count() and all(not (row.kept and row.base_failed) for row in out)


def test_verdicts_equal_sql(spark, folder):
    langs = ["en"] * 12 + ["de"] * 4 + [None] * 3 + [""] * 1
    rows = [(i, prose(i, 60 + i % 7, 5000) + (" # " * 60 if i % 10 == 0 else "") + ("\n" + prose(i, 20) + "\n" + prose(i, 20) if i % 35 == 0 else ""), langs[i // 10 % 20], "a", 1) for i in range(3000)]
    rows += [(9000, None, "en", "a", 0), (9001, "", None, "a", 0), (9002, "a b c a b c a b c " * 20, "de", "a", 0), (9003, "x\n\n x\nx y", "xx", "a", 0)]
    labels = [(i, int(i % 10 > 0), 0) for i in range(0, 3000)] + [(1, 0, 0), (5, None, 0), (None, 1, 0), (70_000, 1, 0)]
    path = folder(documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, LABELS))
    got = sorted((x.asDict() for x in r.op9_query(spark, path).collect()), key=lambda x: x["doc_id"])
    expected = sorted(by_sql(path, r.ORACLE, "documents", "labels"), key=lambda x: x["doc_id"])
    assert got == expected
    assert 0 < sum(x["kept"] for x in got) < sum(not x["base_failed"] for x in got)
    measured = r.written(r.measures(spark.createDataFrame(rows, DOCS)))
    assert {x.stratum for x in r.thresholds(measured, spark.createDataFrame(labels, LABELS)).collect()} == {"en", "de", None}  # '' is a stratum of its own, with too few labels


def test_rules_pass_columns_through(spark, clashing):
    out = r.judge(clashing, spark.createDataFrame([], LABELS))
    assert len(untouched(clashing, out)) == 30 and out.columns[-2:] == ["base_failed", "kept"]


def test_rules_on_an_empty_table(spark, empty, folder):
    assert r.op9_query(spark, folder(documents=empty, labels=spark.createDataFrame([], LABELS))).count() == 0
