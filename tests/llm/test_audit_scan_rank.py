import math
import random
import re
from collections import Counter

from quarry.llm import divergence as dv
from quarry.llm import lexical as lx
from quarry.llm import license_scan as ls
from tests.llm.conftest import DOCS, by_sql, prose


def plain(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def sourced(seed=1, n=120):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("x", "Y", "é", "ß", "中")] + ["K\u212a", "don't", "a1b"]
    rows = [(i, " ".join(rnd.choice(words[: 5 + i % 30]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None, "ß", "z"]), 1) for i in range(n)]
    return rows + [(1, None, "fr", "only", 0), (2, "alone here", "fr", "other", 0), (3, "123 --", "it", "one", 0)] + rows[:3]


def brute_audit(rows):
    docs = [(lang or "", source or "", plain(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = [t for t in df if df[t] >= 3]
        groups = {s: Counter(t for _, x, w in own if x == s for t in w if df[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (c.total() + len(kept))
        f = lambda x, y: (x - y) * (x - y) // y
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= 200}
    return out


def test_audit_equals_brute_force_and_sql_however_it_is_dealt(spark, folder, monkeypatch):
    rows = sourced()
    path, expected = folder(documents=table(spark, rows)), brute_audit(rows)
    got = lambda: {tuple(r) for r in dv.op11_query(spark, path).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got() == expected
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in by_sql(path, dv.ORACLE, "documents")} == expected
    monkeypatch.setattr(dv, "BLOCK", 2)
    monkeypatch.setattr(dv, "ENTRIES", 7)
    monkeypatch.setattr(dv, "HELD", 5)
    monkeypatch.setattr(dv, "BUCKET", 50)
    assert got() == expected
    monkeypatch.setattr(dv, "MAX_TERMS", 3)  # a vocabulary too large for a model
    assert got() == expected


def test_terms_are_counted_before_they_are_handed_on(spark):
    rows = [(i, "one two two", "en", "s", 1) for i in range(1000)] + [(2000, None, "en", "t", 0)]
    found = dv.terms_of(table(spark, rows).coalesce(1)).collect()
    assert sum(len(r.terms) for r in found) <= 30  # by digit, not by occurrence
    assert {(r.source, r.n) for r in found if r.digit == 0} == {("s", 3000), ("t", 0)}
    totals = Counter()
    for r in found:
        totals.update({(r.source, t): 1 << r.digit for t in r.terms} if r.digit is not None else {("df", t): c for t, c in zip(r.terms, r.df)})
    assert totals == {("s", "en one"): 1000, ("s", "en two"): 2000, ("df", "en one"): 1000, ("df", "en two"): 1000}


def test_audit_of_odd_rows_and_an_empty_table(spark, odd, empty, clashing):
    assert dv.audit(empty).count() == 0
    out = dv.audit(odd).collect()
    assert {(r.lang, r.source) for r in out if r.part == "pair"} == {("en", "a"), ("en", "b"), ("en", "c")}
    assert dv.audit(clashing).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_are_exact_where_longs_are_too_short(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 77), (8, 9, 1)], "c long, n long, v long")
    got = [r[0] for r in df.select(dv.share(dv.F.col("c"), dv.F.col("n"), dv.F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in ((10**13, 3 * 10**13, 77), (8, 9, 1))]


LICENSED = [
    "Released under the MIT License.", "licensed under CC-BY-NC 4.0", "Apache License, Version 2.0; under the MIT license under the mit  LICENSE", "mit under the license", "All rights reserved.", "all the rights are reserved",
    "This work is licensed under the GNU General Public License, version 3.", "Redistribution and use in source or binary forms, with or without change, are permitted provided that following conditions are met", "", None,
]


def licence_rows():
    rnd, out = random.Random(4), []
    for i in range(150):
        t = rnd.choice(ls.TEMPLATES).text.split()
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice([[], ["other"], [t[at], "more"]])
        out.append(prose(i, rnd.choice([0, 3, 200])) + " " + " ".join(t) + ".\n" + prose(i + 999, rnd.choice([0, 50])))
    out += [f"{prose(i, 20)}\n{x}" if x else x for i, x in enumerate(LICENSED)] + ["all of " * 3000 + "rights reserved " * 2000 + "all"]
    return [(i, t, "en", "s", 1) for i, t in enumerate(out)]


def brute_scan(text):
    words = plain(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    places = [(i, label) for label, p in ls.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    blocks = set()
    for t in ls.TEMPLATES:
        own = set(t.words)
        for b in range(len(words) // t.width + 1):
            n = len(own & set(words[b * t.width : (b + 2) * t.width]))
            if n >= t.need:
                blocks.add((t.label, t.width, b, n / len(own)))
    base, labels = {x[1] for x in places}, {x[1] for x in places} | {b[0] for b in blocks}
    at = [p[0] for p in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else max((b[3] for b in blocks), default=0.0), len(blocks))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")


def test_scan_equals_brute_force_and_sql(spark, folder):
    rows = licence_rows()
    path = folder(documents=table(spark, rows))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ls.op12_query(spark, path).collect()}
    assert got == {r[0]: brute_scan(r[1]) for r in rows}
    assert got == {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in by_sql(path, ls.ORACLE, "documents")}
    assert sum(bool(x[5]) for x in got.values()) > 60 and sum(not x[5] for x in got.values()) > 10


def test_scan_finds_its_licences_and_leaves_others(spark):
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(LICENSED)])
    labels = [r.labels for r in ls.labelled(docs).orderBy("doc_id").collect()]
    assert labels == ["mit", "cc-by-nc", "apache-2,mit", "", "all-rights-reserved", "all-rights-reserved", "gpl", "bsd", "", ""]


def test_overlapping_places_of_other_phrases_all_count(spark):
    docs = table(spark, [(1, "a b a b a b a", "en", "s", 1)])
    rows, found = ls.scan(docs, [("x", "a b a")], [ls.Template("t", "a b a")])
    assert rows.select("places.p0").first()[0] == [0, 2, 4] and found.count() >= 1


def test_scan_of_odd_rows_and_an_empty_table(spark, odd, empty, clashing):
    assert ls.labelled(empty).count() == 0
    assert ls.labelled(odd).count() == odd.count() and ls.labelled(clashing).count() == 30
    assert {r.n_words for r in ls.labelled(odd).where("doc_id IN (2, 3, 4)").collect()} == {0}


ITEMS = "item_id long, text string"


def brute_search(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    own = [(i, Counter(plain(t, pattern))) for i, t, *_ in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain(t, pattern))
    out = {}
    for i, terms in asked.items():
        scores = []
        for d, c in own:
            m = 10 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        if scores:
            out[i] = [(k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:10], 1)]
    return out


def search_tables(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(f"w{min(rnd.randrange(300), rnd.randrange(300))}" for _ in range(rnd.choice([1, 5, 60, 300]))), "en", "s", 1) for i in range(900)]
    docs += [(2000 + i, docs[7][1], "en", "s", 1) for i in range(300)] + [(None, docs[7][1], "en", "s", 1), docs[5], docs[5], (3000, None, None, None, None), (3001, "é É", "fr", "s", 1), (3002, "!!", "fr", "s", 1)]
    docs += [(4000, " ".join(f"w{i % 300}" for i in range(30_000)), "en", "s", 1)]
    items = [(i, " ".join(f"W{rnd.randrange(320)}" for _ in range(rnd.choice([1, 3, 25])))) for i in range(70)] + [(90, "é zzz"), (91, "nothing here"), (92, None), (93, ""), (None, "w1 w2"), (94, docs[7][1]), (94, "w299"), (3, "w1")]
    return docs, items


def test_search_equals_brute_force_and_sql_however_it_is_cut(spark, folder, monkeypatch):
    docs, items = search_tables(spark)
    path, expected = folder(documents=table(spark, docs), benchmark=spark.createDataFrame(items, ITEMS)), brute_search(docs, items)

    def got():
        out = {}
        for r in lx.op13_query(spark, path).collect():
            out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
        return {k: sorted(v) for k, v in out.items()}

    assert got() == expected
    monkeypatch.setattr(lx, "TREE_DOCS", 150)
    monkeypatch.setattr(lx, "TREE_ENTRIES", 2_000)
    monkeypatch.setattr(lx, "LEAF", 4)
    monkeypatch.setattr(lx, "SHARE", 3_000)
    assert got() == expected
    monkeypatch.setattr(lx, "PAIRS", 100)
    monkeypatch.setattr(lx, "TOGETHER", 3)
    assert got() == expected


def test_search_equals_its_sql(spark, folder):
    rows = [(i, prose(i, 5 + i % 90, 200), "en", "s", 1) for i in range(300)]
    path = folder(documents=table(spark, rows), benchmark=spark.createDataFrame([(i, prose(i * 3, 12, 200)) for i in range(40)], ITEMS))
    names = ("item_id", "rank", "doc_id", "score")
    assert {tuple(r[c] for c in names) for r in lx.op13_query(spark, path).collect()} == {tuple(r[c] for c in names) for r in by_sql(path, lx.ORACLE, "documents", "benchmark")}


def test_no_document_exceeds_the_bound_of_a_node_and_subtrees_are_left(monkeypatch):
    monkeypatch.setattr(lx, "LEAF", 8)
    np, rng = lx.np, lx.np.random.default_rng(2)
    rows = []
    for i in range(600):
        cols = np.unique(rng.integers(0, 30, 12) + 30 * (i % 6))  # six kinds of documents
        rows.append((cols, rng.integers(1, 10**6, len(cols))))
    docs = lx.Docs(np.arange(600), np.zeros(600, bool), np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    tree = lx.Tree(docs, 180)
    queries = np.zeros((12, 180), np.int64)
    for q in range(12):
        queries[q, 30 * (q % 6) : 30 * (q % 6) + 30] = rng.integers(0, 20_000, 30)
    bounds, seen = tree.bounds(queries), []
    monkeypatch.setattr(lx.Tree, "leaf", lambda self, node, query, leaf=lx.Tree.leaf: seen.append(node) or leaf(self, node, query))
    for query, bound in zip(queries, bounds):
        scores = np.array([int(query[c] @ x) for c, x in rows])
        for node in range(len(tree.lo)):
            assert scores[tree.docs.ids[tree.lo[node] : tree.hi[node]]].max() <= bound[node]
        best = []
        tree.search(query, bound, best, 1, False)
        assert sorted(best, reverse=True) == sorted(((int(s), True, -i) for i, s in enumerate(scores) if s), reverse=True)[:10]
    assert len(seen) < 0.4 * 12 * sum(not c for c in tree.child)


def test_search_of_odd_rows_and_empty_tables(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, prose(2, 20)), (2, "bob smith")], ITEMS + "")
    none = spark.createDataFrame([], ITEMS)
    assert lx.search(empty, items).count() == 0 and lx.search(odd, none).count() == 0
    assert {r.doc_id for r in lx.search(odd, items).where("item_id = 2").collect()} == {9}
    assert lx.search(clashing, items).count() > 0
