import itertools
import random
import time

from quarry.llm import line_dedup as ld
from quarry.llm import near_dedup as nd
from tests.llm.conftest import DOCS, prose, untouched


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(docs):
    out, before = {}, []
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0] or 0)):
        out[doc_id] = []
        for i, line in enumerate(text.split("\n")):
            if not line.strip(" \t\n\x0b\x0c\r"):
                continue
            if any(line == b or (min(len(line), len(b)) >= ld.MIN_NEAR and edits(line, b) <= 1) for b in before):
                out[doc_id].append(i)
            before.append(line)
    return out


def changed(rnd, line):
    at, how = rnd.randrange(len(line)), rnd.randrange(4)
    return [line[:at] + line[at + 1 :], line[:at] + rnd.choice("abé") + line[at:], line[:at] + rnd.choice("abé") + line[at + 1 :], line + "x"][how]


def test_dropped_lines_equal_brute_force(spark, folder):
    rnd = random.Random(5)
    base = [prose(i, rnd.choice([5, 6, 7, 12]), 50) for i in range(12)] + ["ab", "x" * 25, "y" * 19, "é" * 30, "a" * 1500 + "b" * 300]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            line = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                line = changed(rnd, line)
            lines.append(rnd.choice([line, line, " ", ""]))
        docs.append((d, "\n".join(lines), "en", "s", 1))
    path = folder(documents=spark.createDataFrame(docs, DOCS))
    got = {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in ld.op3_query(spark, path).collect()}
    assert got == brute_lines([d[:2] for d in docs])


def test_line_dedup_rewrites_texts(spark):
    docs = spark.createDataFrame([(1, "keep me\n\nother", "en", "s", 14), (2, "keep me\nnew", "en", "s", 11), (3, "keep me\nother\n", "en", "s", 14), (4, "", "en", "s", 0), (5, None, "en", "s", 0)], DOCS)
    out = {r.doc_id: (r.text, r.n_chars) for r in ld.dedup(docs).collect()}
    assert out == {1: ("keep me\n\nother", 14), 2: ("new", 3), 4: ("", 0), 5: (None, 0)}


def test_a_text_of_very_many_lines_takes_as_long_as_it_is(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "\n".join(["the same line again and again"] * n), "en", "s", 1), (2, "\n".join(f"{i * 7919:x}" for i in range(n)), "en", "s", 1)], DOCS)
    began = time.time()
    out = {r.doc_id: len(r.text) for r in ld.dedup(docs).collect()}
    assert time.time() - began < 60 and out == {1: 29, 2: len("\n".join(f"{i * 7919:x}" for i in range(n)))}


def test_line_dedup_on_odd_rows_and_an_empty_table(spark, odd, empty, clashing):
    untouched(clashing, ld.dedup(clashing), but=("text", "n_chars"))
    out = ld.dedup(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 2 and 6 not in ids and None in ids and 2 in ids and 3 in ids and 4 in ids
    assert ld.dedup(empty).count() == 0


def brute_classes(docs):
    ids = nd._Ids()
    seqs = {d: nd.word_ids(t, ids) for d, t in docs}
    top = {d: d for d, _ in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(seqs), 2):
        if len(seqs[a]) and len(seqs[b]) and nd.similar(seqs[a], seqs[b]):
            top[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in top}


def test_classes_equal_brute_force(spark, folder):
    rnd, docs = random.Random(7), []
    passage = prose(99, 70)
    for g in range(25):
        words = prose(g, rnd.choice([20, 60, 150, 400])).split()
        for _ in range(rnd.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, len(copy) // 50, len(copy) // 25])):
                copy[rnd.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
    docs += [f"{prose(500 + i, 20)} {passage}" for i in range(30)]  # one passage in many documents that differ
    docs += [" ".join(passage.split()[:i] + [f"u{i}"] + passage.split()[i + 1 :]) for i in range(0, 70, 2)]  # a large group of near copies
    docs += ["a b", "a b", "A  b", "c", "", " "]
    rnd.shuffle(docs)
    rows = list(enumerate(docs))
    path = folder(documents=spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    got = {r.doc_id: r.class_id for r in nd.op7_query(spark, path).collect()}
    assert got == brute_classes(rows)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_plain_dynamic_programming(monkeypatch):
    rnd, linked = random.Random(3), 0
    for strip in (8192, 7):
        monkeypatch.setattr(nd, "STRIP", strip)
        for _ in range(150):
            a = [rnd.randrange(12) for _ in range(rnd.randrange(1, 40))]
            b = list(a)
            for _ in range(rnd.choice([0, 1, 2, 4, 12])):
                at, how = rnd.randrange(len(b) + 1), rnd.randrange(3)
                b[at : at + (how > 0)] = [rnd.randrange(12)] if how < 2 else []
            m = plain_common(a, b)
            x, y = (nd.np.array(v, nd.np.uint32) for v in (a, b))
            assert not b or nd.common(x, y) == m
            assert nd.similar(x, y) == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9 and m > 0)
            linked += nd.similar(x, y)
    assert 50 < linked < 290


def test_alignment_minds_order():
    ids = nd._Ids()
    seq = lambda t: nd.word_ids(t, ids)
    a, b = prose(1, 100, 10_000), prose(2, 100, 10_000)
    assert nd.similar(seq(f"{a} {b}"), seq(f"{a} {b} more"))
    assert not nd.similar(seq(f"{a} {b}"), seq(f"{b} {a}"))


def test_near_copies_by_length_and_share_of_words_replaced(spark):
    """Planted near copies: at least nine of ten are found at each length and rate, and nothing else is linked."""
    rnd, rows, of = random.Random(11), [], {}
    for length in (20, 50, 200, 2000):
        for percent in (1, 2, 5):
            for _ in range(25):
                words = prose(len(rows), length, 5_000).split()
                rows.append((len(rows), " ".join(words)))
                for at in rnd.sample(range(length), max(1, length * percent // 100)):
                    words[at] = f"new{len(rows)}x{at}"
                of[len(rows)] = (length, percent)
                rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = {r.doc_id: r.kept_id for r in nd.classes(docs.select("doc_id", "text")).collect()}
    assert all(kept[i] in (i, i - 1) for i, _ in rows) and all(kept[i] == i for i, _ in rows if i not in of)
    for kind in set(of.values()):
        own = [i for i in of if of[i] == kind]
        assert sum(kept[i] == i - 1 for i in own) >= 0.9 * len(own), kind


def test_links_that_joined_a_class(spark, folder):
    base = prose(1, 80, 10_000).split()
    rows = [(i, " ".join(base[: i % 40] + [f"v{i % 40}"] + base[i % 40 + 1 :]), "en", "s", 1) for i in range(200)]  # 40 texts, each five times
    rows += [(1000 + i, prose(50 + i, 80, 10_000), "en", "s", 1) for i in range(20)]
    rows += [(2000 + i, prose(9, 30), "en", "s", 1) for i in range(3)]  # one text: a class without a link
    got = {r.doc_id: r for r in nd.op7_query(spark, folder(documents=spark.createDataFrame(rows, DOCS))).collect()}
    assert all(got[i].class_id == 0 and got[i].class_size == 200 and got[i].n_links >= 1 for i in range(200))
    assert all(got[got[i].link_id].class_id == 0 and got[i].link_id % 40 != i % 40 for i in range(200))
    assert all(got[i].n_links == 0 and got[i].link_id is None for i in got if i >= 1000)


def test_components_of_a_long_path_and_a_star(spark):
    name = lambda i: bytearray(i.to_bytes(16, "big"))
    edges = [(name(i), name(i + 1)) for i in range(40)] + [(name(100), name(i)) for i in range(101, 140)]
    out = {bytes(r.node): bytes(r.label) for r in nd.components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert len(out) == 81 and all(v == bytes(name(0 if int.from_bytes(k, "big") <= 40 else 100)) for k, v in out.items())


def test_short_texts_one_word_apart_are_linked(spark):
    """Jaccard similarities of exactly 0.8 and more, by length: none is missed."""
    rows, n = [], 0
    for words in range(5, 60):
        for _ in range(8):
            base = prose(n, words + 4, 10_000).split()
            more = max(1, words // 4)  # words / (words + more) >= 0.8
            rows += [(3 * n, " ".join(base)), (3 * n + 1, " ".join(base + [f"e{n}x{i}" for i in range(more)]))]
            n += 1
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = {r.doc_id: r.kept_id for r in nd.classes(docs.select("doc_id", "text")).collect()}
    missed = [i for i in range(n) if kept[3 * i + 1] != 3 * i]
    assert not missed


def test_open_buckets_are_narrowed_without_losing_a_pair(spark, folder, monkeypatch):
    monkeypatch.setattr(nd, "WIDE", 30)
    passage = prose(5, 60, 10_000)
    rows = [(i, f"{prose(1000 + i // 3, 40, 10_000)} {passage} {'x' if i % 3 else ''}", "en", "s", 1) for i in range(240)]  # 80 classes that share more than half of their text
    rows += [(1000 + i, f"{passage} {prose(9000 + i, 90, 10_000)}", "en", "s", 1) for i in range(300)]
    got = {r.doc_id: r.class_id for r in nd.op7_query(spark, folder(documents=spark.createDataFrame(rows, DOCS))).collect()}
    assert got == brute_classes([r[:2] for r in rows])


def test_near_dedup_keeps_one_of_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, prose(1, 50), "en", "s", 1)] * 40 + [(2, prose(1, 50), "en", "s", 1)] * 3 + [(3, " ", "en", "s", 1)] * 2, DOCS)
    assert sorted(r.doc_id for r in nd.dedup(docs).collect()) == [1, 3, 3]


def test_near_dedup_on_odd_rows_and_an_empty_table(spark, odd, empty, clashing):
    untouched(clashing, nd.dedup(clashing))
    out = nd.dedup(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8, 9] and ids.count(None) == 1
    assert nd.dedup(empty).count() == 0
