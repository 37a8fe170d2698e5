import numpy as np

import corpus_pipeline
from quarry.llm import ann
from tests.llm.conftest import DOCS, prose

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, near=20):
    usable = {}
    for i, v, _ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(np.array(v, np.float32), float)
    ids = np.array(sorted(usable))
    m = np.array([usable[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (m * usable[q]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:near]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores_against_brute_force(spark, folder):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.4 * rng.normal(size=16)], 0) for i in range(3000)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(600)]  # one vector many times
    path = folder(embeddings=spark.createDataFrame(rows, VECTORS))
    expected, got = brute(rows), {}
    for r in ann.op8_query(spark, path).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = 0
    exact = {i: np.array(np.array(v, np.float32), float) for i, v, _ in rows}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - (exact[q] * exact[v]).sum()) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({f[1] for f in found} & {v for v, _ in expected[q]})
    assert hits / (20 * len(got)) >= 0.9


def test_walks_are_complete_down_to_their_last_cell():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 12))
    index = ann.Index(x, 64)
    counts = np.bincount(index.cells(x), minlength=64 * 64)
    for q in x[:40]:
        for enough in (1, 50, 900, 4000):
            cells, last = index.walk(q, counts, enough)
            sums = index.sums(q[None, :], np.arange(64 * 64))[0]
            order = [c for c in np.argsort(-sums, kind="stable") if counts[c]]
            upto = int(np.searchsorted(np.cumsum(counts[order]), enough)) + 1
            assert set(cells.tolist()) == set(int(c) for c in order[:upto]) and abs(last - sums[order[upto - 1]]) < 1e-9


def test_recall_over_many_bins(spark, folder, monkeypatch):
    monkeypatch.setattr(ann, "BIN", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(61, 16))
    rows = [(i, [float(x) for x in centres[i % 61] + 0.5 * rng.normal(size=16)], 0) for i in range(6000)]
    expected, hits = brute(rows), 0
    for r in ann.op8_query(spark, folder(embeddings=spark.createDataFrame(rows, VECTORS))).collect():
        hits += r.vec_id in {v for v, _ in expected[r.query_id]}
    assert hits / (20 * len(expected)) >= 0.9


def test_an_id_of_two_vectors_has_one_list(spark, folder):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [0.9, 0.1], 0), (2, [0.2, 0.8], 0), (2, [0.5, 0.0], 0)]
    out = ann.op8_query(spark, folder(embeddings=spark.createDataFrame(rows, VECTORS))).collect()
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in sorted(out)] == [(1, 1, 0.9), (2, 2, 0.8)]


def test_equal_vectors_give_the_smallest_ids(spark, folder):
    rows = [(i, [1.0, 2.0], 0) for i in range(100)]
    out = ann.op8_query(spark, folder(embeddings=spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted(r.vec_id for r in out if r.query_id == 0) == list(range(1, 21))
    assert sorted(r.vec_id for r in out if r.query_id == 20) == list(range(0, 20))


def test_odd_vectors(spark, folder):
    rows = [(0, [1.0, 0.0], 1), (1, None, None), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (8, [1.0], 1), (5, [0.5, 0.5], 1), (20, [-1.0, 0.0], 1)]
    out = ann.op8_query(spark, folder(embeddings=spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 5, 0.5), (0, 2, 20, -1.0), (20, 1, 5, -0.5), (20, 2, 0, -1.0)]


def test_vectors_of_any_magnitude_take_part(spark, folder):
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(200, 8))
    expected = brute([(i, [float(x) for x in v], 0) for i, v in enumerate(plain.astype(np.float32))])
    for n, power in enumerate((0, 500, 1000, -400)):
        rows = [(i, [float(x) for x in np.ldexp(v.astype(np.float32).astype(float), power)], 0) for i, v in enumerate(plain)]
        (spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).write.parquet(f"{(path := folder(**{f'x{n}': spark.range(1)}))}/v{n}.parquet")
        out = {}
        for r in ann.search(spark.read.parquet(f"{path}/v{n}.parquet")).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: [v for _, v, _ in sorted(f)] for q, f in out.items()} == {q: [v for v, _ in f] for q, f in expected.items()}, power
        big = [s for f in out.values() for _, _, s in f]
        assert not np.isnan(big).any() and np.isinf(big).any() == (power == 1000)


def test_no_vectors(spark, folder):
    assert ann.op8_query(spark, folder(embeddings=spark.createDataFrame([], VECTORS))).count() == 0


def test_pipeline_end_to_end(spark, folder):
    rows = [(i, prose(i, 120, 300) + "\n" + prose(i + 500, 60, 300), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i][1].replace("w1 ", "v ", 1), "en", "s1", 1) for i in range(5)]  # near copies
    rows += [(300 + i, " ".join(f"z{i}{j}$$$" for j in range(60)), "en", "s2", 1) for i in range(20)]  # junk
    rows += [(400, None, "en", "s0", None), (401, "", None, None, 0), (402, prose(77, 40_000, 3000), "de", "s1", 1)]  # nothing, and very long
    labels = spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i in [*range(60), *range(200, 205), *range(300, 320), 100, 101, 102, 103, 104, 400, 401, 402]], "doc_id long, quality int, toxic int")
    path = folder(documents=spark.createDataFrame(rows, DOCS), labels=labels)
    docs, ids = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(300 <= i < 400 for i in ids[0]) and set(range(60)) <= ids[0] and {400, 401, 402} <= ids[0]
    assert set(range(60)) <= ids[1] and not any(100 <= i < 200 for i in ids[1])
    assert set(range(60)) <= ids[2]
    assert ids[4] == ids[3] and {400, 401} <= ids[4]


def test_near_copies_go_in_their_stage(spark):
    """The stage on its own input: line dedup before it cuts from a near copy the lines that it shares, and so decides most of them."""
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    rows = [(i, prose(i, 120, 3000) + "\n" + prose(i + 500, 60, 3000), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(200 + i, rows[i][1].replace("w1", "v", 3), "en", "s1", 1) for i in range(5)]
    assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, DOCS), "").collect()} == set(range(60))


def test_pipeline_of_an_empty_table_and_clashing_columns(spark, empty, clashing, folder):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    path = folder(labels=labels)
    for docs in (empty, clashing):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, path)
            assert left.columns == docs.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, left, path).count() == 0) == docs.isEmpty()
