"""Candidates are counted by scope before anybody makes pairs of them."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import measure, overlay, resolve, traverse
from quarry.plans import registry
from quarry.sources import star, tables

SOURCE = "/root/testdata/sf0.001"
N = 30


@pytest.fixture
def crowd(spark):
    """N files that define 'many', N others of the same package that call it; two of these import what they call, one calls what it defines twice."""
    files = [(i, 0, "python", f"p/f{i}.py", f"p.f{i}", "p") for i in range(2 * N)]
    nodes = [(i, i, "module", f"p.f{i}", 0, 0, 0) for i in range(2 * N)]
    nodes += [(1000 + i, i, "function", "many", 1000, 1008, 1900) for i in range(N)] + [(2000 + i, i, "function", f"c{i}", 2000, 2008, 2900) for i in range(N, 2 * N)]
    nodes += [(3000 + i, 2 * N - 1, "function", "twice", 3000 + 1000 * i, 3008 + 1000 * i, 3900 + 1000 * i) for i in range(2)]
    refs = [(100 + i, i, "CALLS", "many", False, "", False, 2500) for i in range(N, 2 * N)] + [(300 + i, i, "CALLS", "many", False, "", False, 2600) for i in range(N, 2 * N)]
    refs += [(500, N, "CALLS", f"c{N + 1}", False, "", False, 2700), (501, 2 * N - 1, "CALLS", "twice", False, "", False, 2700), (502, N, "CALLS", "nobody", False, "", False, 2800)]
    imports = [(1, N, "p.f0", "", "", "p.f0"), (2, N + 1, "p.f0", "", "", "p.f0"), (3, N + 1, "p.f1", "many", "", "p.f1")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return star.Graph(
        frame(files, "id long, project_no int, lang string, path string, module string, package string"),
        frame(nodes, "id long, file_id long, kind string, name string, start_byte long, end_byte long, body_end long"),
        frame(refs, "id long, file_id long, kind string, name string, is_member boolean, receiver string, receiver_self boolean, site long"),
        frame(imports, "id long, file_id long, module string, symbol string, alias string, module_abs string"),
        tables.Tables(spark, "crowd"),
    )


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_a_reference_costs_a_row_however_many_candidates_it_has(crowd):
    held = resolve.sized(crowd)
    assert held.count() == 2 * N + 3  # one group for each reference, two for 'twice', whose candidates are in the file itself; none for 'nobody'
    pairs = resolve.resolve(crowd)
    assert pairs.count() == held.agg(F.sum("n")).first()[0] == 2 * (N - 2) * N + 4 + 1 + 2
    assert {(r.confidence, r.evidence) for r in pairs.where("ref_id IN (130, 131)").collect()} == {(0.70, "import"), (0.85, "import")}
    assert Counter(r.candidate_count for r in pairs.collect()) == {N: 2 * (N - 2) * N, 1: 5, 2: 2}


def test_slices_of_references_give_the_same(crowd, monkeypatch):
    whole = rows(resolve.resolve(crowd))
    crowd.tables = tables.Tables(crowd.files.sparkSession, "crowd")
    monkeypatch.setattr(resolve, "SLICE", 20)
    assert rows(resolve.resolve(crowd)) == whole


def test_slices_of_line_items_give_the_same(spark, tmp_path, monkeypatch):
    os.symlink(SOURCE, tmp_path / "again")
    whole = star.graph(spark, SOURCE)
    monkeypatch.setattr(star, "SLICE", 2000)
    sliced = star.graph(spark, str(tmp_path / "again"))
    assert rows(sliced.refs) == rows(whole.refs) and rows(sliced.imports) == rows(whole.imports) and whole.refs.count() > 2000


def test_counts_and_shares_of_evidence_equal_those_of_the_links(crowd):
    links, counted = traverse.links(crowd), traverse.counted_links(crowd)
    assert rows(measure.counts(crowd, counted)) == rows(measure.counts(crowd, links)) and counted.count() < links.count() / 10
    assert rows(measure.evidence_share(counted)) == rows(measure.evidence_share(links))


def test_files_of_candidates_are_counted_by_group(crowd):
    r = measure.collapse(crowd, resolve.sized(crowd)).first()
    assert (r.sites, r.scoped_sites, r.scoped_mean) == (2 * N + 2, 2 * N + 2, round((2 * (N - 2) * N + 4 + 1 + 1) / (2 * N + 2), 4))


def test_settled_neighbors_make_no_pair(crowd):
    """Callers that are sure come from counts alone: no group is spelled out for them."""
    found = traverse.neighbors(crowd, "callers")
    assert {(r.start, r.node) for r in found.collect()} == {(1000, 2000 + N), (1001, 2001 + N), (2001 + N, 2000 + N)}
    assert "AS d_name" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_implementations_of_an_index_ask_for_no_resolution(spark, tmp_path):
    os.symlink(SOURCE, tmp_path / "claims")
    where = str(tmp_path / "claims")
    assert registry.QUERIES["ovl07_implements"](spark, where).count() > 0
    assert not {"shares", "resolved"} & star.graph(spark, where).tables.made.keys()


def test_exact_calls_replace_the_graphs_own(spark):
    g = star.graph(spark, SOURCE)
    seen = registry.occurrences(g)
    assert rows(overlay.calls_anew(g, seen)) == rows(overlay.calls(g, traverse.links(g).where("kind = 'CALLS'"), seen))


def test_importers_are_not_sorted_out_after_they_are_made(crowd, spark):
    for question, here in (("importers", "dst"), ("imports", "src")):
        found = traverse.neighbors(crowd, question)
        made = crowd.nodes.select(F.col("id").alias("start"), "file_id").join(traverse.file_links(crowd), F.col("file_id") == F.col(here)).select("start", "src" if here == "dst" else "dst")
        assert Counter((r.start, r.node) for r in found.collect()) == rows(made) and found.count() > 2
        assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_ambiguous_neighbors_equal_the_best_of_all_links(crowd, spark):
    for question, here, there in (("callers", "dst", "src"), ("callees", "src", "dst")):
        every = traverse.links(crowd).where("src <> dst").select(F.col(here).alias("start"), F.col(there).alias("node"), "kind", "confidence", "evidence", "candidate_count")
        assert rows(traverse.neighbors(crowd, question, ambiguous=True)) == rows(traverse.best_of(every))
    one = spark.createDataFrame([(1003,)], "id long")
    assert traverse.neighbors(crowd, "callers", ambiguous=True, starts=one).count() == N - 2
