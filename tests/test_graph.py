import pytest
from pyspark.sql import functions as F

from quarry.operators import contain, incremental, measure, overlay, resolve, search, traverse
from quarry.plans import index
from quarry.sources import catalog, extract, scip, star, tree

RING = {
    "kitchen/oven.py": "from kitchen.plate import serve\n\ndef bake(dough):\n    return serve(dough)\n",
    "kitchen/plate.py": "from kitchen.guest import eat\n\n\ndef serve(meal):\n    eat(meal)\n    eat(meal)\n",
    "kitchen/guest.py": "import kitchen.oven as o\nfrom kitchen.oven import bake\n\ndef eat(meal):\n    if meal:\n        return bake(meal)\n",
}
TREE = {
    "pkg/core.py": "import os\nfrom pkg.util import thing as t\n\nclass Box:\n    def put(self):\n        return self.take()\n    def take(self):\n        return helper()\n\ndef helper():\n    return os.path.join('a')\n\ndef other():\n    return thing()\n",
    "pkg/util.py": "def thing():\n    pass\n",
    "far/decoy.py": "def thing():\n    pass\ndef take():\n    pass\n",
}


def graph_of(spark, files, project="t"):
    rows = [(p, p.rsplit(".", 1)[-1].replace("py", "python").replace("ts", "typescript"), len(t), 0.0, t, bytearray(t.encode())) for p, t in files.items()]
    snapshot = spark.createDataFrame(rows, "path string, lang string, size long, mtime double, t string, content binary").select("path", "lang", "size", "mtime", F.sha2("t", 256).alias("sha256"), "content")
    return index.facts(snapshot, project), snapshot


def names(answer):
    return sorted(r.name for r in answer.rows.collect())


@pytest.fixture(scope="module")
def ring(spark):
    return graph_of(spark, RING)[0]


def test_callers_and_blast_radius_of_a_ring(spark, ring):
    assert names(index.neighbors(ring, "eat")) == ["serve"]
    reached = index.blast_radius(ring, "eat", 8).rows.collect()
    assert len({r.node for r in reached}) == len(reached)
    assert {"serve", "bake"} <= {r.name for r in reached}
    with pytest.raises(ValueError):
        index.blast_radius(ring, "eat", 9)
    with pytest.raises(ValueError, match="callers"):
        index.neighbors(ring, "eat", "friends")


def test_answers_carry_gaps(spark, ring):
    answer = index.neighbors(ring, "nobody")
    assert answer.rows.count() == 0 and answer.gaps and "python" in answer.capabilities


def test_tiers(spark):
    g, _ = graph_of(spark, TREE)
    name = {r.id: r.name for r in g.nodes.collect()}
    where = {r.id: r.file_id for r in g.nodes.collect()}
    path = {r.id: r.path for r in g.files.collect()}
    refs = {r.id: r.name for r in g.refs.collect()}
    got = {refs[r.ref_id]: (name[r.dst], path[where[r.dst]], r.confidence, r.evidence, r.resolved) for r in resolve.resolve(g).collect()}
    assert got["take"] == ("take", "pkg/core.py", 0.95, "same_class", True)
    assert got["helper"] == ("helper", "pkg/core.py", 0.90, "same_file", True)
    assert got["thing"][:4] == ("thing", "pkg/util.py", 0.70, "import")
    assert "join" not in got
    assert {refs[r.ref_id] for r in resolve.external(g).collect()} == {"join"}
    assert {refs[r.ref_id] for r in resolve.file_local(g).where("decided").collect()} == {"take", "helper"}


def test_global_share_and_floor(spark):
    files = {f"d{i}/m.py": "def many():\n    pass\n" for i in range(5)} | {"use/u.py": "def f():\n    many()\n"}
    g, _ = graph_of(spark, files)
    rows = resolve.resolve(g).collect()
    assert len(rows) == 5 and {r.confidence for r in rows} == {0.3 / 5} and not any(r.resolved for r in rows)
    g, _ = graph_of(spark, files | {"d9/m.py": "def many():\n    pass\n"})
    assert resolve.resolve(g).count() == 0 and resolve.external(g).count() == 0


def test_package_homonyms(spark):
    g, _ = graph_of(spark, {"p/a.py": "def x():\n    pass\n", "p/b.py": "def x():\n    pass\n", "p/c.py": "def f():\n    x()\n"})
    rows = resolve.resolve(g).collect()
    assert [(r.candidate_count, r.evidence, r.resolved) for r in rows] == [(2, "package", False)] * 2
    assert measure.homonyms(g).first().definitions == 2


def test_no_definition_but_the_module_of_a_file_is_its_own_parent(spark):
    g, _ = graph_of(spark, TREE)
    edges = contain.structural_edges(g.nodes, contain.parents(g.nodes)).collect()
    assert len(edges) == g.nodes.where("kind <> 'module'").count()
    assert {(r.kind) for r in edges} == {"DEFINES", "CONTAINS"}
    assert {r.qualified_name for r in index.qualified_names(g).collect()} >= {"Box", "Box.put", "Box.take", "helper"}


def test_symbols_are_found_by_phrase_and_qualified_name(spark):
    g, _ = graph_of(spark, TREE)
    put = [r.id for r in index.find_symbol(g, "put").rows.collect()]
    assert len(put) == 1
    for asked, exact in (("Box.put", True), ("box.PUT", False)):
        rows = index.find_symbol(g, asked).rows.collect()
        assert [(r.id, r.exact) for r in rows] == [(put[0], exact)]
    assert index.start_of(g, "Box.put")[0].first().id == put[0]


def test_symbols_are_ranked_before_the_cut(spark):
    rows = [(i, "alpha beta gamma delta " + "x " * (9 - i), None) for i in range(5)] + [(9, "alpha beta", "Z"), (10, "beta alpha", None), (11, "q", "my alpha beta"), (12, "alpha", "beta")]
    rows += [(100 + i, f"other{i}", None) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id long, name string, qualified_name string")
    asked = spark.createDataFrame([("alpha beta",), ("Alpha Beta",), ("nothing",), ("",)], "name string")
    out = {}
    for r in search.search_symbols(nodes, asked, 3).orderBy("name", "rank").collect():
        out.setdefault(r.name, []).append((r.node_id, r.exact))
    assert out == {"alpha beta": [(9, True), (11, False), (4, False)], "Alpha Beta": [(9, False), (11, False), (4, False)]}


def test_update_reads_changed_files_only_and_keeps_other_ids(spark):
    g, old = graph_of(spark, RING)
    _, new = graph_of(spark, {"kitchen/oven.py": RING["kitchen/oven.py"], "kitchen/plate.py": "def wash():\n    pass\n", "cellar.py": "def wine():\n    pass\n"})
    fresh, changes = index.update(g, new, project="t")
    assert {(r.path, r.change) for r in changes.collect()} == {("kitchen/plate.py", "changed"), ("kitchen/guest.py", "removed"), ("cellar.py", "added")}
    assert {r.name for r in fresh.nodes.where("kind <> 'module'").collect()} == {"bake", "wash", "wine"}
    assert {r.id for r in g.nodes.where("name = 'bake'").collect()} == {r.id for r in fresh.nodes.where("name = 'bake'").collect()}
    hinted, changes = index.update(g, new, spark.createDataFrame([("cellar.py",), ("../x",), ("/y",)], "path string"), "t")
    assert [(r.path, r.change) for r in changes.collect()] == [("cellar.py", "added")]
    assert hinted.files.count() == 4


def test_nests_are_followed_to_the_top(spark):
    depth = 40
    rows = [(i, 1, "class" if i == 0 else "function", f"f{i}", i * 10, i * 10 + 2, 10_000 - i) for i in range(depth + 1)]
    nodes = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, start_byte long, end_byte long, body_end long")
    parents = contain.parents(nodes)
    assert {r.id: r.class_id for r in contain.classes(nodes, parents).collect()} == {i: 0 for i in range(depth + 1)}
    assert {r.id: r.qualified_name for r in contain.qualified_names(nodes, parents).collect()}[depth] == ".".join(f"f{i}" for i in range(depth + 1))
    circle = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    assert contain.classes(nodes.where("id IN (1, 2)"), circle).count() == 0


@pytest.mark.parametrize("depth", [3])
def test_blast_sizes_equal_the_rows_counted(spark, ring, depth):
    import random

    draw = random.Random(depth)
    places = [(f, f) for f in range(40)] + [(100 + d, d % 40) for d in range(150)]
    links = {(draw.randrange(100, 250), draw.choice(places)[0]) for _ in range(120)}  # dst, src: from modules as well
    importers = {(draw.randrange(40), draw.randrange(40)) for _ in range(50)} | {(7, 8), (8, 7)}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), ", ".join(f"{n} long" for n in names.split()))
    built = [traverse.steps(ring)]
    for more in (set(), {(3, 120), (5, 6)}):  # the second has links that lead to modules
        built.append(traverse.Steps(frame({x for x in links | more if x[0] != x[1]}, "dst src"), frame(places, "node file"), frame({x for x in importers if x[0] != x[1]}, "file src")))
    for step in built:
        starts = step.places.select(F.col("node").alias("id"))
        levels = [F.count_if(F.col("depth") == n).alias(f"depth{n}") for n in range(1, depth + 1)]
        expected = {tuple(r) for r in traverse.blast_radius(step, starts, depth).groupBy("start").agg(*levels).collect()}
        assert expected and {tuple(r) for r in traverse.blast_sizes(step, starts, depth).collect()} == expected
    assert traverse.blast_sizes(step, starts, 0).count() == 0
    assert traverse.blast_sizes(step, starts.limit(0), depth).count() == 0
    with pytest.raises(ValueError):
        traverse.blast_sizes(step, starts, 9)


def test_blast_radius_equals_a_plain_search(spark, ring):
    for g in (ring, graph_of(spark, TREE)[0]):
        steps = {}
        for r in traverse.steps(g).rows().collect():
            steps.setdefault(r.dst, set()).add(r.src)
        expected = set()
        for start in (r.id for r in g.nodes.collect()):
            seen, level = {start}, {start}
            for depth in range(1, 4):
                level = {s for n in level for s in steps.get(n, ())} - seen
                seen |= level
                expected |= {(start, n, depth) for n in level}
        assert {tuple(r) for r in traverse.blast_radius(traverse.steps(g), g.nodes.select("id"), 3).collect()} == expected
    assert traverse.blast_radius(traverse.steps(ring), ring.nodes.select("id"), 0).count() == 0


def test_a_kept_index_is_read_again_in_another_session(spark, tmp_path):
    root, at = tmp_path / "tree", f"file://{tmp_path}/kept"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    first = index.index(spark, str(root), path=at)
    other = spark.newSession()
    again = index.reopen(other, at, str(root))
    assert names(index.neighbors(again, "helper")) == names(index.neighbors(first, "helper")) == ["take"]
    assert {r.kind for r in again.derived("edges", None).select("kind").distinct().collect()} >= {"CALLS", "DEFINES", "CONTAINS"}
    assert index.index(spark, str(root), path=at).files.count() == 3 and catalog.Catalog(spark, at).versions().count() == 1  # nothing has changed
    (root / "pkg/util.py").write_text("def thing():\n    return helper()\n")
    changed = index.index(spark, str(root), path=at)
    assert names(index.neighbors(changed, "helper", ambiguous=True)) == ["take", "thing"]
    kept = catalog.Catalog(spark, at)
    assert [r.version for r in kept.versions().collect()] == [2, 1] and kept.compact() == [1] and [r.version for r in kept.versions().collect()] == [2]
    assert index.reopen(spark, at).files.count() == 3
    catalog.ALGORITHM, before = "other", catalog.ALGORITHM
    try:
        with pytest.raises(catalog.Incompatible, match=before):
            index.reopen(spark, at)
    finally:
        catalog.ALGORITHM = before
    kept.wipe()
    with pytest.raises(catalog.Incompatible):
        kept.read()


def test_scripts_in_pages_are_read():
    text = "<p>é</p>\n<script lang='ts'>\nimport { a } from './m';\nfunction run() { a() }\n</script>\n<script>run()</script>"
    for lang in ("vue", "svelte", "html"):
        reason, defs, refs, imports = extract.facts(lang, text)
        data = text.encode()
        assert reason == "" and [d[1] for d in defs] == ["run"] and [r[1] for r in refs] == ["a", "run"] and imports == [("./m", "a", "", 3)]
        assert data[defs[0][2] : defs[0][3]] == b"run" and defs[0][5] == 4 and all(data[r[5] :].startswith(r[1].encode()) for r in refs) and refs[1][6] == 6
    assert extract.facts("vue", "<p></p>")[0] == "no_symbols"


def test_an_index_is_laid_over_the_graph(spark, tmp_path):
    g, snapshot = graph_of(spark, TREE)
    text = TREE["pkg/core.py"]

    def at(word, nth=0):
        place = -1
        for _ in range(nth + 1):
            place = text.index(word, place + 1)
        line = text.count("\n", 0, place)
        return line, place - (text.rfind("\n", 0, place) + 1)

    def said(word, symbol, roles, nth=0):
        line, column = at(word, nth)
        return encoded((8, encoded((1, line), (2, column), (3, column + len(word)))), (2, symbol.encode()), (3, roles))

    info = encoded((1, b"s Box"), (3, b"A box."), (3, b"More."), (5, 26), (4, encoded((1, b"s helper"), (3, 1))))
    doc = encoded((1, b"pkg/core.py"), *[(2, said(*x)) for x in (("Box", "s Box", 1), ("put", "s put", 1), ("take", "s take", 1, 1), ("helper", "s helper", 1, 1), ("other", "s other", 1), ("take", "s other", 0))], (3, info))
    (tmp_path / "index.scip").write_bytes(encoded((1, encoded((2, encoded((1, b"scip-go"))))), (2, doc)))
    documents = scip.documents(spark, str(tmp_path))
    texts = snapshot.join(g.files.select("path", F.col("id").alias("file_id")), "path").select("file_id", F.col("content").cast("string").alias("text"))
    tools = spark.createDataFrame([("scip-go", "python")], "tool string, lang string")
    _, links, covered = overlay.ingest(g, documents, texts, traverse.links(g), tools)
    assert covered.first().refused and round(covered.first().files, 2) == 0.33  # one file of three
    assert not links.where("evidence = 'scip'").count()
    small, _ = graph_of(spark, {"pkg/core.py": text})
    nodes, links, covered = overlay.ingest(small, documents, texts.withColumn("file_id", texts["file_id"]), traverse.links(small), tools)
    assert not covered.first().refused
    box = nodes.where("name = 'Box'").first()
    assert (box.kind, box.doc, box.qualified_name, box.tier) == ("method", "A box.\nMore.", "s Box", "scip")
    name = {r.id: r.name for r in nodes.collect()}
    assert {(name[r.src], name[r.dst], r.kind) for r in links.where("evidence = 'scip'").collect()} == {("put", "other", "CALLS"), ("Box", "helper", "IMPLEMENTS")}
    assert overlay.fresh(documents.withColumn("built", F.lit(-1.0)), small.files).count() == 0


def test_column_units_by_tool():
    assert scip.encoding_of("scip-go", 0) == 1 and scip.encoding_of("any", 3) == 3
    with pytest.raises(ValueError, match="scip-go"):
        scip.encoding_of("any", 0)


def test_hints_merge(spark):
    rows = [("r", "a"), ("r", "b"), ("r", "a"), ("w", None), ("w", "x")] + [("big", str(i)) for i in range(201)]
    got = {r.root: r.paths for r in incremental.merged_hints(spark.createDataFrame(rows, "root string, path string")).collect()}
    assert got == {"r": ["a", "b"], "w": None, "big": None}


@pytest.mark.parametrize("lang, text, defs, calls, imports", [
    ("python", "import a.b as c\nfrom . import d\nclass A(B):\n    def m(self):\n        self.n(x())\n", ["A", "m"], ["B", "n", "x"], [("a.b", "", "c"), (".", "d", "")]),
    ("go", 'package p\nimport (\n\t"fmt"\n\tq "host.x/o/r/q"\n)\ntype S struct {}\nfunc (s *S) Run() { s.Stop(); q.Go() }\nfunc main() { fmt.Println("x(") }\n', ["S", "Run", "main"], ["Stop", "Go", "Println"], [("fmt", "", ""), ("host.x/o/r/q", "", "q")]),
    ("typescript", "import def, { a as b, c } from './m';\nimport * as all from 'n';\nexport class K { run(x: number): void { this.go(); helper(x); } }\nfunction helper(x) { return a(x) }\n", ["K", "run", "helper"], ["go", "helper", "a"], [("./m", "default", "def"), ("./m", "a", "b"), ("./m", "c", ""), ("n", "", "all")]),
    ("php", "<?php\nuse App\\Models\\Order as O;\nclass C {\n  public function save() { $this->load(); Order::find(1); }\n}\n", ["C", "save"], ["load", "find"], [("App\\Models\\Order", "", "O")]),
    ("elisp", "(defun x ())", [], [], []),
])
def test_extraction(lang, text, defs, calls, imports):
    reason, d, r, i = extract.facts(lang, text)
    assert [x[1] for x in d] == defs and [x[1] for x in r] == calls and [x[:3] for x in i] == imports
    data = text.encode()
    assert all(data[x[2] : x[3]].decode() == x[1] for x in d) and all(data[x[5] :].startswith(x[1].encode()) for x in r)
    assert reason == ("no_parser" if lang == "elisp" else "")


def test_extraction_refuses(spark):
    assert extract.facts("python", "def (")[0] == "query_failed" and extract.facts("python", None)[0] == "unreadable" and extract.facts("python", "x = 1")[0] == "no_symbols"
    assert extract.facts("go", "func (s *S) A() { s.B(); t.C() }")[2][0][4] and not extract.facts("go", "func (s *S) A() { s.B(); t.C() }")[2][1][4]


def test_snapshot_of_a_tree(spark, tmp_path):
    for name, text in {"a.py": "é = 1", "node_modules/b.js": "x", "skip/c.py": "x", "d.unknown": "x", "e.py": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    rows = {r.path: r for r in tree.texts(tree.snapshot(spark, str(tmp_path), exclude=["skip/*"])).collect()}
    assert set(rows) == {"a.py", "bad.py"} and rows["a.py"].text == "é = 1" and rows["bad.py"].reason == "unreadable" and rows["bad.py"].text is None


def test_embedded_scripts(spark):
    df = spark.createDataFrame([(1, "<p>\n<script lang='ts'>\nlet a;\n</script>\n<script>b</script>")], "id int, html string")
    rows = sorted(tree.scripts(df, "html").collect(), key=lambda r: r.pos)
    assert [(r.script, r.first_line) for r in rows] == [("\nlet a;\n", 2), ("b", 5)] and "ts" in rows[0].attributes


def encoded(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3]) + number_bytes(value)
        else:
            out += bytes([number << 3 | 2]) + number_bytes(len(value)) + value
    return out


def number_bytes(v):
    out = b""
    while v >= 0x80:
        out, v = out + bytes([v & 0x7F | 0x80]), v >> 7
    return out + bytes([v])


def test_compiler_index(spark, tmp_path):
    one = encoded((1, b"".join(map(number_bytes, [3, 4, 9]))), (2, b"s 1"), (3, 1))
    two = encoded((1, b"".join(map(number_bytes, [3, 4, 5, 300]))), (2, b"local 2"), (3, 1))
    doc = encoded((1, b"a.py"), (2, one), (2, two), (6, 1))
    (tmp_path / "index.scip").write_bytes(encoded((1, encoded((2, encoded((1, b"tool"))))), (2, doc)))
    rows = scip.read(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("tool", "a.py", 1, "s 1", 1, 3, 4, 3, 9), ("tool", "a.py", 1, "local 2", 1, 3, 4, 5, 300)]
    assert [r.symbol for r in scip.definitions(rows).collect()] == ["s 1"]
    with pytest.raises(ValueError):
        list(scip.fields(memoryview(b"\x0b")))


def test_offsets():
    text = "a\né😀b"
    assert [scip.byte_offset(text, 1, c, 3) for c in range(4)] == [2, 4, 8, 9]
    assert [scip.byte_offset(text, 1, c, 2) for c in (0, 1, 3, 4, 9)] == [2, 4, 8, 9, 9]
    assert scip.byte_offset(text, 1, 2, 1) == 4 and scip.byte_offset(text, 7, 0) == 9


def test_walks_see_a_node_once_at_its_least_depth(spark, ring):
    start = ring.nodes.where("name = 'eat'").select("id")
    rows = traverse.walk(ring, start, 8).collect()
    assert sorted(r.depth for r in rows) == [1, 2] and star.module_nodes(ring.files).count() == 3
    assert sorted(map(tuple, traverse.walk(ring, start, 0).collect())) == sorted(map(tuple, rows)) and {r.kind for r in rows} == {"CALLS"}
    name = {r.id: r.name for r in ring.nodes.collect()}
    assert {(name[r.node], r.depth) for r in traverse.walk(ring, start, 1, direction="down").collect()} == {("bake", 1)}
    assert traverse.walk(ring, start, 2, kinds=("IMPLEMENTS",)).count() == 0
    with pytest.raises(ValueError):
        traverse.walk(ring, start, 9)


def test_search_over_projects_takes_the_first_ones_first(spark):
    rows = [(i, f"alpha x{i}", None, i % 3) for i in range(30)] + [(100, "alpha", None, 2), (200, "z", None, 0)]
    nodes = spark.createDataFrame(rows, "id long, name string, qualified_name string, project_no int")
    got = search.federated(nodes, spark.createDataFrame([("alpha",)], "name string"), 12).orderBy("rank").collect()
    assert [r.project_no for r in got] == [0] * 10 + [1] * 2 and [r.rank for r in got] == list(range(1, 13))
