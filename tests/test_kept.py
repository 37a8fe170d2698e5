"""Kept indexes, changes of trees, ledgers, quarantine and health: updates, crashes, replays and time."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import incremental
from quarry.plans import index
from quarry.sources import catalog, tree
from quarry.streaming import changes, health, ledger, maintain, quarantine

PIECES = {
    "pkg/core.py": "from pkg.util import thing as t\n\nclass Box:\n    def put(self):\n        return self.take()\n    def take(self):\n        return helper()\n\ndef helper():\n    return t()\n",
    "pkg/util.py": "def thing():\n    pass\n",
    "far/decoy.py": "def thing():\n    pass\n",
    "far/user.py": "from pkg.core import helper\n\ndef use():\n    helper()\n    thing()\n    lost()\n",
}


def put(root, files):
    for name, text in files.items():
        place = root / name
        if text is None:
            place.unlink()
        else:
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(text)


def edges(graph):
    names = {r.id: f"{r.file_id}:{r.name}" for r in graph.nodes.collect()}
    return sorted((names[r.src], names[r.dst], r.kind, round(r.confidence, 6), r.evidence, r.candidate_count, r.resolved) for r in graph.derived("edges", None).collect())


def hits(graph, name):
    return [(r.id, r.exact, r.score) for r in index.find_symbol(graph, name).rows.collect()]


def rows_of(spark, at, number):
    segment = index.kept(spark, at).version(number)["segments"][-1]
    return {n: index.kept(spark, at)._rows(n, segment).count() for n in segment["rows"]}


def test_updates_write_what_changed_and_equal_a_fresh_index(spark, tmp_path):
    root, at = tmp_path / "tree", f"file://{tmp_path}/kept"
    put(root, PIECES | {f"many/m{i}.py": f"def only{i}():\n    return inner{i}()\n" for i in range(40)})
    index.index(spark, str(root), path=at)
    steps = [
        {"far/decoy.py": "def other():\n    pass\n"},  # a definition goes: elsewhere a reference has one candidate fewer
        {"far/lost.py": "def lost():\n    pass\n", "pkg/util.py": None},
        {"pkg/util.py": "def thing():\n    return 1\n\ndef helper():\n    pass\n"},
    ]
    for number, files in enumerate(steps, 2):
        put(root, files)
        kept = index.index(spark, str(root), path=at)
        assert index.kept(spark, at).numbers()[0] == number
        written = rows_of(spark, at, number)
        assert written["files"] <= 2 and written["postings"] <= 20 and written["edges"] <= 20
        fresh_at = f"file://{tmp_path}/fresh{number}"
        fresh = index.index(spark, str(root), path=fresh_at)
        assert edges(kept) == edges(fresh)
        for name in ("thing", "helper", "Box.take", "only7", "lost"):
            assert hits(kept, name) == hits(fresh, name)


def test_a_name_is_found_over_a_workspace_and_members_without_an_index_are_told(spark, tmp_path):
    at = lambda path: f"file://{tmp_path}/kept/{path.rsplit('/', 1)[-1]}"
    for name, files in (("one", {"a.py": "def thing():\n    pass\n"}), ("two", {"b.py": "def thing():\n    pass\n\ndef other():\n    pass\n"})):
        put(tmp_path / name, files)
        index.index(spark, str(tmp_path / name), path=at(name))
    reached = spark.createDataFrame([(0, "/w/two"), (1, "/w/one"), *[(i, f"/w/no{i}") for i in range(2, 9)]], "place int, path string")
    answer = index.find_in_members(spark, reached, at, "thing")
    assert [(r.project, r.path, r.exact) for r in answer.rows.collect()] == [("/w/two", "b.py", True), ("/w/one", "a.py", True)]
    assert answer.gaps == ["7 projects of this workspace have no index: /w/no2, /w/no3, /w/no4, /w/no5, /w/no6 and 2 more"]


def test_segments_are_merged_and_old_ones_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MOST", 3)
    kept = catalog.Catalog(spark, f"file://{tmp_path}/c", {"t": {"k": "key"}})
    table = lambda rows: spark.createDataFrame(rows, "k int, v string")
    gone = lambda *ks: {"key": spark.createDataFrame([(k,) for k in ks], "key int")}
    assert kept.write({"t": table([(i, "a") for i in range(200)])}) == 1
    expected = {i: "a" for i in range(200)}
    for step in range(6):
        kept.append({"t": table([(step, f"n{step}"), (500 + step, "new")])}, gone(step, 100 + step))
        expected |= {step: f"n{step}", 500 + step: "new"}
        expected.pop(100 + step)
        kept.merge()
        assert {r.k: r.v for r in kept.read()["t"].collect()} == expected
        assert len(kept.newest()["segments"]) <= 3
    before = {r.k: r.v for r in kept.read()["t"].collect()}
    dropped = kept.compact(2)
    assert dropped and len(kept.numbers()) == 2 and {r.k: r.v for r in kept.read()["t"].collect()} == before


def test_a_crash_in_compact_and_a_second_writer(spark, tmp_path, monkeypatch):
    kept = catalog.Catalog(spark, f"file://{tmp_path}/c")
    for i in range(4):
        kept.write({"t": spark.range(i + 1)})
    deleted = []

    def crash(spark_, path, real=catalog.tables.delete):
        if "/data/" in path:
            raise OSError("killed")
        deleted.append(path)
        real(spark_, path)

    with monkeypatch.context() as m:
        m.setattr(catalog.tables, "delete", crash)
        with pytest.raises(OSError):
            kept.compact(1)
    again = catalog.Catalog(spark.newSession(), f"file://{tmp_path}/c")
    assert again.numbers() == [4] and again.read()["t"].count() == 4 and len(deleted) == 3
    again.compact(1)
    assert len(list((tmp_path / "c/data").iterdir())) == 1
    with pytest.raises(catalog.Conflict):
        kept._publish(4, [])
    assert kept.read()["t"].count() == 4


def read_all(stream, at, seen):
    run = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    run.awaitTermination()


def test_no_change_is_lost_or_told_twice_when_writer_and_reader_are_killed(spark, tmp_path, monkeypatch):
    home, seen = f"file://{tmp_path}/home", []
    listing = lambda *rows: spark.createDataFrame(rows, "path string, size long, mtime double")
    watch = changes.Changes(spark, home)
    assert watch.look(listing(("a.py", 1, 1.0), ("b.py", 1, 1.0))) == 1
    read_all(watch.stream(), tmp_path / "state", seen)
    with monkeypatch.context() as m:  # killed after the version is there, before its events are
        m.setattr(changes.Changes, "publish", lambda self: [])
        watch.look(listing(("a.py", 2, 2.0), ("c.py", 1, 1.0)))
    read_all(watch.stream(), tmp_path / "state", seen)
    assert sorted(seen) == [(1, "a.py", "added"), (1, "b.py", "added")]
    again = changes.Changes(spark, home)
    assert again.look(listing(("a.py", 2, 2.0), ("c.py", 1, 1.0))) is None and again.publish() == []
    read_all(again.stream(), tmp_path / "state", seen)
    read_all(again.stream(), tmp_path / "state", seen)
    assert sorted(seen)[2:] == [(2, "a.py", "changed"), (2, "b.py", "gone"), (2, "c.py", "added")]
    for i in range(12):  # listings pile up and are merged; no merge is an event
        again.look(listing(("a.py", 3 + i, 2.0)))
    read_all(again.stream(1), tmp_path / "state", seen)
    assert [k for _, p, k in sorted(seen)[5:] if p == "a.py"] == ["changed"] * 12 and len(seen) == 5 + 13
    replay = []
    read_all(again.stream(), tmp_path / "other state", replay)
    assert sorted(replay) == sorted(seen)


def test_only_files_that_can_be_indexed_are_watched(spark):
    rows = [("a.py", 5), ("node_modules/x.js", 5), ("deep/.git/y.py", 5), ("b.unknown", 5), ("c.go", 0), ("gen/d.go", 9), (".github/e.py", 7)]
    assert {r.path for r in changes.watched(spark.createDataFrame(rows, "path string, size long"), ["gen/**"]).collect()} == {"a.py", ".github/e.py"}


def test_an_index_follows_events_and_reconciles_what_was_lost(spark, tmp_path):
    root, at = tmp_path / "tree", f"file://{tmp_path}/kept"
    put(root, PIECES)
    maintain.reconcile(spark, str(root), at)
    put(root, {"far/decoy.py": "def changed_a():\n    thing()\n", "far/user.py": None, "new.py": "def changed_b():\n    pass\n"})
    told = spark.createDataFrame([("far/decoy.py",), ("../out.py",), ("/etc/x.py",)], "path string")
    follow = maintain.follow(str(root), at)
    follow(told, 0)
    names = {r.name for r in index.reopen(spark, at).nodes.collect()}
    assert "changed_a" in names and "use" in names and "changed_b" not in names  # half of the events were lost
    follow(told, 0)
    assert index.kept(spark, at).numbers()[0] == 2  # the batch again writes nothing
    kept = maintain.reconcile(spark, str(root), at)
    fresh = index.index(spark, str(root), path=f"file://{tmp_path}/fresh")
    assert edges(kept) == edges(fresh) and {r.path for r in kept.files.collect()} == {r.path for r in fresh.files.collect()}
    assert {r.path for r in tree.listing(spark, str(root)).collect()} == {"far/decoy.py", "new.py", "pkg/core.py", "pkg/util.py"}


def test_a_replayed_batch_adds_no_row_and_generations_turn(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", max_bytes=6_000)
    row = lambda b: spark.createDataFrame([(b, b * 10, "bad" if b % 3 == 0 else None)], "ts long, id long, error string")
    for b in range(3):
        book.put(row(b), b)
    book.put(row(1), 1)
    assert sorted(r.ts for r in book.read().collect()) == [0, 1, 2]
    for b in range(3, 24):
        book.put(row(b), b)
        book.put(row(b), b)
    held = [r.ts for r in book.newest(100).collect()]
    assert held == list(range(23, 23 - len(held), -1)) and 6 <= len(held) < 24 and len(book.generations()) == 2
    assert [r.ts for r in book.newest(2, errors_only=True).collect()] == [21, 18]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_quarantine_gives_back_in_time_and_lets_go_after(rocks, tmp_path):
    source, seen, schema = tmp_path / "events", [], "path string, kind string, place string"

    def tell(*rows):
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))

    def wait(n):
        for _ in range(90):
            if len(seen) >= n:
                return
            run.awaitTermination(1)

    tell(("a", "deleted", "p1"), ("b", "deleted", "p2"), ("c", "restored", None))
    stream = quarantine.quarantined(rocks.readStream.schema(schema).json(str(source)), keep_ms=20_000)
    run = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        wait(3)
        tell(("b", "restored", None))
        wait(5)
    finally:
        run.stop()
    assert sorted(seen[:3], key=str) == [("a", "taken", "p1"), ("b", "taken", "p2"), ("c", "missing", None)]
    assert sorted(seen[3:], key=str) == [("a", "expired", "p1"), ("b", "restored", "p2")]


def test_failing_stream_equals_the_batch_over_several_runs(rocks, tmp_path):
    rows = [(t, p, (t * 7 + len(p) * t) % 3 != 0) for t in range(40) for p in ("x", "yy", "zzz")] + [(900, "quiet", True)]
    samples, schema, seen = rocks.createDataFrame(rows, "ts long, project string, failing boolean"), "ts long, project string, failing boolean", []
    expected = sorted((r.ts, r.project, "failing") for r in health.failing_twice(samples).collect())

    def failing():
        return sorted(r for r in seen if r[2] == "failing")

    for part in range(3):  # stopped and started again for each part
        samples.where(f"ts DIV 14 = {part} OR (ts = 900 AND {part} = 2)").orderBy(F.rand(part)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = health.failing_stream(rocks.readStream.schema(schema).json(str(tmp_path / "in")), silent_ms=3_000)
        run = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        upto = [r for r in expected if r[0] < 14 * (part + 1)]
        try:
            for _ in range(90):
                if len(failing()) >= len(upto) and (part < 2 or (900, "quiet", "silent") in seen):
                    break
                run.awaitTermination(1)
        finally:
            run.stop()
        assert failing() == upto
    assert (900, "quiet", "silent") in seen


def test_hints_are_counted_before_they_meet(spark):
    rows = [("few", f"p{i % 5}") for i in range(30)] + [("many", f"p{i}") for i in range(11)] + [("whole", "p"), ("whole", None)]
    got = {r.root: r.paths for r in incremental.merged_hints(spark.createDataFrame(rows, "root string, path string"), 10).collect()}
    assert got == {"few": [f"p{i}" for i in range(5)], "many": None, "whole": None}
