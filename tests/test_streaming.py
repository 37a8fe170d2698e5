import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.streaming import health, jobs

EVENTS = "root string, kind string, path string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_queue_merges_while_a_job_waits(rocks, tmp_path):
    steps = [
        [("r", "saved", "a"), ("r", "saved", "b"), ("q", "saved", "x")],
        [("r", "saved", "c"), ("q", "saved", None)],
        [("r", "taken", None), ("q", "saved", "y")],
        [("r", "saved", "e")],
        [("r", "done", None)],
        [("r", "taken", None)],
        [("r", "done", None)],
        [("r", "saved", "d")] + [("big", "saved", str(i)) for i in range(201)],
    ]
    source, seen = tmp_path / "events", []
    for i, rows in enumerate(steps):
        rocks.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(source))
        stream = jobs.queue(rocks.readStream.schema(EVENTS).json(str(source)))
        run = stream.writeStream.foreachBatch(lambda df, n: seen.extend((i, *r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(i, root): (status, paths) for i, root, status, paths in seen}
    assert got[0, "r"] == ("queued", "a,b") and got[0, "q"] == ("queued", "x")
    assert got[1, "r"] == ("merged", "a,b,c") and got[1, "q"] == ("merged", None)
    assert got[2, "r"] == ("running", "a,b,c") and got[2, "q"] == ("merged", None)
    assert got[3, "r"] == ("requeued", "e") and (4, "r") not in got  # what waits goes on waiting
    assert got[5, "r"] == ("running", "e") and got[6, "r"] == ("done", None)
    assert got[7, "r"] == ("queued", "d") and got[7, "big"] == ("queued", None)


def test_a_deletion_counts_when_nothing_comes_back(rocks, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "DELETE_AFTER_MS", 1500)
    source, seen = tmp_path / "events", []
    rocks.createDataFrame([("gone.py", "gone"), ("back.py", "gone"), ("back.py", "here")], "path string, kind string").coalesce(1).write.mode("append").json(str(source))
    stream = jobs.deletions(rocks.readStream.schema("path string, kind string").json(str(source)))
    run = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            if seen:
                break
            run.awaitTermination(1)
    finally:
        run.stop()
    assert seen == [("gone.py", True)]


def test_batches_are_routed_and_failures_stay_apart(spark):
    events = spark.createDataFrame([("r/a/x.py",), ("r/a/y.py",), ("r/b/z.py",), ("else/w.py",)], "path string")
    roots = spark.createDataFrame([("r",), ("r/a",)], "root string")
    done, failed = [], []

    def work(root, paths):
        if root == "r":
            raise RuntimeError("broken")
        done.append((root, paths))

    jobs.batches(events, roots, work, failed)(events, 7)
    assert done == [("r/a", ["r/a/x.py", "r/a/y.py"])] and [(n, r) for n, r, _ in failed] == [(7, "r")]


def test_health_needs_two_samples(spark):
    rows = [(1, "a", True), (2, "a", True), (3, "a", False), (1, "b", True), (2, "b", False), (3, "b", True)]
    assert [tuple(r) for r in health.failing_twice(spark.createDataFrame(rows, "ts int, project string, failing boolean")).collect()] == [(2, "a")]
    depths = spark.createDataFrame([("h", 1, 25), ("h", 2, 25), ("h", 3, 24), ("h", 4, 3), ("h", 5, 9)], "host string, ts int, depth int")
    assert [tuple(r) for r in health.stuck(depths).collect()] == [("h", 2)]


def test_bm25_prefers_rare_terms_and_short_rows(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common rare filler filler filler filler"), (4, "other $x.y")], "id int, text string")
    asked = spark.createDataFrame([(0, "rare")], "query_id int, token string")
    got = search.bm25(search.postings(docs, "id", "text"), search.corpus(docs, "text"), asked, "id", 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]
    assert spark.range(1).select(search.tokens(F.lit("Fn_a $x.y É-z"))).first()[0] == ["fn_a", "$x.y", "é", "z"]
