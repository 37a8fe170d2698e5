import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.operators import fleet, incremental, measure
from quarry.sources import projects


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_claims_and_members(spark):
    pairs = "root string, member string"
    reachable, held = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b")], pairs), spark.createDataFrame([("r", "b"), ("r", "b"), ("r", "c")], pairs)
    assert rows(fleet.sweep(reachable, held)) == [("r", "a", "claim"), ("r", "c", "release")]
    forbidden = spark.createDataFrame([("c",)], "path string")
    assert rows(fleet.members(reachable, spark.createDataFrame([("r", "r"), ("r", "c"), ("r", "d")], pairs), forbidden)) == [("r", "a"), ("r", "b"), ("r", "d")]


def test_verdicts_and_refusals(spark):
    judged = fleet.verdicts(spark.createDataFrame([("a", True, True, True), ("b", False, True, True), ("c", False, True, False), ("d", False, False, None)], "path string, exists boolean, parent_exists boolean, same_device boolean"))
    assert {r.path: r.verdict for r in judged.collect()} == {"a": "live", "b": "deleted", "c": "unmounted", "d": "unknown"}
    assert rows(fleet.survey(judged)) == [("deleted", 1, "b"), ("live", 1, "a"), ("unknown", 1, "d"), ("unmounted", 1, "c")]
    assert not fleet.prune_refused(judged).first()[0] and fleet.prune_refused(judged.limit(0)).first()[0] and fleet.prune_refused(judged.where("verdict <> 'live'").where("verdict = 'deleted'")).first()[0]


def test_settings(spark):
    projects = spark.createDataFrame([("p", ["r1", "r2"]), ("q", None)], "path string, roots array<string>")
    settings = spark.createDataFrame([("p", "depth", "1"), ("r1", "depth", "2"), ("r1", "floor", "3"), ("r2", "floor", "4"), ("q", "floor", "5")], "path string, key string, value string")
    assert rows(fleet.inherited(projects, settings)) == [("p", "depth", "1"), ("p", "floor", "3"), ("q", "floor", "5")]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert rows(fleet.nearest_key(keys("depht", "flor"), keys("depth", "floor", "languages"))) == [("depht", "depth"), ("flor", "floor")]
    assert rows(fleet.nearest_key(keys("flor", "q"), keys(*[f"known{i}" for i in range(1500)], "zfloor"))) == [("flor", "zfloor"), ("q", None)]


def test_retention_and_ledger(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("of"), F.col("id").alias("ts"))
    assert rows(fleet.retained(df, "of", "ts", 3)) == [(0, 44), (0, 46), (0, 48), (1, 45), (1, 47), (1, 49)]
    ledger = spark.createDataFrame([(1, 1, None), (2, 2, "x"), (2, 3, "y")], "ts int, id int, error string")
    assert [r.id for r in fleet.ledger(ledger, 2).collect()] == [3, 2] and [r.id for r in fleet.ledger(ledger, 5, True).collect()] == [3, 2]


def test_diff_ignores_times(spark):
    cols = "path string, sha256 string, mtime double"
    old, new = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 1.0)], cols), spark.createDataFrame([("a", "1", 9.0), ("b", "x", 1.0), ("d", "4", 1.0)], cols)
    changes = incremental.diff(old, new)
    assert rows(changes) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert rows(incremental.rewritten(old, new, changes).select("path", "sha256")) == [("a", "1"), ("b", "x"), ("d", "4")]


def test_scores_and_digest(spark):
    pairs = "g string, item int"
    truth, answer = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], pairs), spark.createDataFrame([("a", 1), ("a", 9), ("b", 3)], pairs)
    got = {r.g: (r.precision, r.recall, r.f1) for r in measure.scores(truth, answer, "g").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (1.0, 1.0, 1.0), None: (0.666667, 0.666667, 0.666667)}
    one, same, other = (measure.digest(df, "g", "item").first()[0] for df in (truth, truth.orderBy(F.desc("item")).repartition(3), answer))
    assert one == same != other and len(one) == 16


def test_settings_documents():
    assert projects.settings('{"exclude": ["a/*"], "enabled": false}') == {"exclude": ["a/*"], "enabled": False} and projects.settings("") == {}
    for text, why in (('{"exclud": []}', "here: there is no setting exclud .exclude is one"), ('{"enabled": 1}', "enabled must be a switch"), ('{"members": "x"}', "members must be a list"), ("[1]", "something else"), ("{", "cannot be parsed")):
        with pytest.raises(projects.ConfigError, match=why):
            projects.settings(text, "here")
    with pytest.raises(projects.ConfigError) as found:
        projects.settings('{"enabled": "yes", "languages": [1], "colour": true}')
    assert len(found.value.faults) == 3


def test_a_registry_of_claims(spark, tmp_path):
    known = projects.Registry(spark, f"file://{tmp_path}/registry")
    known.put(projects.claim(known.rows(), ["/r"], direct=True))
    known.put(projects.claim(known.rows(), ["/a", "/b", "/r"], root="/r"))
    got = {r.path: (r.roots, r.direct, r.enabled) for r in known.rows().collect()}
    assert got == {"/r": ([], True, True), "/a": (["/r"], False, True), "/b": (["/r"], False, True)}
    before = projects.digest(known.rows()).first()[0]
    known.put(projects.mark_indexed(known.rows(), "/a", counts=(5, 4, 3), capabilities={"go": ["defs"]}))
    known.put(projects.mark_indexed(known.rows(), "/a", error="broken"))
    row = known.rows().where("path = '/a'").first()
    assert (row.node_count, row.edge_count, row.resolved_edge_count, row.last_error, row.capabilities) == (5, 4, 3, "broken", {"go": ["defs"]}) and row.last_indexed > 0
    assert projects.digest(known.rows()).first()[0] != before
    assert projects.status(known.rows()).first()[:] == (3, 3, 1, 1, 1, 5, 4, 3)
    assert {r.path for r in projects.release(known.rows(), "/b", "/r").collect()} == {"/r", "/a"}
    left, dropped, released = projects.forget(known.rows(), ["/r"])
    assert (left.count(), {r.path for r in dropped.collect()}, {r.path for r in released.collect()}) == (0, {"/r"}, {"/a", "/b"})
    judged = known.rows().select("path", F.when(F.col("path") == "/a", "deleted").otherwise("live").alias("verdict"))
    assert [r.path for r in known.prune(judged).collect()] == ["/a"] and {r.path for r in known.rows().collect()} == {"/r", "/b"}
    with pytest.raises(ValueError, match="refused"):
        known.prune(judged.withColumn("verdict", F.lit("deleted")))


def test_command_line(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n\n\ndef two():\n    pass\n")
    (root / "skip.py").write_text("def three():\n    two()\n")
    (tmp_path / "settings").write_text('{"exclude": ["skip*"]}')
    said = lambda *words: cli.run(spark, cli.parser().parse_args(["--home", f"file://{tmp_path}/home", *words]))
    assert said("index", str(root), "--config", str(tmp_path / "settings"))["nodes"] == 3
    assert [r["name"] for r in said("neighbors", str(root), "two")["results"]] == ["one"]
    assert [r["name"] for r in said("find", str(root), "two")["results"]] == ["two"]
    assert [r["name"] for r in said("blast-radius", str(root), "two", "--depth", "2")["results"]] == ["one"]
    assert said("doctor", str(root))["files"] == [{"lang": "python", "tier": "symbols", "reason": "", "count": 1}]
    assert said("status")["projects"] == 1
    assert said("forget", str(root)) == {"dropped": [str(root)], "released": []} and said("status")["projects"] == 0


def test_places_that_are_no_project(spark):
    from quarry.functions import files as X

    df = spark.createDataFrame([("/",), ("/tmp/",), ("file:/usr",), ("/home/me",), ("/home/me/x",), ("/data",)], "p string")
    assert [r[0] for r in df.select(X.forbidden(F.col("p"), "/home/me/")).collect()] == [True, True, True, True, False, False]
