import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import ignore
from quarry.sources import tree, walk

TREE = [
    "pkg/__init__.py", "pkg/_own.py", "pkg/.hidden.py", "pkg/a.py", "pkg/build/b.py", "pkg/gen/c.py", "pkg/gen/keep.py", "out/d.py", "out/deep/e.py", "x/logs/f.py", "x/y/logs/g.py", "x/logs1.py", "x/z[1].py",
    "x/z1.py", "x/z2.py", "x/q b.py", "x/#c.py", "x/!d.py", "doc/a/b/c/h.py", "doc/h.py", "doc/i.py", "node_modules/j.py", ".github/k.py", "tmp.py", "sub/tmp.py", "sub/only/tmp.py", "a.b+c.py", "sub/l.py", "aXb+c.py",
]
IGNORE = {
    "": "# a comment\n\n/out/*\n!/out/deep/\nlogs/\nz[13-9].py\n\\#c.py\n\\!d.py\ndoc/**/h.py\n/tmp.py  \r\na.b+c.py\nq\\ b.py\n[z-a].py\n",
    "pkg": "gen/\n!keep.py\n**/_o*.py\n",
    "sub": "*.py\n!l.py\n!only\n",
    "sub/only": "!tmp.p?\n",
}


def test_listing_and_ignore_rules_equal_the_version_control(spark, tmp_path):
    for path in TREE:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    os.symlink(tmp_path / "pkg", tmp_path / "again")
    listed = {r.path for r in tree.listing(spark, f"file://{tmp_path}").collect()}
    read = {p for p in TREE if not p.startswith(("node_modules/", "pkg/build/"))}
    assert listed == read
    assert {r.path for r in tree.snapshot(spark, str(tmp_path)).select("path").collect()} == read  # no repository: no rules
    for folder, text in IGNORE.items():
        (tmp_path / folder / ".gitignore").write_text(text, newline="")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    told = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-z", "--others", "--exclude-standard"], check=True, capture_output=True).stdout.decode().split("\0")
    expected = {p for p in told if p in read}
    assert expected < read
    rows = tree.snapshot(spark, f"file://{tmp_path}").select("path", "lang", F.col("content").cast("string").alias("text")).collect()
    assert {r.path for r in rows} == expected and {(r.lang, r.text) for r in rows} == {("python", "x = 1\n")}
    some = ["pkg/__init__.py", "pkg/gen/keep.py", "gone.py", "out/d.py"]
    assert [r.path for r in tree.snapshot(spark, str(tmp_path), only=some).select("path").collect()] == ["pkg/__init__.py"]


def test_walks_in_many_rounds_and_missing_roots(spark, tmp_path, monkeypatch):
    for n in range(12):
        (tmp_path / f"a{n % 3}/b{n}").mkdir(parents=True)
        (tmp_path / f"a{n % 3}/b{n}/_{n}.py").write_text("")
    monkeypatch.setattr(walk, "BUDGET", 4)  # tasks of this session read it when they are sent
    assert walk.walked(spark, str(tmp_path)).count() == 12
    with pytest.raises(FileNotFoundError):
        walk.walked(spark, str(tmp_path / "none"))
    assert not walk.reachable("viewfs://cluster/x")


def test_rules_of_nothing(spark):
    none = spark.createDataFrame([("a/.gitignore", None), (".gitignore", ""), ("b/.gitignore", "# x\n/\n!\n")], "path string, text string")
    rules = ignore.rules(none)
    assert rules.count() == 0
    assert ignore.ignored(spark.createDataFrame([("a/b",)], "path string"), rules).count() == 0
