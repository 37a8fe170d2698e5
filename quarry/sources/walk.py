"""Walking a tree by executors: Spark's own file reader passes over every name that starts with '_' or '.', among them __init__.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import files as X
from quarry.sources.tables import store

#: Entries that a task looks at before it hands on the folders that are left, so that no task walks a whole tree; bytes and rows of a batch.
BUDGET = 20_000
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1_000
LISTED = "path string, size long, mtime double"


def opened(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else root)


def reachable(root: str) -> bool:
    """Whether the file system of a root can be opened without Spark: local and shared folders, object stores, HDFS with its library."""
    try:
        opened(root)
    except (ValueError, OSError, ImportError, NotImplementedError):
        return False
    return True


def there(root: str, path: str) -> bool:
    system, base = opened(root)
    return system.get_file_info(f"{base.rstrip('/')}/{path}".rstrip("/") or "/").type.name in ("File", "Directory")


def _visit(root: str) -> Callable:
    def visit(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyarrow import fs

        system, base = opened(root)
        base = base.rstrip("/")
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("folder", pa.bool_())])
        for folder in (f for batch in batches for f in batch.column("path").to_pylist()):
            todo, rows, looked = [folder], [], 0
            while todo and looked < BUDGET:
                here = todo.pop()
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{here}".rstrip("/") or "/", allow_not_found=True))
                except PermissionError:
                    continue
                looked += len(found) + 1
                for one in found:
                    path = f"{here}/{one.base_name}".lstrip("/")
                    if system.type_name == "local" and os.path.islink(one.path):
                        continue
                    if one.type == fs.FileType.File:
                        rows.append((path, one.size, one.mtime.timestamp(), False))
                    elif one.type == fs.FileType.Directory and not X.never_read(one.base_name):
                        todo.append(path)
            rows += [(path, None, None, True) for path in todo]
            for at in range(0, len(rows), BUDGET):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + BUDGET]), schema)], schema=schema)

    return visit


def walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of every file below a root but those in folders that are never read; links are not followed."""
    if not there(root, ""):
        raise FileNotFoundError(f"no such folder: {root}")
    out, open_ = None, spark.createDataFrame([("",)], "path string")
    while True:
        met = store(open_.mapInArrow(_visit(root), LISTED + ", folder boolean"))
        files = met.where("NOT folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        left = met.where("folder").select("path")
        if left.isEmpty():
            return out
        open_ = left.repartition("path")


def _read(root: str, most: int) -> Callable:
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = opened(root)
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("content", pa.binary())])
        rows, held = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            info = system.get_file_info(f"{base.rstrip('/')}/{path}")
            if info.type.name != "File":
                continue
            content = None
            if info.size <= most:
                try:
                    with system.open_input_stream(info.path) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError):
                    continue
            rows.append((path, info.size, info.mtime.timestamp(), content))
            held += len(content or b"")
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield made()
                rows, held = [], 0
        if rows:
            yield made()

    return read


def contents(root: str, paths: DataFrame, most: int = X.MAX_BYTES) -> DataFrame:
    """(path, size, mtime, content) of the files among some paths (path) that are there now; content is null past so many bytes."""
    return paths.select("path").repartition("path").mapInArrow(_read(root, most), LISTED + ", content binary")


def folders_of(path) -> object:
    """All folders above a path, '' for the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
