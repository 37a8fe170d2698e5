"""Reader of compiler indexes in the SCIP protobuf format, a document at a time, and byte offsets in its three encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCES = "tool string, rel_path string, encoding int, symbol string, roles int, start_line int, start_char int, end_line int, end_char int"
#: Bytes of a character's unit in each position encoding: UTF-8, UTF-16, UTF-32 (fixed values).
UNITS = {1: 1, 2: 2, 3: 4}
DEFAULT_UNITS = 2
#: The encoding of tools whose indexes do not name one (fixed values).
TOOL_UNITS = {
    "scip-go": 1,
    "scip-python": 2,
    "scip-typescript": 2,
    "scip-java": 2,
    "scip-kotlin": 2,
    "scip-dotnet": 2,
    "scip-dart": 2,
    "scip-clang": 1,
    "scip-ruby": 1,
    "scip-php": 1,
    "rust-analyzer": 2,
}


def encoding_of(tool: str, declared: int) -> int:
    """What columns count: as the index says, else as the tool does; an unknown tool that does not say is an error."""
    if declared:
        return declared
    if tool not in TOOL_UNITS:
        raise ValueError(f"{tool!r} does not say what its columns count; known are {', '.join(sorted(TOOL_UNITS))}")
    return TOOL_UNITS[tool]


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number does not end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def signed(value: int) -> int:
    """An int32 that was written as an unsigned number."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message; groups are refused."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is longer than its message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def packed(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(signed(value))
    return out


def span(parts: list[int]) -> tuple[int, int, int, int] | None:
    """Three numbers where a range ends on its own line, four otherwise."""
    if len(parts) == 3:
        return parts[0], parts[1], parts[0], parts[2]
    return tuple(parts) if len(parts) == 4 else None


def typed_span(data: memoryview, lines: bool) -> tuple[int, int, int, int]:
    """A range as a message of its own: of one line (line, start, end) or of several (line, start, line, end)."""
    held = {number: signed(value) for number, value in fields(data) if not isinstance(value, memoryview)}
    at = lambda number: held.get(number, 0)
    return (at(1), at(2), at(3), at(4)) if lines else (at(1), at(2), at(1), at(3))


def occurrence(data: memoryview) -> tuple | None:
    """(symbol, roles, range); a range as a message wins over one as a list of numbers."""
    numbers, symbol, roles, typed = [], "", 0, None
    for number, value in fields(data):
        if number == 1:
            numbers += packed(value) if isinstance(value, memoryview) else [signed(value)]
        elif number == 2:
            symbol = bytes(value).decode("utf-8", "replace")
        elif number == 3:
            roles = signed(value)
        elif number in (8, 9):
            typed = typed_span(value, number == 9)
    found = typed or span(numbers)
    return (symbol, roles, *found) if found else None


def relationship(data: memoryview) -> tuple[str, bool]:
    """(symbol, whether it is implemented)."""
    symbol, implements = "", False
    for number, value in fields(data):
        if number == 1:
            symbol = bytes(value).decode("utf-8", "replace")
        elif number == 3:
            implements = bool(value)
    return symbol, implements


def symbol_info(data: memoryview) -> tuple[str, int, str, list[str]]:
    """(symbol, kind, documentation, symbols that it implements)."""
    symbol, kind, said, implements = "", 0, [], []
    for number, value in fields(data):
        if number == 1:
            symbol = bytes(value).decode("utf-8", "replace")
        elif number == 3:
            said.append(bytes(value).decode("utf-8", "replace"))
        elif number == 4:
            target, is_implementation = relationship(value)
            if is_implementation:
                implements.append(target)
        elif number == 5:
            kind = signed(value)
    return symbol, kind, "\n".join(said), implements


def document(data: memoryview) -> tuple[str, int, list[tuple], list[tuple]]:
    """(path, encoding, occurrences, symbols)."""
    path, encoding, rows, symbols = "", 0, [], []
    for number, value in fields(data):
        if number == 1:
            path = bytes(value).decode("utf-8", "replace")
        elif number == 2 and (row := occurrence(value)):
            rows.append(row)
        elif number == 3:
            symbols.append(symbol_info(value))
        elif number == 6:
            encoding = value
    return path, encoding, rows, symbols


def tool(data: memoryview) -> str:
    for number, value in fields(data):
        if number == 2:  # tool_info
            for inner, name in fields(value):
                if inner == 1:
                    return bytes(name).decode("utf-8", "replace")
    return ""


OCCURRENCE = "struct<symbol:string,roles:int,start_line:int,start_char:int,end_line:int,end_char:int>"
SYMBOL = "struct<symbol:string,kind:int,doc:string,implements:array<string>>"
DOCUMENTS = f"tool string, built double, rel_path string, encoding int, occurrences array<{OCCURRENCE}>, symbols array<{SYMBOL}>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(DOCUMENTS) of all indexes below a path, a row for each document; built is the index file's time.

    Spark hands an index over as one value, so one file must stay below 2 GB; the documents in it are decoded one at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DOCUMENTS))
    of = ("symbol", "roles", "start_line", "start_char", "end_line", "end_char"), ("symbol", "kind", "doc", "implements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, built in zip(batch.column(0), batch.column(1).to_pylist()):
                data, by = memoryview(content.as_buffer()).cast("B"), ""
                for number, value in fields(data):
                    if number == 1:
                        by = tool(value)
                    elif number == 2:
                        rel, encoding, rows, symbols = document(value)
                        row = {"tool": [by], "built": [built], "rel_path": [rel], "encoding": [encoding], "occurrences": [[dict(zip(of[0], r)) for r in rows]], "symbols": [[dict(zip(of[1], x)) for x in symbols]]}
                        yield pa.RecordBatch.from_pydict(row, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content", F.col("modificationTime").cast("double").alias("built")).mapInArrow(run, DOCUMENTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(OCCURRENCES) of all indexes below a path."""
    return documents(spark, path).select("tool", "rel_path", "encoding", F.explode("occurrences").alias("o")).select("tool", "rel_path", "encoding", "o.*")


def placed(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(tool, file_id, start_byte, end_byte, symbol, definition): occurrences of documents (with file_id) in bytes of texts (file_id, text).

    A text is split into lines once for all that a document says about it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, units, out = Text(row["text"] or ""), encoding_of(row["tool"], row["encoding"]), []
                for o in row["occurrences"] or []:
                    a = text.byte(o["start_line"], o["start_char"], units)
                    out.append((row["tool"], row["file_id"], a, max(a, text.byte(o["end_line"], o["end_char"], units)), o["symbol"], bool(o["roles"] & 1)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["tool", "file_id", "start_byte", "end_byte", "symbol", "definition"])

    joined = docs.select("tool", "file_id", "encoding", "occurrences").join(texts.select("file_id", "text"), "file_id")
    return joined.mapInArrow(run, "tool string, file_id long, start_byte long, end_byte long, symbol string, definition boolean")


def definitions(occurrences: DataFrame) -> DataFrame:
    return occurrences.where((F.col("roles").bitwiseAND(1) == 1) & ~F.col("symbol").startswith("local "))


class Text:
    """A text's lines and the byte that each begins at."""

    def __init__(self, text: str):
        self.lines, self.starts, at = text.split("\n"), [], 0
        for line in self.lines:
            self.starts.append(at)
            at += len(line.encode()) + 1
        self.size = at - 1

    def byte(self, line: int, column: int, encoding: int = DEFAULT_UNITS) -> int:
        """The UTF-8 byte of a line's column, counted in the encoding's units; a column beyond the line is its end."""
        if line >= len(self.lines):
            return self.size
        row, unit = self.lines[line], UNITS.get(encoding, UNITS[DEFAULT_UNITS])
        if unit == 1:
            return self.starts[line] + min(column, len(row.encode()))
        if unit == 2:  # a character beyond the basic plane has two units
            return self.starts[line] + len(row.encode("utf-16-le")[: 2 * column].decode("utf-16-le", "ignore").encode())
        return self.starts[line] + len(row[:column].encode())


def byte_offset(text: str, line: int, column: int, encoding: int = DEFAULT_UNITS) -> int:
    return Text(text).byte(line, column, encoding)
