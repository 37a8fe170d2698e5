"""Facts from source texts: definitions, references and imports, one row of arrays for each file.

Python is read with its own grammar. Languages with braces are read by a scanner of words and brackets: definitions by their key
words, bodies by matching braces, calls by a name before a parenthesis, receivers by what stands before the name.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFINITION = "struct<kind:string,name:string,start_byte:bigint,end_byte:bigint,body_end:bigint,line:int>"
REFERENCE = "struct<kind:string,name:string,receiver:string,is_member:boolean,receiver_self:boolean,site:bigint,line:int>"
IMPORT = "struct<module:string,symbol:string,alias:string,line:int>"
SCHEMA = f"path string, lang string, reason string, definitions array<{DEFINITION}>, refs array<{REFERENCE}>, imports array<{IMPORT}>"


class Lines:
    """Byte offsets of lines and columns."""

    def __init__(self, text: str):
        self.starts, at = [0], 0
        for line in text.split("\n")[:-1]:
            at += len(line.encode()) + 1
            self.starts.append(at)

    def byte(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column


def python(text: str) -> tuple[list, list, list]:
    tree, lines, data = ast.parse(text), Lines(text), text.encode()
    defs, refs, imports = [], [], []

    def name_at(node, name: str) -> int:
        at = lines.byte(node.lineno, node.col_offset)
        return data.index(name.encode(), at + (5 if isinstance(node, ast.ClassDef) else 3))

    def visit(node, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            is_class = isinstance(child, ast.ClassDef)
            if is_class or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = name_at(child, child.name)
                kind = "class" if is_class else "method" if in_class else "function"
                defs.append((kind, child.name, start, start + len(child.name.encode()), lines.byte(child.end_lineno, child.end_col_offset), child.lineno))
                for base in child.bases if is_class else []:
                    if isinstance(base, ast.Name):
                        refs.append(("IMPLEMENTS", base.id, "", False, False, lines.byte(base.lineno, base.col_offset), base.lineno))
            elif isinstance(child, ast.Call):
                called = child.func
                if isinstance(called, ast.Name):
                    refs.append(("CALLS", called.id, "", False, False, lines.byte(called.lineno, called.col_offset), called.lineno))
                elif isinstance(called, ast.Attribute):
                    end = lines.byte(called.end_lineno, called.end_col_offset)
                    receiver = called.value.id if isinstance(called.value, ast.Name) else ""
                    refs.append(("CALLS", called.attr, receiver, True, False, end - len(called.attr.encode()), called.end_lineno))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, "", a.asname or "", child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend(("." * child.level + (child.module or ""), "" if a.name == "*" else a.name, a.asname or "", child.lineno) for a in child.names)
            visit(child, is_class)

    visit(tree, False)
    return defs, refs, imports


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_DEFINES = re.compile(r"\b(class|interface|trait|struct|enum)\s+([A-Za-z_$][\w$]*)|\b(?:function|func|fn)\s*(?:\(\s*(\w+)?[^)]*\)\s*)?([A-Za-z_$][\w$]*)\s*(?:<[^>{]*>|\[[^\]{]*\])?\s*\(|\btype\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b")
_METHOD = re.compile(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|async|final|abstract|override)\s+)*(?:[\w<>\[\], ?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^(){};]*\)\s*(?::\s*[\w<>\[\] |.]+|throws [\w, .]+)?\s*\{")
_CALL = re.compile(r"(?:(\$?[A-Za-z_]\w*|\))?\s*(\.|->|::|\?\.)\s*)?\b([A-Za-z_$][\w$]*)\s*\(")
_IMPORTS = {
    "go": re.compile(r"(?m)^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[^\"\n]+)\"\s*$"),
    "php": re.compile(r"(?m)^\s*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;"),
    "java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?(?P<module>[\w.]+)(?:\.\*)?\s*;"),
    "rust": re.compile(r"(?m)^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+)(?:\s+as\s+(?P<alias>\w+))?\s*;"),
    "c": re.compile(r"(?m)^\s*#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]"),
}
_SCRIPT_IMPORT = re.compile(r"\bimport\s+(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}\s*)?(?:\*\s+as\s+(?P<all>[\w$]+)\s*)?(?:from\s*)?[\"'](?P<module>[^\"'\n]+)[\"']|\brequire\(\s*[\"'](?P<required>[^\"'\n]+)[\"']\s*\)")
_NOT_CALLED = frozenset({"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "new", "sizeof", "typeof", "await", "super", "match", "foreach", "elseif", "and", "or", "not", "require", "import", "echo", "isset", "array", "list"})
BRACES = frozenset({"go", "typescript", "tsx", "javascript", "php", "java", "kotlin", "c", "cpp", "csharp", "rust", "scala", "swift", "dart"})


def braces(text: str, lang: str) -> tuple[list, list, list]:
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    close, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.end()
    points, total = [0], 0
    for c in text:
        total += len(c.encode())
        points.append(total)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda i: bisect_left(breaks, i) + 1
    defs, own = {}, {}
    for m in _DEFINES.finditer(bare):
        group = 2 if m[2] else 4 if m[4] else 5
        kind = "function" if group == 4 else "class"
        if group == 4 and m[3] is not None or (lang == "go" and group == 4 and re.match(r"func\s*\(", m[0])):
            kind = "method"
        open_ = bare.find("{", m.end())
        stop = bare.find(";", m.end())
        end = close.get(open_, m.end()) if open_ >= 0 and not 0 <= stop < open_ else m.end()
        defs[m.start(group)] = (kind, m[group], m.start(group), m.end(group), end)
        if m[3]:
            own[m.start(group)] = m[3]
    if lang not in ("go", "rust", "c"):
        for m in _METHOD.finditer(bare):
            if m[1] not in _NOT_CALLED and m.start(1) not in defs:
                defs[m.start(1)] = ("function", m[1], m.start(1), m.end(1), close.get(m.end() - 1, m.end()))
    spans = sorted(defs.values(), key=lambda d: d[2])
    opened: list = []  # definitions that have begun and not ended, in order
    for d in spans:
        opened = [o for o in opened if o[4] > d[2]]
        if d[0] == "function" and opened and min(opened, key=lambda o: o[4] - o[2])[0] == "class":
            defs[d[2]] = ("method", *d[1:])
        opened.append(d)
    refs, opened, begun = [], [], 0
    for m in _CALL.finditer(bare):
        at, name = m.start(3), m[3]
        if name in _NOT_CALLED or at in defs:
            continue
        while begun < len(spans) and spans[begun][2] <= at:
            opened.append(spans[begun])
            begun += 1
        opened = [o for o in opened if o[4] > at]
        receiver = "" if m[1] in (None, ")") else m[1]
        bound = bool(opened and receiver and own.get(opened[-1][2]) == receiver)
        refs.append(("CALLS", name, receiver, m[2] is not None, bound, points[at], line(at)))
    imports = []
    if lang in ("typescript", "tsx", "javascript"):
        for m in _SCRIPT_IMPORT.finditer(text):
            module, n = m["module"] or m["required"], line(m.start())
            rows = [(module, "default", m["default"], n)] if m["default"] else []
            rows += [(module, "", m["all"], n)] if m["all"] else []
            for part in filter(None, map(str.strip, (m["names"] or "").split(","))):
                symbol, _, alias = (part.removeprefix("type ").split(" as ") + ["", ""])[0], None, (part.split(" as ") + [""])[1]
                rows.append((module, symbol.strip(), alias.strip(), n))
            imports += rows or [(module, "", "", n)]
    elif (pattern := _IMPORTS.get({"cpp": "c", "kotlin": "java", "scala": "java"}.get(lang, lang))) is not None:
        block = text
        if lang == "go":
            block = "\n".join(m[0].replace("import (", "") for m in re.finditer(r"import\s+\([^)]*\)|import\s+[^\n(]+", text))
        imports += [(m["module"], "", m.groupdict().get("alias") or "", line(max(text.find(m[0].strip()), 0))) for m in pattern.finditer(block)]
    rows = [(k, n, points[a], points[b], points[e], line(a)) for k, n, a, b, e in sorted(defs.values(), key=lambda d: d[2])]
    return rows, refs, imports


_SCRIPT = re.compile(r"(?is)<script\b([^>]*)>(.*?)</script>")
_TYPED = re.compile(r"lang\s*=\s*[\"']?(?:ts|tsx)\b", re.IGNORECASE)
#: Languages of pages and components, whose script blocks are read.
HOSTS = frozenset({"vue", "svelte", "html"})


def embedded(text: str) -> tuple[list, list, list]:
    """The facts of every script block, at the places where they stand in the whole text."""
    defs, refs, imports, read = [], [], [], False
    for m in _SCRIPT.finditer(text):
        try:
            d, r, i = braces(m[2], "typescript" if _TYPED.search(m[1]) else "javascript")
        except (ValueError, RecursionError):
            continue
        at, down = len(text[: m.start(2)].encode()), text.count("\n", 0, m.start(2))
        defs += [(k, n, a + at, b + at, e + at, line + down) for k, n, a, b, e, line in d]
        refs += [(k, n, receiver, member, own, site + at, line + down) for k, n, receiver, member, own, site, line in r]
        imports += [(*x[:3], x[3] + down) for x in i]
    return defs, refs, imports


def facts(lang: str, text: str | None) -> tuple[str, list, list, list]:
    """(reason, definitions, references, imports). What was seen before at the same place is not repeated."""
    if text is None:
        return "unreadable", [], [], []
    if lang != "python" and lang not in BRACES and lang not in HOSTS:
        return "no_parser", [], [], []
    try:
        defs, refs, imports = python(text) if lang == "python" else embedded(text) if lang in HOSTS else braces(text, lang)
    except (SyntaxError, ValueError, RecursionError):
        return "query_failed", [], [], []
    refs = list({(r[0], r[1], r[5]): r for r in reversed(refs)}.values())[::-1]
    imports = list({i[:3]: i for i in reversed(imports)}.values())[::-1]
    # a whole module that a narrower row of the same module covers says nothing
    named = {i[0] for i in imports if i[1] or i[2]}
    imports = [i for i in imports if i[1] or i[2] or i[0] not in named]
    claimed, kept = -1, []
    for d in sorted(defs, key=lambda d: d[2]):
        if d[2] >= claimed:
            kept.append(d)
            claimed = d[3]
    return "" if kept else "no_symbols", kept, refs, imports


def extract(files: DataFrame) -> DataFrame:
    """files (path, lang, text) as rows of SCHEMA; one pass, nothing shuffled."""
    names = {
        "definitions": ("kind", "name", "start_byte", "end_byte", "body_end", "line"),
        "refs": ("kind", "name", "receiver", "is_member", "receiver_self", "site", "line"),
        "imports": ("module", "symbol", "alias", "line"),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reason, *found = facts(row["lang"], row["text"])
                out = {"path": [row["path"]], "lang": [row["lang"]], "reason": [reason]}
                out |= {k: [[dict(zip(fields, r)) for r in rows]] for (k, fields), rows in zip(names.items(), found)}
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return files.select("path", "lang", "text").mapInArrow(run, SCHEMA)


def exploded(rows: DataFrame, what: str) -> DataFrame:
    """One row for each definition, reference or import."""
    return rows.select("path", "lang", F.explode(what).alias("_x")).select("path", "lang", "_x.*")
