"""Byte-pair encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece has exactly one last token in its encoding. An automaton over the vocabulary finds the tokens that end at
each byte; a token is the last one of the prefix if it is compatible with the last token of the prefix before it, that is, if no
merge across their border would have come before the merges that made them. Back-pointers from the end give the exact ids.

The vocabulary is a file in the format of the tokenizers library (byte-level BPE); the driver reads it and sends it to the
executors once (about 2 MB, whatever the input).

Defined cases: a null text counts as empty and has no token; a very long text is encoded in segments cut where no piece can
cross; special tokens in a text are found first, as the library does; rows that repeat are encoded each for itself; extra columns
pass through, but for those that bear the name of a column that is added, whose place the added one takes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.llm.common import read_table

#: The published split pattern of byte-level BPE (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of these characters only, in the terms of the faster standard module.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
_UNUSUAL = rf"[^\n\t\r -~{_LETTERS}]"
CACHED_PIECES = 250_000
CACHED_PAIRS = 400_000
SEGMENT = 1 << 20
_NEVER = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str) -> dict:
    """Plain data, for a broadcast: tokens (id to bytes), special (text to id) and merges in order of rank."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    symbols = byte_symbols()
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: bytes(symbols[c] for c in s) for s, i in ids.items() if s not in special}
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
    return {"tokens": tokens, "special": special, "merges": merges}


def encoder(data: dict) -> Encoder:
    """The encoder of a vocabulary, built when first asked for and kept beside it, so once for each Python worker."""
    if "encoder" not in data:
        data["encoder"] = Encoder(data)
    return data["encoder"]


class Encoder:
    def __init__(self, data: dict):
        import ahocorasick
        import regex

        self.tokens, self.special = data["tokens"], data["special"]
        self.find_any, self.find_plain, self.unusual = regex.compile(PIECES).findall, re.compile(_PLAIN).findall, re.compile(_UNUSUAL).search
        self.merged, parts = {}, {}
        for rank, (a, b, ab) in enumerate(data["merges"]):
            self.merged.setdefault((a, b), rank)
            parts.setdefault(ab, (a, b, rank))
        # the pieces at a token's right and left edge while it was being made, each with the rank of the merge that used it up
        self.right, self.left = {}, {}
        for token in self.tokens:
            for side, edge in ((self.right, 1), (self.left, 0)):
                edges, at, until = [], token, _NEVER
                while True:
                    edges.append((at, until))
                    if at not in parts:
                        break
                    until, at = parts[at][2], parts[at][edge]
                side[token] = edges
        self.automaton = ahocorasick.Automaton()
        for token, own in self.tokens.items():
            if token not in parts or self.whole(parts[token]):
                self.automaton.add_word(own.decode("latin-1"), (token, len(own)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.numbers = {i: str(i) for i in [*self.tokens, *self.special.values()]}
        self.data = self.tokens | {i: s.encode() for s, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def whole(self, made: tuple[int, int, int]) -> bool:
        """Whether encoding a token's own bytes gives that token: nothing merges across its last border before that merge does."""
        a, b, rank = made
        return self.border(a, b, rank)

    def border(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether the border between two neighbouring tokens stands until a rank. Equal merges go from left to right, so a tie with the left token's own merge leaves the border and one with the right token's does not."""
        for p, p_until in self.right[a]:
            for q, q_until in self.left[b]:
                rank = self.merged.get((p, q))
                if rank is not None and rank < before and rank < p_until and rank <= q_until:
                    return False
        return True

    def fits(self, pair: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self.border(pair >> 20, pair & 0xFFFFF)
        return found

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.unusual(text) else self.find_plain(text)

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8").decode("latin-1")
        last, size, known = [0] * len(data), [0] * len(data), self.pairs.get
        for end, (token, length) in self.automaton.iter(data):
            if size[end]:
                continue
            before = end - length
            if before >= 0:
                if not size[before]:
                    continue
                pair = last[before] << 20 | token
                fits = known(pair)
                if not (self.fits(pair) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return tuple(out)

    def segment(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.pieces, out.extend
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= CACHED_PIECES:
                    known.clear()
                ids = self.piece(piece)
                if len(piece) <= 64:
                    known[piece] = ids
            extend(ids)
        return out

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, segment by segment."""
        for i, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if i % 2:
                yield [self.special[part]]
            else:
                for segment in cut(part):
                    yield self.segment(segment)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")


_CUT = re.compile(r"\S\s")


def cut(text: str) -> Iterator[str]:
    """Segments that end where white space begins, so that no piece crosses a cut."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        end = found.start() + 1 if found else len(text)
        yield text[at:end]
        at = end


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs without text, with n_tokens, ids (if asked for), ids_sha256 and decoded_sha256."""
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if i != at]
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema.fields[i] for i in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(held.value)
        numbers = use.numbers.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n, ids_of, ids_sha, decoded_sha = [], [], [], []
                for text in part.column(at):
                    total, ids, a, b = 0, [], hashlib.sha256(), hashlib.sha256()
                    for found in use.encode(text.as_py() or ""):
                        if found:
                            a.update((("," if total else "") + ",".join(map(numbers, found))).encode())
                            total += len(found)
                            b.update(use.decode(found).encode())
                            if with_ids:
                                ids += found
                    n.append(total)
                    ids_of.append(ids)
                    ids_sha.append(a.hexdigest())
                    decoded_sha.append(b.hexdigest())
                columns = [part.column(i) for i in kept] + [pa.array(n, pa.int64())]
                columns += [pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with text, from its column ids (null: null text)."""
    encoded = encoded.drop("text")
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))
    at = encoded.columns.index("ids")
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoder(held.value).decode
        for batch in batches:
            texts = [None if x.as_py() is None else back(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each document, with their digests; a null or empty text has no id, rows that repeat are encoded each for itself, other columns end here."""
    return encode(docs.select("doc_id", "lang", "source", "text"))
