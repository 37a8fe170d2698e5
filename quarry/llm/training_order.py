"""Training-order materialisation.

Documents become sequences of a fixed number of token ids. Sequences are numbered 0, 1, 2, ... in the order of a hash of document and
text; a keyed Feistel permutation of those numbers gives each its slot in the training order, without a sort of sequences and without
a table of the order. A power of four at least as large as their number is permuted, and a slot beyond the last is permuted again until
it falls within (cycle-walking). Shards are ranges of slots; each is written by one task in slot order as records of one size, so slot s
lies in shard s // shard_rows at byte (s % shard_rows) * stride, and a reader that stopped resumes there.

Numbers depend on doc_id and text alone, not on files, partitions or cores. They are found on a narrow table of counts, whose ranges
are summed side by side; rows that repeat are counted by the part of the token table that holds them, and as they make equal sequences
it is the same which of them takes which of their numbers.

Defined cases: a null or empty text has the end token alone; the last sequence of a document is filled up with the end token, and
n_tokens says how many are its own; rows that repeat get slots each for itself; a null doc_id is kept; extra columns are ignored;
an empty table gives no shard.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import Written, read_table, save, shared_dir, written

LENGTH = 256
SHARD_ROWS = 4096
KEY = 20_240_229
ROUNDS = 6
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each number below n (back: the number of each slot)."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = [np.uint64(zlib.crc32(f"{key}:{i}".encode())) for i in range(ROUNDS)]

    def mixed(half: np.ndarray, k: np.uint64) -> np.ndarray:
        h = (half + (k << np.uint64(32)) + k) * _A
        h = (h ^ (h >> np.uint64(29))) * _B
        return (h ^ (h >> np.uint64(32))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ mixed(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ mixed(right, k)
        return (left << shift) | right

    out = once(x.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks(path: str) -> dict:
    """Plain data, for a broadcast: a vocabulary file of ranks (token in base 64, rank)."""
    return {"ranks": {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}}


def encoding(data: dict):
    """The library's encoder of a vocabulary, built when first asked for and kept beside it, so once for each Python worker."""
    if "encoding" not in data:
        import tiktoken

        # a special token's pattern must not be empty; none is allowed in texts, so its name there is plain text
        data["encoding"] = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=data["ranks"], special_tokens={"<|end|>": max(data["ranks"].values()) + 1})
    return data["encoding"]


def tokenised(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(part, again, doc_id, h, n_tokens, ids): ids are 2 bytes each (4 where the vocabulary asks for it), filled up to whole sequences; h is the text's hash; again counts earlier rows of the part that equal this one. The end token is the first id that is free."""
    data = ranks(path or default_path())
    held = docs.sparkSession.sparkContext.broadcast(data)
    end = max(data["ranks"].values()) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoding(held.value).encode_to_numpy, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n_tokens, ids, again = [], [], []
                for key in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    again.append(seen.get(key, 0))
                    seen[key] = again[-1] + 1
                for text in part.column(3):
                    own = [encode(segment, disallowed_special=()) for segment in bpe.cut(text.as_py() or "")]
                    n_tokens.append(n := sum(map(len, own)) + 1)
                    filled = np.full(n + -n % length, end, kind)
                    if own:
                        filled[: n - 1] = np.concatenate(own)
                    ids.append(filled.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(again, pa.int64()), part.column(1), part.column(2), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary())], names)

    names = ["part", "again", "doc_id", "h", "n_tokens", "ids"]
    text = F.col("text").cast("string")
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), F.xxhash64(text.isNull(), text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "part int, again long, doc_id long, h long, n_tokens long, ids binary")


def starts(tokens: DataFrame, length: int = LENGTH, piece_rows: int = 100_000) -> DataFrame:
    """(p_id, p_h, p_part, start): the number of the first sequence of each document's rows within a part of the token table."""
    n_of = F.ceil(F.col("n_tokens") / F.lit(length)).cast("long")
    groups = tokens.groupBy("doc_id", "h", "part").agg(F.sum(n_of).alias("n")).withColumn("o", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h"))
    pieces = max(1, -(-tokens.count() // piece_rows))
    ranged = written(groups.withColumn("piece", F.floor((F.col("o").cast("double") / F.lit(2.0**64) + 0.5) * pieces).cast("int")))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each piece
    offsets = ranged.groupBy("piece").agg(F.sum("n").alias("c")).select("piece", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("piece").orderBy("o", "doc_id", "h", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("b", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, "piece")
    return numbered.select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("part").alias("p_part"), (F.col("from") + F.col("b")).cast("long").alias("start"))


def ordered(tokens: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> tuple[DataFrame, int]:
    """(slot, shard, number, doc_id, chunk, n_tokens, record) for each sequence of a written token table, and their number."""
    n_of = F.ceil(F.col("n_tokens") / F.lit(length)).cast("long")
    total = int(tokens.agg(F.coalesce(F.sum(n_of), F.lit(0))).first()[0])
    at = starts(tokens, length)
    met = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("part") == F.col("p_part"))
    placed = written(tokens.join(at, met).select("doc_id", (F.col("start") + F.col("again") * n_of).alias("start"), "n_tokens", "ids"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                number, row, chunk, n_tokens, record = [], [], [], [], []
                for i, (start, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 4)))):
                    many = -(-n // length)
                    size = len(ids) // many
                    for c in range(many):
                        number.append(start + c)
                        row.append(i)
                        chunk.append(c)
                        n_tokens.append(min(length, n - c * length))
                        record.append(ids[c * size : (c + 1) * size])
                slot = permuted(np.array(number, np.int64), total, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(slot // shard_rows), pa.array(number, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(chunk, pa.int32()), pa.array(n_tokens, pa.int32()), pa.array(record, pa.binary())],
                    ["slot", "shard", "number", "doc_id", "chunk", "n_tokens", "record"],
                )

    return placed.mapInArrow(deal, "slot long, shard long, number long, doc_id long, chunk int, n_tokens int, record binary"), total


def write_shards(sequences: DataFrame, total: int, path: str, shard_rows: int = SHARD_ROWS, codec: str = "zstd") -> DataFrame:
    """A table of shards at path: (shard, first_slot, rows, stride, crc32, content) and, slot by slot, doc_ids, chunks, n_tokens and numbers.

    content is the shard's records end to end, so a reader finds a record at (slot - first_slot) * stride; codec is the file's own
    compression ("none" to map files as they are). Slots are 0 to total - 1, so the ranges are equal and known beforehand, and task i
    writes range i. A shard is visible only when it is whole.
    """
    names = ["shard", "first_slot", "rows", "stride", "crc32", "content", "doc_ids", "chunks", "n_tokens", "numbers"]
    schema = "shard long, first_slot long, rows long, stride long, crc32 long, content binary, doc_ids array<long>, chunks array<int>, n_tokens array<int>, numbers array<long>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def whole() -> pa.RecordBatch:
            slots, records, *lists = (pa.concat_arrays([piece.column(i) for piece in held]) for i in range(1, 7))
            n, ends = len(records), np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1]
            content = records.buffers()[2][int(ends[0]) : int(ends[-1])]
            longs = [pa.array([v], pa.int64()) for v in (at, slots[0].as_py(), n, int(ends[1] - ends[0]), zlib.crc32(content))]
            return pa.RecordBatch.from_arrays([*longs, pa.array([content.to_pybytes()], pa.binary()), *[pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own) for own in lists]], names)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for first, last in zip(bounds, bounds[1:]):
                if first == last:
                    continue
                if held and shard[first] != at:
                    yield whole()
                    held = []
                at = int(shard[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield whole()

    shards = max(1, -(-total // shard_rows))
    dealt = sequences.select("shard", "slot", "record", "doc_id", "chunk", "n_tokens", "number").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    save(dealt.mapInArrow(pack, schema), path, codec)
    return sequences.sparkSession.read.schema(schema).parquet(path)


def resume(shards: DataFrame, slot: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The shards from the one that holds a slot on, in order."""
    return shards.where(F.col("shard") >= slot // shard_rows).orderBy("shard")


def stored(shards: DataFrame) -> DataFrame:
    """(slot, shard, byte, doc_id, chunk, n_tokens, number, record_crc32) of every record, as read back from the written shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, rows, stride, content, *lists in zip(*batch.columns):
                n, size, data = rows.as_py(), stride.as_py(), memoryview(content.as_buffer())
                at = np.arange(n)
                crc = [zlib.crc32(data[i * size : (i + 1) * size]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(at + first.as_py()), pa.array(np.full(n, shard.as_py())), pa.array(at * size), *[x.values for x in lists], pa.array(crc, pa.int64())], names)

    names = ["slot", "shard", "byte", "doc_id", "chunk", "n_tokens", "number", "record_crc32"]
    read = shards.select("shard", "first_slot", "rows", "stride", "content", "doc_ids", "chunks", "n_tokens", "numbers")
    return read.mapInArrow(run, "slot long, shard long, byte long, doc_id long, chunk int, n_tokens int, number long, record_crc32 long")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence stands: its slot, shard and byte, and a checksum of its record, as read back from the written shards."""
    tokens = Written(tokenised(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    sequences, total = ordered(tokens.df)
    tokens.drop()  # placed sequences are a table of their own
    return stored(write_shards(sequences, total, f"{shared_dir(spark)}/quarry/shards-{uuid.uuid4().hex}"))
