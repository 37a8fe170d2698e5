"""Sharding by jump consistent hashing, in DataFrame operations only.

A key and the number of shards decide a row's shard: a pseudo-random walk of the key jumps forward through shard numbers and
stops at the last one below the number of shards. With one shard more, the walk is the same and only rows that would jump into
the new shard move. No ring table is kept and nothing is shuffled to find a shard.

The walk's generator is x -> (x * x + c) mod p over numbers below 2**31, so that products fit a 64-bit integer exactly and any
SQL engine can repeat it. Within a shard, rows stand in an order that depends on key and text alone: a number below p that the
generator makes of both, then key, size and checksum. Ranges of that number are counted and numbered side by side, so no shard lands
in one task, and rows that repeat are counted by the part of the written table that holds them, so neither does a group of copies.

Defined cases: a null key walks as key -1 (all such rows share a shard); rows with equal keys share a shard; a null text has no
bytes; rows that repeat both key and text take neighbouring slots in any order; extra columns pass through, but for those that bear
the name of a column that is added (size, text_crc32, shard, slot), whose place the added one takes; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import packed, read_table, unpacked, written

PRIME = 2147483647
SHARDS = 40
#: Rows that one task numbers within a shard, about; a shard has as many pieces as its share of rows asks for.
PIECE_ROWS = 50_000


def seed(key: Column) -> Column:
    """A state in [1, PRIME) from an integer key."""
    k = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    low, high = F.pmod(k, F.lit(65_536)), F.pmod(F.floor(k / F.lit(65_536).cast("decimal(20,0)")).cast("long"), F.lit(PRIME - 1))
    return step(step(step(F.pmod(low * 48_271 + high * 40_692 + 12_345, F.lit(PRIME)))))


def step(x: Column) -> Column:
    # squares alone fall into short cycles; the linear part and the constant keep them apart
    return F.pmod(F.pmod(x * x, F.lit(PRIME)) + x * 48_271 + 11, F.lit(PRIME))


def jump(key: Column, shards: int) -> Column:
    """The shard of a key: at most one step for each shard, about ln(shards) that change anything."""
    start = F.struct(seed(key).alias("x"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def move(at, _):
        x = step(at["x"])
        far = F.floor((at["j"] + 1) * (F.lit(float(PRIME)) / (x + 1).cast("double"))).cast("long")
        go = at["j"] < shards
        return F.struct(F.when(go, x).otherwise(at["x"]).alias("x"), F.when(go, at["j"]).otherwise(at["b"]).alias("b"), F.when(go, far).otherwise(at["j"]).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, move, lambda at: at["b"]).cast("int")


def place(key: Column, crc: Column) -> Column:
    """Where in its shard a row stands: a number in [0, PRIME), spread evenly even if all rows share a key."""
    return step(F.pmod(seed(key) + crc, F.lit(PRIME)))


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """rows (key, size, crc and whatever goes along) with shard and slot: 0, 1, 2, ... within each shard."""
    own = written(rows.withColumns({"shard": jump(F.col("key"), shards), "at": place(F.col("key"), F.col("crc")), "part": F.spark_partition_id()}))
    alike = ["at", "key", "crc", "size", "part"]
    groups = own.groupBy("shard", *alike).agg(F.count(F.lit(1)).alias("n"))
    pieces = max(1, -(-own.count() // (shards * PIECE_ROWS)))
    groups = written(groups.withColumn("piece", F.floor(F.col("at") * pieces / F.lit(PRIME)).cast("int")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = groups.groupBy("shard", "piece").agg(F.sum("n").alias("c"))  # shards x pieces rows
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy(*[F.col(c) for c in alike]).rowsBetween(Window.unboundedPreceding, -1)
    first = groups.withColumn("b", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "piece"]).select(*[F.col(c).alias(f"g_{c}") for c in alike], (F.col("start") + F.col("b")).alias("first"), "n")
    first = written(first)
    same = F.lit(True)
    for c in alike:
        same = same & (F.col(c).eqNullSafe(F.col(f"g_{c}")) if c == "key" else F.col(c) == F.col(f"g_{c}"))
    joined = own.join(first, same)
    row = F.row_number().over(Window.partitionBy(*[f"g_{c}" for c in alike]).orderBy("g_at"))
    slotted = joined.where("n = 1").withColumn("slot", F.col("first")).unionByName(joined.where("n > 1").withColumn("slot", F.col("first") + row - 1))
    return slotted.drop("at", "part", "first", "n", *[f"g_{c}" for c in alike])


def measured(docs: DataFrame) -> tuple[Column, Column, Column]:
    """key, size and crc of a row of documents."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return F.col("doc_id").cast("long").alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("crc")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, shard and slot."""
    own = assigned(packed(docs, *measured(docs)), shards)
    return unpacked(own, F.col("size").alias("size"), F.col("crc").alias("text_crc32"), F.col("shard").alias("shard"), F.col("slot").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / F.lit(PIECE_ROWS))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return assigned(docs.select(*measured(docs)), SHARDS).select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), jump(F.col("key"), SHARDS + 1).alias("grown_shard")
    )


def _sql_step(x: str) -> str:
    return f"((({x}) * ({x})) % {PRIME} + ({x}) * 48271 + 11) % {PRIME}"


def _sql_jump(shards: int) -> str:
    none = "{'x': 0::BIGINT, 'b': 0::BIGINT, 'j': 0::BIGINT}"
    return f"""list_reduce(list_concat([{{'x': x0, 'b': -1::BIGINT, 'j': 0::BIGINT}}], list_transform(range({shards}), lambda i: {none})),
    lambda s, i: CASE WHEN s.j < {shards} THEN {{'x': {_sql_step("s.x")}, 'b': s.j, 'j': CAST(floor((s.j + 1) * ({PRIME}::DOUBLE / ({_sql_step("s.x")} + 1)::DOUBLE)) AS BIGINT)}} ELSE s END).b"""


#: The walk as a fold over as many steps as there are shards; the checksum as a fold over a text's bytes, with the table of its polynomial.
ORACLE = f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id, -1)::BIGINT AS k FROM documents),
m AS (
  SELECT doc_id, CAST(octet_length(encode(t)) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc,
    ((((k % 65536) + 65536) % 65536) * 48271 + ((((k >> 16) % {PRIME - 1}) + {PRIME - 1}) % {PRIME - 1}) * 40692 + 12345) % {PRIME} AS s0
  FROM d, crc_table),
s1 AS (SELECT *, {_sql_step("s0")} AS a FROM m), s2 AS (SELECT *, {_sql_step("a")} AS b2 FROM s1), s3 AS (SELECT *, {_sql_step("b2")} AS x0 FROM s2),
w AS (SELECT *, (x0 + crc) % {PRIME} AS p0, {_sql_jump(SHARDS)} AS shard, {_sql_jump(SHARDS + 1)} AS grown FROM s3)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY {_sql_step("p0")}, doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM w
"""
