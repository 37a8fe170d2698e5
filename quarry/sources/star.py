"""A code graph's fact tables, projected from a star schema.

customer rows become files, orders become definitions, line items become references and imports. The text below is read by Spark
and by the oracle alike; it holds no rule of the engine, only made-up facts: names with few and many definitions, classes that
span what follows them, member calls with every kind of receiver, and imports in each language's spelling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import modules as M
from quarry.sources.tables import Scratch, Stored, Tables, stamp

FACTS = """
files AS (
  SELECT c_custkey AS id, n_regionkey AS project_no, n_name AS owner,
    CASE c_custkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'typescript' WHEN 4 THEN 'php' ELSE 'elisp' END AS lang,
    CASE c_custkey % 6
      WHEN 0 THEN concat('src/n', CAST(c_nationkey AS STRING), '/f', CAST(c_custkey AS STRING), '.py')
      WHEN 1 THEN concat('n', CAST(c_nationkey AS STRING), '/f', CAST(c_custkey AS STRING), '.py')
      WHEN 2 THEN concat('n', CAST(c_nationkey AS STRING), '/p', CAST(c_custkey % 5 AS STRING), '/f', CAST(c_custkey AS STRING), '.go')
      WHEN 3 THEN concat('n', CAST(c_nationkey AS STRING), '/f', CAST(c_custkey AS STRING), '.ts')
      WHEN 4 THEN concat('N', CAST(c_nationkey AS STRING), '/F', CAST(c_custkey AS STRING), '.php')
      ELSE concat('n', CAST(c_nationkey AS STRING), '/f', CAST(c_custkey AS STRING), '.el') END AS path,
    c_nationkey AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ranked AS (SELECT o_orderkey AS k, o_custkey AS file_id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
defs AS (
  SELECT 1000000000 + k AS id, file_id,
    CASE p WHEN '1-URGENT' THEN 'class' WHEN '2-HIGH' THEN 'function' WHEN '3-MEDIUM' THEN 'function' WHEN '4-NOT SPECIFIED' THEN 'field' ELSE 'constant' END AS kind,
    CASE WHEN k % 10 < 3 THEN concat('fn', CAST(k % 40 AS STRING)) WHEN k % 10 < 8 THEN concat('fn', CAST(1000 + k % 3001 AS STRING)) ELSE concat('fn', CAST(10000000 + k AS STRING)) END AS name,
    CAST(rn * 1000 AS BIGINT) AS start_byte, CAST(rn * 1000 + 8 AS BIGINT) AS end_byte,
    CAST(rn * 1000 + CASE WHEN p = '1-URGENT' THEN 3900 ELSE 900 END AS BIGINT) AS body_end
  FROM ranked),
items AS (
  SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
aimed AS (
  SELECT i.*, o_custkey AS file_id, (i.supp * 13 + i.k) % (SELECT count(*) FROM customer) AS target
  FROM items i JOIN orders ON o_orderkey = i.k),
refs AS (
  SELECT a.k * 8 + a.n AS id, a.file_id,
    CASE WHEN a.flag = 'R' THEN 'REFERENCES' WHEN a.flag = 'A' AND a.n % 2 = 0 THEN 'IMPLEMENTS' ELSE 'CALLS' END AS kind,
    CASE WHEN a.supp % 4 = 3 AND a.n <= 3 AND fd.name IS NOT NULL THEN fd.name
      WHEN (a.part + a.n) % 10 < 3 THEN concat('fn', CAST(a.part % 40 AS STRING)) WHEN (a.part + a.n) % 10 < 6 THEN concat('fn', CAST(1000 + a.part % 3001 AS STRING))
      WHEN (a.part + a.n) % 10 < 8 THEN concat('fn', CAST(10000000 + a.part * 7 AS STRING)) ELSE concat('zz', CAST(a.part AS STRING)) END AS name,
    a.status = 'O' AND a.supp % 4 <> 0 AS is_member,
    CASE WHEN a.status <> 'O' OR a.supp % 4 IN (0, 2) THEN '' WHEN a.supp % 4 = 1 THEN CASE WHEN a.supp % 3 = 0 THEN 'self' ELSE 'x' END
      ELSE CASE WHEN t.lang = 'go' THEN concat('p', CAST(a.target % 5 AS STRING)) WHEN t.lang = 'php' THEN concat('F', CAST(a.target AS STRING)) ELSE concat('f', CAST(a.target AS STRING)) END END AS receiver,
    f.lang = 'go' AND a.status = 'O' AND a.supp % 8 = 5 AS receiver_self,
    d.start_byte + 10 + (a.part * 7 + a.n) % 880 AS site
  FROM aimed a JOIN defs d ON d.id = 1000000000 + a.k JOIN files f ON f.id = a.file_id JOIN files t ON t.id = a.target
    LEFT JOIN defs fd ON fd.file_id = a.target AND fd.start_byte = 1000),
imports AS (
  SELECT min(a.k * 8 + a.n) AS id, a.file_id, a.target,
    max(CASE WHEN a.n = 1 THEN coalesce(fd.name, '') ELSE '' END) AS symbol,
    max(CASE WHEN a.supp % 5 = 0 THEN concat('al', CAST(a.target % 97 AS STRING)) ELSE '' END) AS alias
  FROM aimed a JOIN files f ON f.id = a.file_id JOIN files t ON t.id = a.target LEFT JOIN defs fd ON fd.file_id = a.target AND fd.start_byte = 1000
  WHERE a.n <= 3 AND f.lang = t.lang AND a.file_id <> a.target
  GROUP BY a.file_id, a.target),
spelled AS (
  SELECT i.id, i.file_id, i.target, i.symbol, i.alias,
    CASE t.lang
      WHEN 'go' THEN concat('example.com/org/repo/n', CAST(t.nation AS STRING), '/p', CAST(t.id % 5 AS STRING))
      WHEN 'typescript' THEN CASE WHEN f.nation = t.nation THEN concat('./f', CAST(t.id AS STRING)) ELSE concat('../n', CAST(t.nation AS STRING), '/f', CAST(t.id AS STRING), '.js') END
      WHEN 'php' THEN concat('N', CAST(t.nation AS STRING), chr(92), 'F', CAST(t.id AS STRING))
      WHEN 'python' THEN CASE WHEN f.nation = t.nation THEN concat('.f', CAST(t.id AS STRING)) ELSE concat('..n', CAST(t.nation AS STRING), '.f', CAST(t.id AS STRING)) END
      ELSE concat('n', CAST(t.nation AS STRING), '.f', CAST(t.id AS STRING)) END AS module
  FROM imports i JOIN files f ON f.id = i.file_id JOIN files t ON t.id = i.target)"""


@dataclass
class Graph:
    """The fact tables of a code graph."""

    files: DataFrame  # id, project_no, lang, path, module, package
    nodes: DataFrame  # id, file_id, kind, name, start_byte, end_byte, body_end; a module node has its file's id
    refs: DataFrame  # id, file_id, kind, name, is_member, receiver, receiver_self, site
    imports: DataFrame  # id, file_id, module (as written), symbol, alias, module_abs
    tables: Tables | None = None  # where derived tables are kept

    def derived(self, name: str, make) -> DataFrame:
        """A derived table, which may come in parts, kept beside the facts where these are stored."""
        if self.tables:
            return self.tables.table(name, make)
        made = make()
        return made if isinstance(made, DataFrame) else Stored(made).df


def with_modules(files: DataFrame) -> DataFrame:
    return files.withColumns({"module": M.module_name(F.col("path"), F.col("lang")), "package": M.directory(F.col("path"))})


def module_nodes(files: DataFrame) -> DataFrame:
    """One node for each file, of no width, at its first byte."""
    zero = F.lit(0).cast("long")
    return files.select("id", F.col("id").alias("file_id"), F.lit("module").alias("kind"), F.col("module").alias("name"), zero.alias("start_byte"), zero.alias("end_byte"), zero.alias("body_end"))


#: Line items that become references at once; more are taken in slices, so that what lies on disk meanwhile is bounded.
SLICE = 12_000_000


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored fact tables of a source, made when first asked for: every question reads them, as an index is read."""
    names = ("customer", "nation", "orders", "lineitem")
    tables = Tables.of(spark, sf_dir, stamp(spark, *[f"{sf_dir}/{n}.parquet" for n in names]))

    def read(what: str, **made: DataFrame) -> DataFrame:
        # tables are handed over as arguments, so that views of the user's stay as they are; what is made already is read in place of the text's own
        given = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names} | made
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(given)})\b", r"\1 {\2}", f"WITH {FACTS} {what}")
        return spark.sql(text, **given)

    files = tables.table("files", lambda: with_modules(read("SELECT id, project_no, lang, path FROM files")))
    nodes = tables.table("nodes", lambda: read("SELECT id, file_id, kind, name, start_byte, end_byte, body_end FROM defs").unionByName(module_nodes(files)))
    if {"refs", "imports"} <= tables.made.keys():
        return Graph(files, nodes, tables.made["refs"].df, tables.made["imports"].df, tables)

    defs = nodes.where("kind <> 'module'")
    # dealt by order, so that grouping and the join with orders move no row again
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    with Scratch() as scratch:
        aimed = scratch.keep(read("SELECT * FROM aimed", lineitem=items))
        parts = max(1, -(-aimed.count() // SLICE))
        slices = lambda column: [aimed if parts < 2 else aimed.where(F.pmod(F.xxhash64(column), F.lit(parts)) == i) for i in range(parts)]
        refs = tables.table("refs", lambda: [read("SELECT id, file_id, kind, name, is_member, receiver, receiver_self, site FROM refs", defs=defs, aimed=some) for some in slices("k")])
        imports = tables.table("imports", lambda: [with_absolute(read("SELECT id, file_id, module, symbol, alias FROM spelled", defs=defs, aimed=some), files) for some in slices("file_id")])
    return Graph(files, nodes, refs, imports, tables)


def with_absolute(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with module_abs, the module that each names in the importing file's language."""
    own = files.select(F.col("id").alias("f_id"), F.col("path").alias("f_path"), F.col("lang").alias("f_lang"))
    return imports.join(own, F.col("file_id") == F.col("f_id")).withColumn("module_abs", M.resolve_module(F.col("f_path"), F.col("f_lang"), F.col("module"))).drop("f_id", "f_path", "f_lang")
