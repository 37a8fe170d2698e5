"""Traversal: one-hop questions for all definitions at once, and the bounded blast radius."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import contain, resolve
from quarry.sources.star import Graph
from quarry.sources.tables import store

#: Question: the direction it walks, and the kinds of link it walks along.
QUESTIONS = {
    "callers": ("up", ("CALLS",)),
    "callees": ("down", ("CALLS",)),
    "implementations": ("up", ("IMPLEMENTS",)),
    "references": ("up", ("REFERENCES", "CALLS")),
    "importers": ("up", ("IMPORTS",)),
    "imports": ("down", ("IMPORTS",)),
}
MAX_DEPTH = 8


LINK = ["src", "dst", "kind", "confidence", "evidence", "candidate_count", "resolved", "ref_id"]


def sources(graph: Graph, found: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """found (ref_id and others) with kind, file_id and src: each reference's enclosing definition, or its file's module; of all references or of some."""
    refs = (graph.refs if refs is None else refs).select(F.col("id").alias("ref_id"), "file_id", "kind")
    inside = graph.derived("enclosing", lambda: contain.enclosing(graph.refs, graph.nodes))
    return found.join(refs, "ref_id").join(inside, "ref_id", "left").withColumn("src", F.coalesce("enclosing", "file_id")).drop("enclosing")


def links(graph: Graph, found: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, confidence, evidence, candidate_count, resolved, ref_id): each reference (all, or those of refs) from its enclosing definition, or its file's module, to every kept candidate."""
    return links_of_files(graph, found, refs).select(*LINK)


def links_of_files(graph: Graph, found: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """links with file_id, the file of the reference."""
    found = resolve.resolved(graph) if found is None else found
    if found is not None:
        return sources(graph, found, refs).select(*LINK, "file_id")
    # whatever a reference says is there before its candidates are spelled out
    return resolve.spread(graph, sources(graph, resolve.sized(graph), refs)).select(*LINK, "file_id")


def counted_links(graph: Graph) -> DataFrame:
    """(kind, evidence, candidate_count, resolved, ref_id, n): links without their ends, n of them in a row."""
    refs = graph.refs.select(F.col("id").alias("ref_id"), "kind")
    rows = resolve.sized(graph).join(refs, "ref_id")
    return rows.select("kind", "evidence", "candidate_count", (F.col("candidate_count") == 1).alias("resolved"), "ref_id", "n")


def file_links(graph: Graph) -> DataFrame:
    """(src, dst): module node to the module nodes that it imports."""
    files = graph.files.select(F.col("id").alias("dst"), "module")
    return named_modules(graph).join(files, F.col("module_abs") == F.col("module")).where("src <> dst").select("src", "dst")


def named_modules(graph: Graph) -> DataFrame:
    """(src, module_abs): what each file imports, once. A file is of one module, so pairs of files that follow from it are different ones."""
    return graph.imports.select(F.col("file_id").alias("src"), "module_abs").distinct()


def best_of(rows: DataFrame) -> DataFrame:
    """One row for each start and node: the surest, then the one with fewest candidates, then the first kind and evidence."""
    order = Window.partitionBy("start", "node").orderBy(F.desc("confidence"), "candidate_count", "kind", "evidence")
    return rows.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def neighbors(graph: Graph, question: str, ambiguous: bool = False, starts: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(start, node, kind, confidence, evidence, candidate_count) for every start (a column id), or for all."""
    if question not in QUESTIONS:
        raise ValueError(f"unknown question {question!r}; one of {', '.join(sorted(QUESTIONS))}")
    direction, kinds = QUESTIONS[question]
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    if kinds == ("IMPORTS",):
        # the question is about the file of whatever node is asked for
        asked = graph.nodes if starts is None else graph.nodes.join(starts.select("id"), "id", "left_semi")
        asked, one = asked.select(F.col("id").alias("start"), "file_id"), F.lit(1).cast("long")
        files, named = graph.files.select(F.col("id").alias("of"), "module"), named_modules(graph)
        # both sides meet by module last, where a row becomes many: a module's files and importers are named once, and no pair is made twice
        if direction == "up":
            near = asked.join(files, F.col("file_id") == F.col("of")).select("start", "file_id", "module")
            met = near.join(named, F.col("module") == F.col("module_abs")).where("src <> file_id").withColumnRenamed("src", "node")
        else:
            near = asked.join(named, F.col("file_id") == F.col("src")).select("start", "file_id", "module_abs")
            met = near.join(files, F.col("module_abs") == F.col("module")).where("of <> file_id").withColumnRenamed("of", "node")
        return met.select("start", "node", F.lit("IMPORTS").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("import").alias("evidence"), one.alias("candidate_count"))
    if ambiguous and edges is None and resolve.resolved(graph) is None:
        return ambiguous_neighbors(graph, here, there, kinds, starts)
    rows = (links(graph) if edges is None else edges).where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst")))
    if not ambiguous:
        rows = rows.where("resolved")
    rows = rows.select(F.col(here).alias("start"), F.col(there).alias("node"), "kind", "confidence", "evidence", "candidate_count")
    if starts is not None:
        rows = rows.join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    return best_of(rows)


def ambiguous_neighbors(graph: Graph, here: str, there: str, kinds: tuple[str, ...], starts: DataFrame | None = None) -> DataFrame:
    """neighbors to every candidate, from counted ones: only those of a source that spells a name in more than one way are told apart by rows."""
    refs = graph.refs.where(F.col("kind").isin(*kinds))
    rows = sources(graph, resolve.sized(graph), refs).join(refs.select(F.col("id").alias("ref_id"), "name"), "ref_id")
    way, spelled = ["dst", "g_name", "g_module", "g_package", "n", "files"], Window.partitionBy("src", "name")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "candidate_count", "kind", "evidence")).alias("b")
    # a group that a source names many times counts once, with its surest reference
    rows = rows.groupBy("src", "name", *way).agg(best).withColumn("ways", F.count(F.lit(1)).over(spelled))
    rows = rows.select("src", "ways", *way, "b.kind", (-F.col("b.c")).alias("confidence"), "b.evidence", "b.candidate_count")
    out = [F.col(here).alias("start"), F.col(there).alias("node"), "kind", "confidence", "evidence", "candidate_count"]
    with_starts = lambda df: df if starts is None else df.join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    rows = store(rows)
    alone, mixed = (with_starts(resolve.spread(graph, rows.where(w)).where("src <> dst").select(*out)) for w in ("ways = 1", "ways > 1"))
    return alone.unionByName(best_of(mixed))


@dataclass
class Steps:
    """One step upstream, in two parts: along links from node to node, and from a file to the modules that import it, which all nodes of a file share."""

    direct: DataFrame  # dst, src
    places: DataFrame  # node, file
    importers: DataFrame  # file, src

    def rows(self) -> DataFrame:
        """(dst, src): both parts spelled out by node."""
        imported = self.places.join(self.importers, "file").select(F.col("node").alias("dst"), "src")
        return self.direct.unionByName(imported).distinct()


def steps(graph: Graph, ambiguous: bool = False, edges: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = store) -> Steps:
    rows = (links(graph) if edges is None else edges).where("src <> dst")
    if not ambiguous:
        rows = rows.where("resolved")
    imports = file_links(graph).select(F.col("dst").alias("file"), "src")
    return Steps(keep(rows.select("dst", "src").distinct()), graph.nodes.select(F.col("id").alias("node"), F.col("file_id").alias("file")), keep(imports))


def blast_radius(step: Steps, starts: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] = store) -> DataFrame:
    """(start, node, depth): everything upstream of each start (a column id), once, at its least depth; nothing for a depth below 1.

    Level by level for all starts at once: the frontier meets the steps, and what was seen before is taken out. Importers are met by
    file, and a file once for each start. Every level is a table of its own, so that none is computed twice.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is over {MAX_DEPTH}")
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen, opened, out = frontier, None, None
    for level in range(1, depth + 1):
        files = frontier.join(step.places, "node").select("start", "file").distinct()
        if opened is not None:
            files = files.join(opened, ["start", "file"], "left_anti")
        files = keep(files)
        opened = files if opened is None else opened.unionByName(files)
        met = frontier.join(step.direct, frontier["node"] == step.direct["dst"]).select("start", F.col("src").alias("node"))
        met = met.unionByName(files.join(step.importers, "file").select("start", F.col("src").alias("node"))).distinct()
        frontier = keep(met.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        found = frontier.select("start", "node", F.lit(level).alias("depth"))
        out = found if out is None else out.unionByName(found)
        if level < depth and frontier.isEmpty():
            break
    return out if out is not None else frontier.select("start", "node", F.lit(0).alias("depth")).limit(0)


def importers_within(step: Steps, numbers: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] = store) -> DataFrame:
    """(file, within, bucket, bits): the modules that import a file in at most so many steps, as bitmaps over their numbers (src, number)."""
    near = step.importers.join(numbers, "src").groupBy("file", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    near = last = keep(near)
    out = near.withColumn("within", F.lit(1))
    for level in range(2, depth + 1):
        farther = step.importers.join(last.withColumnRenamed("file", "src"), "src").select("file", "bucket", "bits")
        last = keep(farther.unionByName(near).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        out = out.unionByName(last.withColumn("within", F.lit(level)))
    return out


def blast_sizes(step: Steps, starts: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] = store) -> DataFrame:
    """(start, depth1, depth2 ..): how many nodes blast_radius finds at each depth; starts that reach nothing are left out.

    All nodes of a file share its importers, so these are followed by file, as bitmaps over modules numbered in the order of their
    files' ids; what a start reaches along links is followed by node, and its bitmaps are those of the files it comes to, merged.
    Importers take no further link, for links lead to definitions; where one leads to a module, rows of blast_radius are counted.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is over {MAX_DEPTH}")
    levels = range(1, depth + 1)
    counted = [F.coalesce(F.sum(F.when(F.col("level") == n, F.col("n"))), F.lit(0)).alias(f"depth{n}") for n in levels]
    modules = step.places.where("node = file").select(F.col("file").alias("src"))
    if depth < 1:
        return starts.select(F.col("id").alias("start")).limit(0)
    if not step.direct.join(modules, F.col("dst") == modules["src"], "left_semi").isEmpty():
        return blast_radius(step, starts, depth, keep).groupBy("start", F.col("depth").alias("level")).agg(F.count("*").alias("n")).groupBy("start").agg(*counted)
    # numbers have gaps between ranges of ids and none within one: a bitmap covers 32,768 of them
    numbers = keep(modules.repartitionByRange("src").sortWithinPartitions("src").withColumn("number", F.monotonically_increasing_id()))
    upstream = keep(importers_within(step, numbers, depth, keep))
    starts = starts.select(F.col("id").alias("start")).distinct()

    frontier = seen = starts.withColumn("node", F.col("start"))
    linked = None  # start, node, level: along links alone
    for level in levels:
        met = frontier.join(step.direct, F.col("node") == F.col("dst")).select("start", F.col("src").alias("node")).distinct()
        frontier = keep(met.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        found = frontier.withColumn("level", F.lit(level))
        linked = found if linked is None else linked.unionByName(found)
        if frontier.isEmpty():
            break
    linked = linked.join(step.places, "node")
    mixed = keep(linked.select("start").distinct())

    # a start without links has what its file has, less itself if it is a module that imports itself in a circle
    own = numbers.select(F.col("src").alias("file"), F.bitmap_bucket_number("number").alias("own"), F.bitmap_bit_position("number").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.when(F.col("bucket") == F.col("own"), F.try_divide(byte, F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2).otherwise(0)
    by_file = upstream.join(own, "file").groupBy("file", F.col("within").alias("level")).agg(F.sum(F.bitmap_count("bits")).alias("all"), F.sum(inside).alias("self"))
    plain = starts.join(mixed, "start", "left_anti").join(step.places, F.col("start") == F.col("node")).join(by_file, "file")
    plain = plain.select("start", "level", (F.col("all") - F.when(F.col("start") == F.col("file"), F.col("self")).otherwise(0)).alias("n"))

    come = mixed.join(step.places, F.col("start") == F.col("node")).select("start", "file", F.lit(0).alias("level"))
    come = come.unionByName(linked.select("start", "file", "level")).groupBy("start", "file").agg(F.min("level").alias("level"))
    merged = come.join(upstream, "file").select("start", (F.col("level") + F.col("within")).alias("level"), "bucket", "bits").where(F.col("level") <= depth)
    later = lambda rows: rows.withColumn("level", F.explode(F.sequence("level", F.lit(depth))))
    alone = later(linked.where("node = file")).join(numbers, F.col("node") == F.col("src")).groupBy("start", "level", F.bitmap_bucket_number("number").alias("bucket"))
    merged = merged.unionByName(alone.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
    merged = merged.groupBy("start", "level", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).drop("bucket")
    defined = later(linked.where("node <> file")).groupBy("start", "level").agg(F.count("*").alias("n"))

    upto = plain.unionByName(merged).unionByName(defined).groupBy("start").agg(*counted).where(f"depth{depth} > 0")
    return upto.select("start", *[(F.col(f"depth{n}") - (F.col(f"depth{n - 1}") if n > 1 else F.lit(0))).alias(f"depth{n}") for n in levels])


def walk(
    graph: Graph, starts: DataFrame, depth: int = 0, floor: float = 0.05, edges: DataFrame | None = None, direction: str = "up", kinds: tuple[str, ...] | None = None, ambiguous: bool = False, keep: Callable[[DataFrame], DataFrame] = store
) -> DataFrame:
    """(start, node, depth, kind, confidence, evidence) along links at or above a floor, each node once, at its least depth, with its surest link of that depth.

    A path that visits no node twice exists at the least depth of any path, so levels of nodes not seen yet give the same rows as paths
    would, of which there may be exponentially many. A depth of 0 or less means MAX_DEPTH; one over it is an error.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is over {MAX_DEPTH}")
    if direction not in ("up", "down"):
        raise ValueError(f"unknown direction {direction!r}; one of down, up")
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    rows = (links(graph) if edges is None else edges).where((F.col("confidence") >= floor) & (F.col("src") != F.col("dst")))
    if not ambiguous:
        rows = rows.where("resolved")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "kind", "evidence")).alias("b")
    rows = keep(rows.groupBy(F.col(here).alias("h"), F.col(there).alias("t")).agg(best))
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen, out = frontier, None
    for level in range(1, (depth if depth > 0 else MAX_DEPTH) + 1):
        met = frontier.join(rows, F.col("node") == F.col("h")).groupBy("start", F.col("t").alias("node")).agg(F.min("b").alias("b"))
        found = keep(met.join(seen, ["start", "node"], "left_anti"))
        frontier = found.select("start", "node")
        seen = seen.unionByName(frontier)
        found = found.select("start", "node", F.lit(level).alias("depth"), F.col("b.kind").alias("kind"), (-F.col("b.c")).alias("confidence"), F.col("b.evidence").alias("evidence"))
        out = found if out is None else out.unionByName(found)
        if frontier.isEmpty():
            break
    return out
