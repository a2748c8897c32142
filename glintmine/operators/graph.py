"""Reference graph: closures, direct and symbol references, import counts and embedding priority.

Edges are (source_file, target_file, symbol_name, ref_kind), a multigraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def closure(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(file_path, depth) of what ``seeds`` (file_path) reach in at most ``depth`` steps, seeds at 0, each file
    at its least depth. Level by level: a level is joined with the edges once, made distinct and stripped
    of what is known, so cycles end; it is written once, so no level is computed twice."""
    a, b = ("target_file", "source_file") if reverse else ("source_file", "target_file")
    steps = edges.select(F.col(a).alias("file_path"), F.col(b).alias("next"))
    level = seeds.select("file_path").distinct().withColumn("depth", F.lit(0))
    known = level
    for d in range(1, depth + 1):
        reached = steps.join(level, "file_path", "left_semi").select(F.col("next").alias("file_path")).distinct()
        found = reached.join(known, "file_path", "left_anti").withColumn("depth", F.lit(d))
        if d == depth:
            return known.unionByName(found)
        level = materialize(found, "closure")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def dependents(edges: DataFrame, target: str, depth: int) -> DataFrame:
    """What depends on ``target``, without itself; direct dependents even at depth 0."""
    seed = edges.sparkSession.createDataFrame([(target,)], "file_path string")
    return closure(edges, seed, max(1, min(depth, 10)), reverse=True).where("depth > 0")


def direct_references(edges: DataFrame, target: str) -> DataFrame:
    """Different (source_file, ref_kind, via_symbol); namespace and side-effect references have no symbol."""
    via = F.when(F.col("ref_kind").isin("namespace", "side_effect"), None).otherwise(F.col("symbol_name"))
    return edges.where(F.col("target_file") == target).select("source_file", "ref_kind", via.alias("via_symbol")).distinct()


def symbol_dependents(edges: DataFrame, target: str, symbol: str) -> DataFrame:
    return edges.where((F.col("target_file") == target) & (F.col("symbol_name") == symbol)).select("source_file").distinct()


def edges_among(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Different edges with both ends in ``files`` (file_path)."""
    sources, targets = files.select(F.col("file_path").alias("source_file")), files.select(F.col("file_path").alias("target_file"))
    return edges.select("source_file", "target_file").join(sources, "source_file", "left_semi").join(targets, "target_file", "left_semi").distinct()


def import_counts(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, import_count): files that refer to each of ``files``, 0 if none does."""
    wanted = files.select("file_path").distinct()
    into = edges.select(F.col("target_file").alias("file_path"), "source_file").join(wanted, "file_path", "left_semi").distinct()
    counts = into.groupBy("file_path").agg(F.count("*").alias("n"))
    return wanted.join(counts, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).cast("long").alias("import_count"))


def embedding_priority(chunks: DataFrame, edges: DataFrame, embedded: DataFrame) -> DataFrame:
    """(file_path, priority) of files with a chunk that has no vector: references to the file, and 3 more if
    it has a hook or component."""
    waiting = chunks.join(embedded.select("chunk_id").distinct(), "chunk_id", "left_anti").select("file_path").distinct()
    boosted = chunks.where(F.col("chunk_type").isin("hook", "component")).select("file_path").distinct().withColumn("boost", F.lit(3))
    counts = edges.groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("n"))
    joined = waiting.join(boosted, "file_path", "left").join(counts, "file_path", "left")
    return joined.select("file_path", (F.coalesce("n", F.lit(0)) + F.coalesce("boost", F.lit(0))).cast("long").alias("priority"))


def bidirectional(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(file_path, depth, reason): both closures, least depth; the forward label wins."""
    forward = closure(edges, seeds, depth).withColumn("forward", F.lit(True))
    backward = closure(edges, seeds, depth, reverse=True).withColumn("forward", F.lit(False))
    both = forward.unionByName(backward).groupBy("file_path").agg(F.min("depth").alias("depth"), F.bool_or("forward").alias("forward"))
    reason = F.when(F.col("depth") == 0, "seed").otherwise(F.concat(F.when(F.col("forward"), "forward-").otherwise("impact-"), F.col("depth").cast("string")))
    return both.select("file_path", "depth", reason.alias("reason"))


def impact_report(edges: DataFrame, target: str, depth: int) -> DataFrame:
    """(file_path, depth, references): what depends on ``target``, with its direct references (ref_kind, via_symbol),
    sorted, for depth 1 and none further out."""
    each = F.struct("ref_kind", "via_symbol")
    direct = direct_references(edges, target).groupBy(F.col("source_file").alias("file_path")).agg(F.array_sort(F.collect_list(each)).alias("found"))
    near = F.when(F.col("depth") == 1, F.col("found"))
    none = F.array().cast("array<struct<ref_kind:string,via_symbol:string>>")
    return dependents(edges, target, depth).join(direct, "file_path", "left").select("file_path", "depth", F.coalesce(near, none).alias("references"))


def reference_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("references"))
