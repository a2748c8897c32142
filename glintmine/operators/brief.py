"""Context bundles: closure, reasons, budget cap and dependency order."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import graph


def rounds(chunks: DataFrame) -> DataFrame:
    """Adds ``round``: the chunk's number within its file."""
    return chunks.withColumn("round", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id")))


def cap(chunks: DataFrame, max_chunks: int, max_bytes: int) -> DataFrame:
    """Keeps chunks round by round, files by depth, import count and path, skipping what exceeds the bytes left, until
    ``max_chunks`` are kept. Only the next few rows in this order that still fit are brought to the driver at a
    time, as (order, bytes, id); each time keeps at least one chunk, so there are at most ``max_chunks`` times."""
    order = F.struct("round", "depth", (-F.col("import_count")).alias("less"), "file_path", "start_line", "chunk_id")
    queue = materialize(rounds(chunks).select(order.alias("at"), "chunk_id", F.col("bytes").cast("long").alias("bytes")).where(F.col("bytes") <= max_bytes), "brief-queue")
    kept: list[int] = []
    left, after = max_bytes, None
    while len(kept) < max_chunks:
        fits = queue.where(F.col("bytes") <= left)
        if after is not None:
            fits = fits.where(F.col("at") > F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(after, queue.schema["at"].dataType, strict=True)]))
        some = fits.orderBy("at").limit(4 * max_chunks).collect()
        for row in some:
            if len(kept) < max_chunks and row["bytes"] <= left:
                kept.append(row["chunk_id"])
                left -= row["bytes"]
        if len(some) < 4 * max_chunks:
            break
        after = some[-1]["at"]
    ids = queue.sparkSession.createDataFrame([(k,) for k in kept], "chunk_id long")
    return chunks.join(F.broadcast(ids), "chunk_id", "left_semi")


def topological(files: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Dependencies first; what is ready goes by name, and what cycles hold back comes last, by name."""
    inside = set(files)
    needs: dict[str, set[str]] = {f: set() for f in inside}
    users: dict[str, set[str]] = {f: set() for f in inside}
    for a, b in edges:
        if a in inside and b in inside and a != b:
            needs[a].add(b)
            users[b].add(a)
    ready = [f for f in inside if not needs[f]]
    heapq.heapify(ready)
    out = []
    while ready:
        f = heapq.heappop(ready)
        out.append(f)
        for u in users[f]:
            needs[u].discard(f)
            if not needs[u]:
                heapq.heappush(ready, u)
    return out + sorted(inside.difference(out))


def dependency_order(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, position) of a capped bundle (at most some hundred chunks): its files in dependency order, each by
    line. Edges are cut to those within the bundle first; one task holds the bundle, whose size is the cap."""
    links = graph.edges_among(edges, chunks.select("file_path").distinct()).withColumn("bundle", F.lit(1))
    bundle = chunks.select("chunk_id", "file_path", "start_line").withColumn("bundle", F.lit(1))

    def order(frame: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ordered = topological(list(frame["file_path"]), list(zip(pairs["source_file"], pairs["target_file"], strict=True)))
        place = {f: k for k, f in enumerate(ordered)}
        frame = frame.assign(at=frame["file_path"].map(place)).sort_values(["at", "start_line", "chunk_id"])
        return pd.DataFrame({"chunk_id": frame["chunk_id"].to_numpy(), "position": range(1, len(frame) + 1)})

    return bundle.groupBy("bundle").cogroup(links.groupBy("bundle")).applyInPandas(order, "chunk_id long, position long")


@dataclass(frozen=True)
class Task:
    """What a bundle is for: seed files, how far to go, and the budget."""

    seeds: tuple[str, ...]
    depth: int = 3
    max_chunks: int = 80
    max_bytes: int = 80_000
    include_tests: bool = False


@dataclass(frozen=True)
class Bundle:
    """``chunks`` in order, with depth, reason, bytes and position; ``reachable``: the files (file_path) before
    the cap, by path; ``totals``: one row (total_chunks, total_bytes)."""

    chunks: DataFrame
    reachable: DataFrame
    totals: DataFrame


def labelled(chunks: DataFrame, closure: DataFrame) -> DataFrame:
    """Chunks of the closure's files with depth and reason, and their size in bytes."""
    return chunks.join(closure, "file_path").withColumn("bytes", F.octet_length("content").cast("long"))


def expand(chunks: DataFrame, edges: DataFrame, task: Task) -> Bundle:
    """The bundle of a task: closure both ways, without test files that are no seeds, capped, in dependency order."""
    spark = chunks.sparkSession
    seeds = spark.createDataFrame([(s,) for s in task.seeds], "file_path string")
    found = labelled(chunks, graph.bidirectional(edges, seeds, max(1, min(task.depth, 10))))
    if not task.include_tests:
        named = F.col("file_path").isin(*task.seeds) if task.seeds else F.lit(False)
        found = found.where(~F.col("source_kind").eqNullSafe("test") | named)
    found = materialize(found, "brief-chunks")
    sizes = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    if sizes["n"] <= task.max_chunks and sizes["b"] <= task.max_bytes:
        kept = found
    else:
        kept = cap(found.join(graph.import_counts(edges, found.select("file_path")), "file_path"), task.max_chunks, task.max_bytes).drop("import_count")
    ordered = kept.join(F.broadcast(dependency_order(kept, edges)), "chunk_id")
    reachable = found.select("file_path").distinct().orderBy("file_path")
    totals = kept.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    return Bundle(ordered, reachable, totals)
