"""Search as one call: vectors and full text, ranked, capped and paged; from a file; and what builds on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import paths, text
from ..session import materialize
from . import fulltext, graph, measures, ranking, vectors

# Fixed values that results depend on.
MAX_QUERY_BYTES, MAX_LIMIT, MAX_OFFSET = 2000, 100, 500
MOST_SOURCES, SIMILAR, RELATED, INFERRED_SEEDS = 20, 0.7, 20, 5
COLUMNS = ("chunk_id", "file_path", "chunk_type", "name", "content", "start_line", "end_line", "parent_chunk_id", "source_kind", "injection_flags")


@dataclass(frozen=True)
class Index:
    """The tables of an index. ``chunks`` may lack what a caller doesn't need of COLUMNS."""

    chunks: DataFrame
    vecs: DataFrame
    edges: DataFrame
    context: DataFrame | None = None


@dataclass
class Outcome:
    """``results``: chunks with score and source, in the order of ``rank`` from 1. ``stages``: (chunk_id, score, source)
    of each step, if asked for."""

    results: DataFrame
    degraded: bool = False
    notes: list[str] = field(default_factory=list)
    stages: dict[str, DataFrame] = field(default_factory=dict)


def check_query(query: str | None, source: str | None = None) -> None:
    if query is None and source is None:
        raise InvalidInput("query or --from is required", "give a query, or a file with --from")
    if query == "":
        raise InvalidInput("query must not be empty", "give a query, or pipe one via stdin")
    if query is not None and (size := len(query.encode())) > MAX_QUERY_BYTES:
        raise InvalidInput(f"query exceeds max length ({size} > {MAX_QUERY_BYTES})", f"shorten query to ≤ {MAX_QUERY_BYTES} characters")


def fetch_sizes(limit: int, offset: int, reranked: bool) -> tuple[int, int]:
    """(hits of the semantic arm, hits of the text arm)."""
    return (4 * limit if reranked else limit) + offset, 3 * (limit + offset)


def imports_of(index: Index, hits: DataFrame) -> DataFrame:
    return materialize(graph.import_counts(index.edges, hits.select("file_path")), "search-imports")


def pipeline(index: Index, query: str, embedding: list[float] | None, limit: int, offset: int = 0, reranker: ranking.Reranker | None = None, prefixes: list[str] | None = None, capture: bool = False) -> Outcome:
    """Both arms, with the query's type hints as a filter; a union in which the semantic arm wins; scores by coverage,
    rarity of the keywords and imports; at most two chunks of a file; then offset and limit."""
    keywords, hints = text.keywords(query), text.type_hints(query)
    near, matched = fetch_sizes(limit, offset, reranker is not None)
    chunks = fulltext.indexed(index.chunks)
    semantic = chunks.select("chunk_id", F.lit(0.0).alias("base"), F.lit("semantic").alias("source")).limit(0)
    if embedding is not None:
        found = vectors.search(index.vecs, index.chunks, [embedding], near, hints, prefixes)
        semantic = materialize(found.select("chunk_id", vectors.similarity(F.col("distance")).alias("base"), F.lit("semantic").alias("source")), "search-near")
    both = semantic
    if keywords:
        matches = fulltext.search(chunks, keywords, matched, hints, exclude=semantic, prefixes=prefixes).select("chunk_id", F.col("score").alias("base"), F.lit("fts").alias("source"))
        both = ranking.union(semantic, matches)
    # a search's candidates are a few hundred rows: written once, as ranking reads them several times
    hits = materialize(both.join(index.chunks, "chunk_id"), "search-hits")
    both = hits.select("chunk_id", "base", "source")
    matches = both.where("source = 'fts'")
    counts = fulltext.figures(chunks, keywords).select(F.struct("*")).scalar()
    idfs = [fulltext.idf(counts["n"], counts[f"df{i}"]) for i in range(len(keywords))]
    coverage = measures.coverage(index.chunks, index.vecs).scalar()
    scored = ranking.rerank(hits, imports_of(index, hits), keywords, idfs, hints, coverage)
    if reranker is not None:
        scored = ranking.cross_encoder(scored, query, reranker)
    results = numbered(ranking.page(scored, offset, limit), ranking.ranked(scored))
    stages = {}
    if capture:
        stage = lambda df: df.select("chunk_id", F.col("base").alias("score"), "source")
        stages = {"fts": stage(matches), "vec": stage(semantic), "concatenated": stage(both), "reranked": scored.select("chunk_id", "score", "source")}
    return Outcome(results, stages=stages)


def numbered(page: DataFrame, order: list[Column]) -> DataFrame:
    """A page of results with ``rank`` from 1: a page has at most some hundred rows."""
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def search(index: Index, embedder, query: str, limit: int = 10, offset: int = 0, reranker: ranking.Reranker | None = None, prefixes: list[str] | None = None, capture: bool = False) -> Outcome:
    """pipeline() of a checked query. Without an embedding of the query, only text is searched, and the outcome is
    degraded."""
    check_query(query)
    for p in prefixes or []:
        paths.check_path(p)
    try:
        embedding, degraded = embedder.embed_query(query), False
    except Exception:  # whatever a model fails of, text search answers
        embedding, degraded = None, True
    out = pipeline(index, query, embedding, max(1, min(limit, MAX_LIMIT)), max(0, min(offset, MAX_OFFSET)), reranker, prefixes, capture)
    out.degraded = degraded
    return out


def similar(index: Index, file: str, symbol: str | None = None, query: str | None = None, limit: int = 10, prefixes: list[str] | None = None) -> Outcome:
    """Chunks like those of a file or symbol, by their stored vectors; with a query, those that its keywords find too.
    Scores don't know of keywords, types or coverage; there is no offset and no limit for a file."""
    sources = [r[0] for r in vectors.target_chunks(index.chunks, file, symbol).collect()]  # one file's chunks
    stored = vectors.stored_vectors(index.vecs, sources, MOST_SOURCES)
    if not stored:
        nothing = index.chunks.limit(0).withColumns({"score": F.lit(0.0), "source": F.lit("semantic"), "rank": F.lit(0).cast("long")})
        return Outcome(nothing, notes=[f"no stored embeddings for '{file if symbol is None else f'{file}:{symbol}'}'"])
    fetch = (limit if query is None else 3 * limit) + len(sources)
    found = vectors.search(index.vecs, index.chunks, stored, fetch, prefixes=prefixes).where(~F.col("chunk_id").isin(sources))
    keywords = text.keywords(query) if query is not None else []
    if keywords:
        found = found.join(fulltext.search(index.chunks, keywords, fetch, include=found, prefixes=prefixes).select("chunk_id"), "chunk_id", "left_semi")
    hits = materialize(found.withColumns({"base": vectors.similarity(F.col("distance")), "source": F.lit("semantic")}), "search-hits")
    scored = ranking.rerank(hits, imports_of(index, hits), [], [], [])
    return Outcome(numbered(scored.orderBy(*ranking.ranked(scored)).limit(limit), ranking.ranked(scored)))


def related(index: Index, file: str, symbol: str | None = None) -> DataFrame:
    """(file_path, score): semantic impact, the files most like a target's chunks, best chunk first."""
    found = similar(index, file, symbol, limit=RELATED).results.where(F.col("score") >= SIMILAR)
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("file_path").orderBy("rank"))).where("k = 1")
    return best.orderBy("rank").select("file_path", "score")


def infer_seeds(index: Index, embedder, task: str, most: int = INFERRED_SEEDS) -> tuple[list[str], bool]:
    """The files that a task is about, and whether only text could tell (degraded)."""
    try:
        found, degraded = vectors.search(index.vecs, index.chunks, [embedder.embed_query(task)], most), False
        order = [F.asc("distance"), F.asc("chunk_id")]
    except Exception:  # as in search()
        keywords, degraded = text.keywords(task), True
        found = fulltext.search(index.chunks, keywords, 3 * most)
        order = [F.desc("score"), F.asc("chunk_id")]
    return [r["file_path"] for r in ranking.first_files(found, order, most).orderBy("position").collect()], degraded


def enriched(index: Index, results: DataFrame) -> DataFrame:
    """Results in groups by file, files by their best score: with the file's imports, its other chunks, and the parent
    chunk unless it is a result itself. (group, rank, ..., imports, siblings, parent)"""
    siblings = index.chunks.join(results.select("file_path").distinct(), "file_path", "left_semi")
    shown = results.select("file_path", "start_line", "end_line").distinct()
    other = siblings.join(shown, ["file_path", "start_line", "end_line"], "left_anti")
    each = F.struct("start_line", "end_line", F.coalesce("name", F.lit("(unnamed)")).alias("name"), "chunk_type")
    beside = other.groupBy("file_path").agg(F.array_sort(F.collect_list(each)).alias("siblings"))
    above = index.chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.struct("name", "chunk_type", "start_line", "end_line", "content").alias("parent"))
    hidden = above.join(results.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti")
    out = results.join(beside, "file_path", "left").join(hidden, "parent_chunk_id", "left")
    if index.context is not None:
        out = out.join(index.context.select("file_path", F.col("imports_text").alias("imports")), "file_path", "left")
    else:
        out = out.withColumn("imports", F.lit(None).cast("string"))
    best = F.max("score").over(Window.partitionBy("file_path"))
    lead = F.min("rank").over(Window.partitionBy("file_path"))
    ordered = out.withColumns({"best": best, "lead": lead})
    group = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("best"), "lead"))  # of a page of results
    return ordered.withColumn("group", group.cast("long")).drop("best", "lead").orderBy("group", "rank")


def first_paths(chunks: DataFrame, most: int = 10) -> list[str]:
    """The first indexed files by path, to suggest where a target is lacking."""
    return [r[0] for r in chunks.select("file_path").distinct().orderBy("file_path").limit(most).collect()]


def known_file(chunks: DataFrame, file: str) -> bool:
    return not chunks.where(F.col("file_path") == file).limit(1).isEmpty()
