"""One object for a project: index, search, impact, brief, status and recall, as tables or as written answers."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass
from importlib.resources import files
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query_log, render
from .errors import EmbedderUnavailable, InvalidInput
from .functions import codecs, paths
from .operators import brief, embedding, graph, measures, ranking, search
from .sources import config, corpora, index
from .sources.store import Store

VERSION = "2"
#: How far dependents are followed at most, and how many files are suggested.
MAX_DEPTH, CANDIDATES = 10, 10
RERANK_SWITCH = "GLINTMINE_RERANK"


@dataclass(frozen=True)
class Options:
    """``rerank``: let the cross-encoder, if there is one, have the last word; ``log``: write each search to ``log_path``."""

    rerank: bool = False
    log: bool = False
    log_path: str | None = None

    @classmethod
    def from_env(cls, **given) -> Options:
        return cls(**{"rerank": os.environ.get(RERANK_SWITCH) == "1"} | given)


class Impact(NamedTuple):
    known: bool
    dependents: DataFrame
    symbol_refs: DataFrame | None
    related: DataFrame | None


class Engine:
    """``root``: a path, or a URI that Spark reads. Methods with a noun give tables; those that end in ``_answer`` give JSON
    (``as_json``) or text."""

    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None, reranker: ranking.Reranker | None = None, options: Options | None = None, store: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.reranker, self.options = embedder or embedding.NoEmbedder(), reranker, options or Options()
        self.store = Store(spark, store or (self.root if "://" in root else f"file://{os.path.abspath(root)}") + f"/{config.INDEX_FOLDER}")

    # -- tables

    def tables(self) -> search.Index:
        return search.Index(self.store.read("chunks"), self.store.read("vecs"), self.store.read("edges"), self.store.read("context"))

    def stats(self) -> dict:
        t = self.tables()
        return measures.status(t.chunks, t.vecs, t.edges).first().asDict()

    # -- index

    def _scan(self, exclude_vendor: bool) -> DataFrame:
        return index.scan(self.spark, self.root, exclude_vendor)

    def _project_file(self, name: str) -> str | None:
        if "://" not in self.root:
            return config.read_text(f"{self.root}/{name}")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", name).load(self.root).select(F.col("content").cast("string")).first()
        return found[0] if found else None

    def update(self, force: bool = False, exclude_vendor: bool = False) -> dict:
        """Chunks, edges and context of what has changed (of all files, with ``force``); counters."""
        patterns = corpora.patterns(corpora.bundled("patterns"))
        aliases, crate = config.aliases(self._project_file("tsconfig.json")), config.crate_name(self._project_file("Cargo.toml"))
        return index.run(self.store, self._scan(exclude_vendor), patterns, aliases, crate, force)

    def embed_pending(self, max_chunks: int | None = None, hints: list[str] | None = None) -> dict:
        """Vectors of what waits for some, in order and within a budget; counters. Without a model, an error: an index
        without vectors must not look complete."""
        t = self.tables()
        work = embedding.worklist(t.chunks, t.vecs, t.edges, t.context, hints)
        if work.isEmpty():
            return {"chunks_embedded": 0, "chunks_failed": 0, "files_completed": 0, "chunks_per_second": 0}
        if isinstance(self.embedder, embedding.NoEmbedder):
            raise EmbedderUnavailable(self.embedder.reason)
        began = time.monotonic()
        vectors, told = embedding.embed_pending(embedding.budgeted(work, max_chunks), self.embedder)
        self.store.append("vecs", vectors.join(t.chunks.select("chunk_id", "file_path"), "chunk_id"))
        took = int((time.monotonic() - began) * 1000)
        return {k: told[k] for k in ("chunks_embedded", "chunks_failed", "files_completed")} | {"chunks_per_second": measures.throughput(told["chunks_embedded"], took)}

    def index_answer(self, force: bool = False, exclude_vendor: bool = False, as_json: bool = False) -> str:
        counters = self.update(force, exclude_vendor)
        self.embed_pending()
        stats, coverage = self.stats(), None
        notes = [f"failed to chunk {n} file(s)"] if (n := counters["files_errored"]) else []
        if stats["embedded_chunks"] < stats["embeddable_chunks"]:
            coverage = self.coverage(stats)
            notes.append(f"embedded {stats['embedded_chunks']} of {stats['embeddable_chunks']} chunks; index again to finish")
        if as_json:
            return render.index_run(counters, coverage, bool(notes), notes, force)
        skipped = "" if force else f"{counters['files_skipped']} files skipped (unchanged), "
        text = f"{'Rebuild' if force else 'Indexing'} complete: {counters['files_processed']} files chunked, {counters['chunks_created']} chunks created, {skipped}{counters['files_errored']} errors"
        return text + (f"\n\nEmbedding coverage: {coverage}. Index again to finish embedding." if coverage else "")

    def dry_run_answer(self, force: bool = False, exclude_vendor: bool = False, as_json: bool = False) -> str:
        told = index.dry_run(self.store.read("context"), self._scan(exclude_vendor), force)
        notes = [f"check failed for {n} file(s)"] if (n := told["files_errored"]) else []
        if as_json:
            return render.dry_run(told, bool(notes), notes)
        text = f"Dry run: {told['files_to_process']} files to process, {told['files_to_skip']} files unchanged (skip), {told['total_files']} total files"
        text += f", {told['files_errored']} errors" if told["files_errored"] else ""
        return text + (f", {told['orphans_to_remove']} orphaned files to remove" if told["orphans_to_remove"] else "")

    # -- status

    def coverage(self, stats: dict) -> str:
        row = self.spark.createDataFrame([(stats["embedded_chunks"], stats["total_chunks"], stats["embeddable_chunks"])], "a long, b long, c long")
        return row.select(codecs.coverage_text(F.col("a"), F.col("b"), F.col("c"))).first()[0]

    def hint(self, stats: dict) -> str | None:
        if stats["total_chunks"] == 0:
            return "index is empty; run an index"
        if stats["embedded_chunks"] == 0:
            return "embeddings missing; run an index"
        return "embeddings incomplete; run an index" if stats["embedded_chunks"] < stats["embeddable_chunks"] else None

    def status_answer(self, as_json: bool = False) -> str:
        stats, last = self.stats(), self.store.last_indexed_at()
        if as_json:
            return render.status(stats, last)
        told = {"Files": stats["total_files"], "Chunks": stats["total_chunks"], "Embedded": self.coverage(stats), "References": stats["references"], "Last indexed": last or "never"}
        return "\n".join(["Index status:", *(f"  {k}: {v}" for k, v in told.items())])

    # -- search

    def search(self, query: str | None = None, limit: int = 10, offset: int = 0, prefixes: list[str] | None = None, source: str | None = None) -> search.Outcome:
        """By a query, or with ``source`` (file or file:symbol) by likeness to it."""
        search.check_query(query, source)
        for p in prefixes or []:
            paths.check_path(p)
        limit = max(1, min(limit, search.MAX_LIMIT))
        if source is not None:
            file, symbol = paths.parse_target(source)
            return search.similar(self.tables(), paths.check_path(file), symbol, query, limit, prefixes)
        return search.search(self.tables(), self.embedder, query, limit, offset, self.reranker if self.options.rerank else None, prefixes, self.options.log)

    def search_answer(self, query: str | None = None, limit: int = 10, offset: int = 0, prefixes: list[str] | None = None, source: str | None = None, as_json: bool = False) -> str:
        began = time.monotonic()
        out, stats = self.search(query, limit, offset, prefixes, source), self.stats()
        notes = [h] if (h := self.hint(stats)) else []
        if self.options.rerank and self.reranker is None and source is None:
            notes.append("reranking requested but no model is installed")
        if out.degraded:
            notes.append("embedding model not loaded; results from text search only")
        notes += out.notes
        rows = [r.asDict(True) for r in search.enriched(self.tables(), out.results).collect()]
        if self.options.log and source is None:
            path = query_log.path_from_env() if self.options.log_path is None else query_log.Path(self.options.log_path)
            query_log.append(path, query_log.record(query, out, int((time.monotonic() - began) * 1000), VERSION))
        if as_json:
            return render.results(sorted(rows, key=lambda r: r["rank"]), out.degraded, notes)
        return render.grouped(rows, notes) if rows else render.nothing_found(self.coverage(stats), notes)

    # -- impact

    def impact(self, target: str, symbol: str | None = None, depth: int = 3, semantic: bool = False) -> Impact:
        t = self.tables()
        if not target:
            raise InvalidInput("target must not be empty", "give a target path, such as src/foo.rs", search.first_paths(t.chunks, CANDIDATES))
        if t.chunks.limit(1).isEmpty():
            raise InvalidInput("index is empty", "run an index first")
        file, named = paths.parse_target(target)
        paths.check_path(file)
        symbol = symbol if symbol is not None else named
        found = graph.impact_report(t.edges, file, min(depth, MAX_DEPTH)).orderBy("depth", "file_path")
        refs = graph.symbol_dependents(t.edges, file, symbol).orderBy("source_file") if symbol is not None else None
        return Impact(search.known_file(t.chunks, file), found, refs, search.related(t, file, symbol) if semantic else None)

    def impact_answer(self, target: str, symbol: str | None = None, depth: int = 3, semantic: bool = False, as_json: bool = False) -> str:
        found = self.impact(target, symbol, depth, semantic)
        rows = [r.asDict(True) for r in found.dependents.collect()]
        refs = [r[0] for r in found.symbol_refs.collect()] if found.symbol_refs is not None else None
        like = [r.asDict() for r in found.related.collect()] if found.related is not None else []
        if as_json:
            return render.impact(target, found.known, rows, refs or [], like)
        if not rows and not like:
            return f"No dependents found for `{target}`." if found.known else f"`{paths.parse_target(target)[0]}` not found in index. Run an index to update."
        return render.impact_text(target, rows, refs, like)

    # -- brief and recall

    def brief(self, task: str, seeds: list[str] | None = None, symbols: list[str] | None = None, depth: int = 3, max_chunks: int = 80, max_bytes: int = 80_000, include_tests: bool = False) -> tuple[brief.Bundle | None, bool]:
        """(bundle, degraded); without seeds they are inferred from the task. No seed, no bundle."""
        if not task.strip():
            raise InvalidInput("task must not be empty", "give a task, such as 'add OAuth login'")
        if symbols:
            raise InvalidInput("seeds by symbol are not implemented; name files", "give seed files instead")
        t, degraded = self.tables(), False
        if not seeds:
            seeds, degraded = search.infer_seeds(t, self.embedder, task)
        if not seeds:
            return None, True
        bundle = brief.expand(t.chunks, t.edges, brief.Task(tuple(seeds), depth, max_chunks, max_bytes, include_tests))
        return bundle, degraded or bundle.chunks.isEmpty()

    def brief_answer(self, task: str, as_json: bool = False, **options) -> str:
        bundle, degraded = self.brief(task, **options)
        rows = [r.asDict(True) for r in bundle.chunks.orderBy("position").collect()] if bundle else []
        return render.brief(rows, degraded) if as_json else render.brief_text(rows, degraded)

    def recall(self, repo: str, corpus: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(a row for each entry of a ground-truth corpus about ``repo``, one row of their means): how much of what a
        complete answer must have a brief without seeds finds."""
        wanted, _, told = corpora.ground_truth(self.spark, corpus or corpora.bundled("ground_truth"))
        pairs = {"out": [], "reach": []}
        flawed = []
        for e in [x for x in told if x["repo"] == repo]:  # a few dozen entries
            bundle, degraded = self.brief(e["task"])
            flawed.append((e["id"], degraded))
            if bundle:
                pairs["out"] += [(e["id"], r[0]) for r in bundle.chunks.select("file_path").distinct().collect()]
                pairs["reach"] += [(e["id"], r[0]) for r in bundle.reachable.collect()]
        table = {k: self.spark.createDataFrame(v, "entry string, path string") for k, v in pairs.items()}
        flaws = self.spark.createDataFrame(flawed, "entry string, flawed boolean")
        judged = measures.judged_entries(wanted.join(flaws.select("entry"), "entry", "left_semi"), table["out"], table["reach"])
        entries = measures.recall_report(judged).join(flaws, "entry").withColumn("degraded", F.col("degraded") | F.col("flawed")).drop("flawed")
        return entries, measures.corpus_report(entries)

    def recall_answer(self, repo: str, as_json: bool = False, corpus: str | None = None) -> tuple[str, bool]:
        entries, report = self.recall(repo, corpus)
        rows = [{"id": r["entry"], "recall": r["recall"], "cap_fit": r["cap_fit"], "degraded": r["degraded"]} for r in entries.orderBy("entry").collect()]
        mean = report.first().asDict()
        return (render.recall if as_json else render.recall_text)(repo, mean, rows), mean["degraded"]


def example() -> str:
    """The folder of the example project that the bundled ground truth is about."""
    return str(files("glintmine.data").joinpath("example"))
