"""Embedding runs: what waits for vectors, in which order and budget, and the models' seam."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmbedderUnavailable, InternalError
from ..session import materialize, reachable
from . import chunking, graph, measures

VECTORS = "chunk_id long, sub_idx int, embedding array<float>"


class Embedder(Protocol):
    """A model. Documents may have several vectors each, one for each part that fits the model. An embedder is sent to
    the executors, so what it loads belongs into the calls, kept once a worker."""

    def embed_query(self, text: str) -> list[float]: ...

    def embed_documents(self, texts: list[str]) -> list[list[list[float]]]: ...


class NoEmbedder:
    """Stands in where no model is installed: every call fails, so searches go by text."""

    reason = "embedding model not installed"

    def embed_query(self, text: str) -> list[float]:
        raise EmbedderUnavailable(self.reason)

    def embed_documents(self, texts: list[str]) -> list[list[list[float]]]:
        raise EmbedderUnavailable(self.reason)


class HashEmbedder:
    """A deterministic stand-in for a model: words hashed into ``size`` places, unit length, one vector for each
    ``part`` words."""

    def __init__(self, size: int = 64, part: int = 200):
        self.size, self.part = size, part

    def embed_query(self, text: str) -> list[float]:
        return self._vector(text.lower().split())

    def embed_documents(self, texts: list[str]) -> list[list[list[float]]]:
        words = [t.lower().split() for t in texts]
        return [[self._vector(w[i : i + self.part]) for i in range(0, max(1, len(w)), self.part)] for w in words]

    def _vector(self, words: list[str]) -> list[float]:
        out = [0.0] * self.size
        for w in words:
            h = zlib.crc32(w.encode())
            out[h % self.size] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class Lazy:
    """Loads a model at its first use, once a process, and remembers why it could not be loaded."""

    _loaded: dict = {}

    def __init__(self, key: str, load):
        self.key, self.load = key, load

    def model(self):
        if self.key not in self._loaded:
            try:
                self._loaded[self.key] = (self.load(), None)
            except Exception as e:
                self._loaded[self.key] = (None, str(e))
        model, reason = self._loaded[self.key]
        if model is None:
            raise EmbedderUnavailable(f"embedding model unavailable: {reason}")
        return model

    def embed_query(self, text: str) -> list[float]:
        return self.model().embed_query(text)

    def embed_documents(self, texts: list[str]) -> list[list[list[float]]]:
        return self.model().embed_documents(texts)


def worklist(chunks: DataFrame, vecs: DataFrame, edges: DataFrame, context: DataFrame | None = None, hints: list[str] | None = None) -> DataFrame:
    """(file_path, chunk_id, text, hinted, priority): embeddable chunks without vectors, with the text that a model
    reads, and what orders their files: those with a chunk of a hinted type first, then by priority and path."""
    waiting = chunks.where(measures.embeddable()).join(vecs.select("chunk_id").distinct(), "chunk_id", "left_anti")
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("name").alias("parent_name"))
    texts = waiting.join(parents, "parent_chunk_id", "left")
    if context is not None:
        texts = texts.join(context.select("file_path", "imports_text"), "file_path", "left")
    else:
        texts = texts.withColumn("imports_text", F.lit(""))
    order = graph.embedding_priority(chunks, edges, vecs)
    if hints:
        order = order.join(chunks.where(F.col("chunk_type").isin(hints)).select("file_path").distinct().withColumn("hinted", F.lit(1)), "file_path", "left")
    else:
        order = order.withColumn("hinted", F.lit(0))
    text = chunking.enriched(F.coalesce("imports_text", F.lit("")), F.col("parent_name"))
    return texts.withColumn("text", text).join(order, "file_path").select("file_path", "chunk_id", "text", F.coalesce("hinted", F.lit(0)).alias("hinted"), "priority")


def budgeted(work: DataFrame, max_chunks: int | None) -> DataFrame:
    """The files of a worklist, in order, whose chunks fit the budget: it stops before the first file that would
    exceed it, but takes at least one, and after the one that reaches it."""
    if max_chunks is None:
        return work
    order = [F.desc("hinted"), F.desc("priority"), F.asc("file_path")]
    files = work.groupBy("file_path", "hinted", "priority").agg(F.count("*").alias("n"))
    # a file has a chunk at least, so no file after the first ``max_chunks`` can be taken
    first = files.orderBy(*order).limit(max_chunks + 1)
    upto = Window.partitionBy(F.lit(0)).orderBy(*order)
    sums = first.withColumns({"sum": F.sum("n").over(upto), "before": F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1))})
    broke = F.max(F.when((F.col("sum") > max_chunks) & F.col("before").isNotNull(), 1).otherwise(0)).over(upto)
    taken = sums.withColumn("broke", broke).where((F.col("broke") == 0) & (F.coalesce("before", F.lit(0)) < max_chunks))
    return work.join(taken.select("file_path"), "file_path", "left_semi")


def embed(work: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(file_path, chunk_id, sub_idx, embedding, failure) of a worklist: one row for each vector. A batch that the model
    fails on is tried again file by file; the chunks of a file that fails have a row with the failure and no vector,
    and the run goes on: it is for the caller to say how many failures are too many."""
    reachable(work.sparkSession)
    rows = work.select("file_path", "chunk_id", "text").repartition("file_path").sortWithinPartitions("file_path", "chunk_id")
    schema = pa.schema([("file_path", pa.string()), ("chunk_id", pa.int64()), ("sub_idx", pa.int32()), ("embedding", pa.list_(pa.float32())), ("failure", pa.string())])

    def vectors(some: list[tuple]) -> list[tuple]:
        found = embedder.embed_documents([text for _, _, text in some])
        if len(found) != len(some):
            raise InternalError(f"{len(found)} embeddings for {len(some)} chunks")
        if any(not parts for parts in found):
            raise InternalError("an embedding without vectors")
        return [(f, i, s, v, None) for (f, i, _), parts in zip(some, found, strict=True) for s, v in enumerate(parts)]

    def tried(some: list[tuple]) -> Iterator[tuple]:
        try:
            yield from vectors(some)
        except Exception as e:
            if some[0][0] == some[-1][0]:
                yield from ((f, i, 0, None, str(e)) for f, i, _ in some)
            else:
                for _, group in groupby(some, key=lambda x: x[0]):
                    yield from tried(list(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for k in range(0, all_rows.num_rows, batch):
                out = list(tried(list(zip(*(c.to_pylist() for c in all_rows.slice(k, batch).columns), strict=True))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "file_path string, chunk_id long, sub_idx int, embedding array<float>, failure string")


def embed_pending(work: DataFrame, embedder: Embedder, max_failed_share: float = 0.5) -> tuple[DataFrame, dict]:
    """(new vectors (chunk_id, sub_idx, embedding), counters) of a worklist. If more than ``max_failed_share`` of the chunks
    fail, the run is an error: a model that always fails must not look like an index without work."""
    found = materialize(embed(work, embedder), "embedded")
    told = found.agg(
        F.countDistinct(F.when(F.col("failure").isNull(), F.col("chunk_id"))).alias("chunks_embedded"), F.count_if(F.col("failure").isNotNull()).alias("chunks_failed"),
        F.countDistinct(F.when(F.col("failure").isNull(), F.col("file_path"))).alias("files_completed"), F.min("failure").alias("failure"),
    ).first().asDict()
    if told["chunks_failed"] > max_failed_share * (told["chunks_embedded"] + told["chunks_failed"]):
        raise EmbedderUnavailable(told["failure"])
    return found.where("failure is null").select("chunk_id", "sub_idx", "embedding"), told


def sub_embeddings(embedded: DataFrame, vecs: DataFrame) -> DataFrame:
    """Rows (chunk_id, embeddings) as vectors with their place; chunks that have vectors already are left out."""
    return embedded.join(vecs.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.posexplode("embeddings").alias("sub_idx", "embedding"))


def with_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The vectors of embeddable chunks given one array of embeddings a file, in the order of its chunks; files whose
    counts differ are an error, raised when the rows are read."""
    order = F.row_number().over(Window.partitionBy("file_path").orderBy("chunk_order")) - 1
    own = chunks.where("chunk_type != 'inner_fn'").withColumn("k", order)
    n = F.count("*").over(Window.partitionBy("file_path"))
    both = own.withColumn("n", n).join(embeddings, "file_path")
    wrong = F.raise_error(F.format_string("%s: %d chunks but %d embeddings", "file_path", F.col("n").cast("long"), F.size("embeddings").cast("long"))).cast("array<float>")
    return both.select("file_path", "chunk_id", F.when(F.size("embeddings") == F.col("n"), F.get("embeddings", F.col("k"))).otherwise(wrong).alias("embedding"))
