"""Exact nearest neighbours and MaxSim over sub-vectors (chunk_id, sub_idx, embedding)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import has_prefix


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, summed in double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(vecs: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k nearest sub-vectors: a bounded top-k, ties by chunk and place."""
    return vecs.select("chunk_id", "sub_idx", l2(F.col("embedding"), constant(vector)).alias("distance")).orderBy("distance", "chunk_id", "sub_idx").limit(k)


def maxsim(hits: DataFrame) -> DataFrame:
    return hits.groupBy("chunk_id").agg(F.min("distance").alias("distance"))


def knn_multi(vecs: DataFrame, vectors: list[list[float]], k: int) -> DataFrame:
    """MaxSim over several stated query vectors, k sub-vectors each: one bounded top-k for each."""
    each = [knn(vecs, v, k) for v in vectors]
    return maxsim(reduce(DataFrame.unionByName, each))


def search(vecs: DataFrame, chunks: DataFrame, vectors: list[list[float]], limit: int, types: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Nearest chunks. Filters come after the neighbours are found, so the result may be short."""
    near = maxsim(knn(vecs, vectors[0], 10 * limit)) if len(vectors) == 1 else knn_multi(vecs, vectors, 10 * limit)
    found = near.join(chunks, "chunk_id")
    if types:
        found = found.where(F.col("chunk_type").isin(types))
    return found.where(has_prefix(F.col("file_path"), prefixes or [])).orderBy("distance", "chunk_id").limit(limit)


def target_chunks(chunks: DataFrame, file: str, symbol: str | None = None) -> DataFrame:
    """(chunk_id) of a file's chunks, or of those with the symbol's name, but for inner functions."""
    wanted = (F.col("file_path") == file) & (F.col("chunk_type") != "inner_fn")
    return chunks.where(wanted & (F.col("name") == symbol) if symbol is not None else wanted).select("chunk_id")


def stored_vectors(vecs: DataFrame, sources: list[int], most: int = 20) -> list[list[float]]:
    """The first ``most`` stored vectors of some chunks, by chunk and place."""
    rows = vecs.where(F.col("chunk_id").isin(sources)).orderBy("chunk_id", "sub_idx").limit(most).select("embedding").collect()
    return [list(r[0]) for r in rows]


def from_target(vecs: DataFrame, chunks: DataFrame, sources: list[int], limit: int, prefixes: list[str] | None = None) -> DataFrame:
    """Chunks like the stored vectors of the ``sources``, without those."""
    vectors = stored_vectors(vecs, sources)
    if not vectors:
        return search(vecs, chunks, [[0.0]], 0)
    found = search(vecs, chunks, vectors, limit + len(sources), prefixes=prefixes)
    return found.where(~F.col("chunk_id").isin(sources)).orderBy("distance", "chunk_id").limit(limit)
