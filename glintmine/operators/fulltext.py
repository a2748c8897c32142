"""Full-text matching over name, content and path: substring AND, document frequency and weighted BM25.

Texts are matched as they are indexed: names as the words of the identifier, all fields with NFKC and A-Z
lower-cased. A table that has been through ``indexed`` has these forms as columns; for others they are worked out.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import has_prefix
from ..functions.text import normalize, normalized, split_identifier

# Fixed values that results depend on.
WEIGHTS = {"name": 5.0, "content": 1.0, "file_path": 3.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def indexed(chunks: DataFrame) -> DataFrame:
    """Adds the forms that are matched, as fts_name, fts_content and fts_file_path, and fts_size, their trigrams."""
    if "fts_size" in chunks.columns:
        return chunks
    name = F.array_join(split_identifier(F.coalesce("name", F.lit(""))), " ")
    forms = {"name": name, "content": F.coalesce("content", F.lit("")), "file_path": F.coalesce("file_path", F.lit(""))}
    added = chunks.withColumns({f"fts_{k}": normalized(v) for k, v in forms.items()})
    return added.withColumn("fts_size", reduce(add, [F.greatest(F.length(f"fts_{k}") - 2, F.lit(0)) for k in forms]))


def terms(keywords: list[str]) -> list[str]:
    """Keywords as they are matched. Fewer than three characters form no trigram and match nothing."""
    return [normalize(k) for k in keywords]


def contains(term: str) -> Column:
    if len(term) < 3:
        return F.lit(False)
    return reduce(or_, [F.contains(F.col(f"fts_{c}"), F.lit(term)) for c in WEIGHTS])


def occurrences(text: Column, term: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))


def figures(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """One row over all chunks, in one pass: how many there are, their average size, and the document frequency
    of each keyword."""
    counts = [F.count_if(contains(k)).alias(f"df{i}") for i, k in enumerate(terms(keywords))]
    return indexed(chunks).agg(F.count("*").alias("n"), F.coalesce(F.avg("fts_size"), F.lit(1.0)).alias("avg_size"), *counts)


def document_frequency(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, df, idf) in one pass over the chunks."""
    counts = figures(chunks, keywords)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"df{i}").alias("df")) for i, k in enumerate(keywords)]))
    each = counts.select("n", rows.alias("x")).select("n", "x.*")
    return each.select("keyword", F.col("df").cast("long").alias("df"), idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.greatest(n, F.lit(1)) / F.greatest(df, F.lit(1)))


def bm25(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """The chunks in which all keywords occur, with ``bm25`` (higher is better) and ``score`` in 0..1. Corpus figures
    are one row, read as a scalar subquery."""
    chunks, words = indexed(chunks), terms(keywords)
    one = figures(chunks, keywords)
    matched = chunks.where(reduce(and_, [contains(k) for k in words], F.lit(bool(words))))
    found = matched.withColumn("figures", one.select(F.struct("*")).scalar())
    total = F.lit(0.0)
    for i, k in enumerate(words):
        n, df = F.col("figures.n"), F.col(f"figures.df{i}")
        weight = F.greatest(F.lit(LEAST_IDF), F.log((n - df + 0.5) / (df + 0.5)))
        f = reduce(add, [F.lit(w) * occurrences(F.col(f"fts_{c}"), k) for c, w in WEIGHTS.items()]) if len(k) > 2 else F.lit(0.0)
        total = total + weight * f * (K1 + 1) / (f + K1 * ((1 - B) + B * F.col("fts_size") / F.col("figures.avg_size")))
    found = found.withColumn("bm25", total).drop("figures")
    return found.withColumn("score", F.col("bm25") / (1 + F.col("bm25")))


def search(
    chunks: DataFrame, keywords: list[str], limit: int, types: list[str] | None = None, exclude: DataFrame | None = None, include: DataFrame | None = None, prefixes: list[str] | None = None
) -> DataFrame:
    """The best chunks by BM25; filters of type, path and ids don't change what the corpus figures cover. No
    keywords find nothing."""
    found = bm25(chunks, keywords).where(has_prefix(F.col("file_path"), prefixes or []))
    if types:
        found = found.where(F.col("chunk_type").isin(types))
    if exclude is not None:
        found = found.join(exclude.select("chunk_id"), "chunk_id", "left_anti")
    if include is not None:
        found = found.join(include.select("chunk_id"), "chunk_id", "left_semi")
    return found.orderBy(F.desc("score"), "chunk_id").limit(limit)


def trigrams(chunks: DataFrame) -> DataFrame:
    """(trigram, chunk_id): the postings of an index, one row for each different trigram of a chunk; write it
    bucketed or sorted by trigram."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    every = F.array_distinct(F.concat(*[grams(F.col(f"fts_{c}")) for c in WEIGHTS]))
    return indexed(chunks).select("chunk_id", F.explode(every).alias("trigram")).where(F.length("trigram") == 3).select("trigram", "chunk_id")


def candidates(postings: DataFrame, keywords: list[str]) -> DataFrame:
    """The chunks that have every trigram of every keyword, from the postings: a superset of the matches."""
    wanted = sorted({k[i : i + 3] for k in terms(keywords) for i in range(len(k) - 2)})
    if not wanted or min(map(len, terms(keywords))) < 3:
        return postings.select("chunk_id").limit(0)
    found = postings.where(F.col("trigram").isin(wanted)).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("chunk_id")
