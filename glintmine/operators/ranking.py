"""Hybrid ranking: union of both arms, confidence and bonuses, per-file cap, pagination and model reranking."""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path

# Fixed values that results depend on.
OVERLAP_BONUS, TYPE_BONUS, IMPORT_BONUS, TEST_PENALTY, PER_FILE = 0.05, 0.03, 0.03, 0.05, 2


def confidence(coverage):
    """What a semantic score counts for at a coverage, a number or a column."""
    if isinstance(coverage, Column):
        return F.least(F.lit(1.0), 2.0 * F.sqrt(coverage) + 0.4)
    return min(1.0, 2.0 * coverage**0.5 + 0.4)


def hit_ratio(keywords: list[str], idfs: list, with_content: bool = True) -> Column:
    """The idf share (numbers or columns) of keywords in name, path or content; a plain share where idfs say
    nothing."""
    if not keywords:
        return F.lit(0.0)
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "file_path", *(["content"] if with_content else []))]
    weights = [x if isinstance(x, Column) else F.lit(float(x)) for x in idfs]
    found = [reduce(or_, [F.contains(c, F.lit(k)) for c in fields]) for k in keywords]
    share = lambda ws: reduce(add, [F.when(x, w).otherwise(0.0) for x, w in zip(found, ws, strict=True)]) / reduce(add, ws)
    return F.when(reduce(add, weights) < 1e-6, share([F.lit(1.0)] * len(keywords))).otherwise(share(weights))


def union(semantic: DataFrame, text: DataFrame) -> DataFrame:
    """Both arms' hits (chunk_id, base, source); a chunk of both counts as semantic."""
    return semantic.unionByName(text.join(semantic.select("chunk_id"), "chunk_id", "left_anti"))


def quartile(counted: DataFrame) -> Column:
    """The least import count of the top quarter of files that are imported at all, as a scalar; 0 if none."""
    counts = counted.where("import_count > 0").agg(F.sort_array(F.collect_list("import_count")).alias("c"))
    n = F.size("c")
    at = F.greatest(n - (F.floor(n / 4).cast("int") + 1), F.lit(0)) + 1
    return counts.select(F.when(n > 0, F.try_element_at("c", at.cast("int"))).otherwise(0).alias("q")).scalar()


def rerank(hits: DataFrame, imports: DataFrame, keywords: list[str], idfs: list, hints: list[str], coverage=1.0) -> DataFrame:
    """Adds ``score`` to hits (file_path, name, content, chunk_type, base, source, ...). ``imports``: (file_path,
    import_count) of files; ``coverage``: of vectors, a number or a scalar column."""
    counted = hits.select("file_path").distinct().join(imports, "file_path", "left").select("file_path", F.coalesce("import_count", F.lit(0)).alias("import_count"))
    least = quartile(counted)
    joined = hits.join(counted, "file_path")
    semantic = F.col("source") == "semantic"
    base = F.when(semantic, F.col("base") * confidence(coverage)).otherwise(F.col("base"))
    overlap = F.when(semantic, OVERLAP_BONUS * hit_ratio(keywords, idfs)).otherwise(0.0)
    typed = F.when(F.col("chunk_type").isin(hints), TYPE_BONUS).otherwise(0.0) if hints else F.lit(0.0)
    imported = F.when((least > 0) & (F.col("import_count") >= least), IMPORT_BONUS).otherwise(0.0)
    tested = F.lit(0.0) if "test_case" in hints else F.when(is_test_path(F.col("file_path")), TEST_PENALTY).otherwise(0.0)
    return joined.withColumn("score", base + overlap + typed + imported - tested)


class Reranker(Protocol):
    """A cross-encoder: the scores of pairs (query, content). It is sent to the executors, so what it loads belongs
    into the call, kept in the worker."""

    def score(self, query: str, contents: list[str]) -> list[float]: ...


def cross_encoder(scored: DataFrame, query: str, reranker: Reranker) -> DataFrame:
    """``scored`` with the model's scores. Where the model fails, or gives no number for each pair, the scores stay:
    of a batch as large as a search's hits, that is of all of them."""
    ranked = scored.coalesce(1)  # a search's candidates: at most some hundred rows, one batch for the model

    def judged(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True)
        try:
            found = list(reranker.score(query, frame["content"].fillna("").tolist()))
            if len(found) == len(frame):
                frame["score"] = [float(x) for x in found]
        except Exception:
            pass  # a model's failure never fails a search: the heuristic order is kept
        yield frame

    return ranked.mapInPandas(judged, scored.schema)


def ranked(scored: DataFrame) -> list[Column]:
    return [F.desc("score"), F.asc(F.when(F.col("source") == "semantic", 0).otherwise(1)), F.asc("chunk_id")]


def cap_per_file(scored: DataFrame, most: int = PER_FILE) -> DataFrame:
    return scored.withColumn("in_file", F.row_number().over(Window.partitionBy("file_path").orderBy(*ranked(scored)))).where(F.col("in_file") <= most).drop("in_file")


def page(scored: DataFrame, offset: int, limit: int) -> DataFrame:
    return cap_per_file(scored).orderBy(*ranked(scored)).offset(offset).limit(limit)


def first_files(found: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(file_path, position): the first ``most`` different files in the order of their best rows."""
    first = Window.partitionBy("file_path").orderBy(*order)
    top = found.withColumn("in_file", F.row_number().over(first)).where("in_file = 1").orderBy(*order).limit(most)
    return top.select("file_path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("position"))
