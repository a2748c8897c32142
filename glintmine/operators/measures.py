"""Index statistics, pattern scanning, and precision / recall reports."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embeddable() -> Column:
    return (F.col("chunk_type") != "inner_fn") & ~F.col("source_kind").eqNullSafe("test")


def index_stats(chunks: DataFrame, vecs: DataFrame) -> DataFrame:
    """One row: files, chunks, embeddable and embedded chunks, and floored coverage in percent."""
    with_vectors = vecs.select("chunk_id").distinct().withColumn("has", F.lit(True))
    one = chunks.join(with_vectors, "chunk_id", "left").agg(
        F.countDistinct("file_path").alias("total_files"), F.count("*").alias("total_chunks"), F.count_if(embeddable()).alias("embeddable_chunks"),
        F.count_if(embeddable() & F.col("has").isNotNull()).alias("embedded_chunks"),
    )
    percent = F.when(F.col("embeddable_chunks") == 0, 0).otherwise(F.least(F.lit(100), F.floor(100 * F.col("embedded_chunks") / F.col("embeddable_chunks"))))
    return one.withColumn("coverage_percent", percent.cast("long"))


def coverage(chunks: DataFrame, vecs: DataFrame) -> DataFrame:
    """One row: the share of embeddable chunks that have a vector; 0 if there are none."""
    one = index_stats(chunks, vecs)
    return one.select(F.when(F.col("embeddable_chunks") == 0, 0.0).otherwise(F.col("embedded_chunks") / F.col("embeddable_chunks")).alias("coverage"))


def status(chunks: DataFrame, vecs: DataFrame, edges: DataFrame) -> DataFrame:
    """index_stats() with the number of references."""
    return index_stats(chunks, vecs).withColumn("references", edges.agg(F.count("*")).scalar())


@dataclass(frozen=True)
class Pattern:
    id: str
    pattern: str
    flags: tuple[str, ...]
    regex: bool = False

    def __post_init__(self):
        if self.regex:
            try:
                re.compile(self.pattern)
            except re.error as e:
                raise ValueError(f"invalid regex in {self.id}: {e}") from e

    def matches(self, text: Column) -> Column:
        return text.rlike(self.pattern) if self.regex else F.contains(text, F.lit(self.pattern))


def flags(text: Column, patterns: list[Pattern]) -> Column:
    """Flags of all patterns that occur, in the corpus's order, repeats kept: static columns, no join."""
    none = F.array().cast("array<string>")
    if not patterns:
        return none
    return F.concat(*[F.when(p.matches(text), F.array(*map(F.lit, p.flags))).otherwise(none) for p in patterns])


def verification(judged: DataFrame) -> DataFrame:
    """Precision and recall of rows (expected, found); 1.0 and degraded where nothing can be divided."""
    counts = judged.agg(F.count_if(F.expr("expected and found")).alias("tp"), F.count_if(F.expr("not expected and found")).alias("fp"), F.count_if(F.expr("expected and not found")).alias("fn"))
    ratio = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall"), ((tp + fp == 0) | (tp + fn == 0)).alias("degraded"))


def recall_report(wanted: DataFrame) -> DataFrame:
    """Rows (entry, weight, found, reachable): recall, and the share of reachable weight that was found."""
    n, weight = F.count("*"), F.sum(F.when(F.col("reachable"), F.col("weight")).otherwise(0.0))
    hit = F.sum(F.when(F.col("reachable") & F.col("found"), F.col("weight")).otherwise(0.0))
    return wanted.groupBy("entry").agg((F.count_if("found") / n).alias("recall"), F.when(weight == 0, 1.0).otherwise(hit / weight).alias("cap_fit"), (weight == 0).alias("degraded"))


def judged_entries(wanted: DataFrame, output: DataFrame, reachable: DataFrame) -> DataFrame:
    """Rows (entry, path, weight) of files that an answer must have, with ``found`` and ``reachable``: whether the
    entry's ``output`` and what it could reach, both (entry, path), have the file."""
    has = lambda df, name: df.select("entry", "path").distinct().withColumn(name, F.lit(True))
    both = wanted.join(has(output, "found"), ["entry", "path"], "left").join(has(reachable, "reachable"), ["entry", "path"], "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("found", "reachable")})


def corpus_report(entries: DataFrame) -> DataFrame:
    """One row over recall_report() rows: means, and whether any is degraded; without entries 1.0, 1.0 and degraded."""
    return entries.agg(F.coalesce(F.avg("recall"), F.lit(1.0)).alias("recall"), F.coalesce(F.avg("cap_fit"), F.lit(1.0)).alias("cap_fit"), F.coalesce(F.bool_or("degraded"), F.lit(True)).alias("degraded"))


def gate(report: DataFrame, floor: float) -> DataFrame:
    """Adds ``passes``: whether the mean recall reaches the floor, inclusive."""
    return report.withColumn("passes", F.col("recall") >= floor)


def near_seeds(wanted: DataFrame, seeds: DataFrame, forward: DataFrame) -> DataFrame:
    """Rows (entry, path) with ``near``: whether the file is a seed or one step forward of it; null for entries of
    which no closure is known."""
    near = seeds.select("entry", "path").unionByName(forward.select("entry", "path")).distinct().withColumn("near", F.lit(True))
    proven = forward.select("entry").distinct().withColumn("proven", F.lit(True))
    both = wanted.join(near, ["entry", "path"], "left").join(proven, "entry", "left")
    return both.withColumn("near", F.when(F.col("proven"), F.coalesce("near", F.lit(False)))).drop("proven")


def throughput(chunks: int, milliseconds: int) -> int:
    """Chunks a second, truncated; 0 where no time has passed."""
    return chunks * 1000 // milliseconds if milliseconds > 0 else 0


def canary(wanted: DataFrame) -> DataFrame:
    """An entry fails if all of its wanted files are trivially near (``near``, null for unknown closures)."""
    return wanted.groupBy("entry").agg((F.bool_and("near") | F.bool_or(F.col("near").isNull())).alias("fails"))
