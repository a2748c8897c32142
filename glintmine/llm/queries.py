"""The contract queries: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lang_id, ngram_join, packing, quality, secret_scan, substring_dedup, toxicity, url_filter
from .common import remainder, table

CAPACITY = 2048
URL_RULES = [url_filter.UrlRule("org/", True), url_filter.UrlRule("example.org/es/", False), url_filter.UrlRule("example.org/en/1", False), url_filter.UrlRule("com/fr/", True), url_filter.UrlRule("com/de/", False)]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = lang_id.fit(docs, "text", "lang", (remainder("doc_id", 4) != 2), F.col("doc_id"))
    return lang_id.identify(docs, [F.col("doc_id"), held.alias("held_out")], "text", model)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path, capacity=CAPACITY)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.corpus_words(docs, "text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0, "doc_id", "text", "doc_id", "toxic")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, [F.col("doc_id"), held.alias("held_out")], "text", model)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_secret_scan, op4_quality_rules, op5_html_text, op6_url_filter, op7_decontamination, op8_ngram_join, op9_toxicity, op10_substring_dedup)}
