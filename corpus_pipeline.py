"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage works on all rows that the one before kept.

1. ``language``: rows whose text has no identifiable language go.
2. ``near_duplicates``: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the
   smallest id stays.
3. ``decontaminate``: rows in which a ten-word window of a benchmark item occurs go.
4. ``secrets``: spans of secrets are replaced by a mark; ``n_chars`` follows.
5. ``pack``: texts are cut and packed into sequences of at most 2048 tokens.

Edge cases: null texts and texts without a letter have no language and go in stage 1; alone, stages 2 to 4 keep
them and stage 5 packs them as one closing token. A row with a null id is never a near duplicate. Rows that
repeat both id and text share a component, so all stay where their id is the smallest, and go where it isn't.
Texts of any length are read whole. Empty tables pass every stage and give no rows. Extra columns, whatever they
are called, are kept by the first four stages and ignored by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmine.llm import decontaminate as _decontaminate
from glintmine.llm import lang_id, ngram_join, packing, secret_scan
from glintmine.llm.common import materialize, table
from glintmine.llm.queries import CAPACITY, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs, "text", "lang", F.lit(True), F.col("doc_id"))
    return lang_id.keep_identified(docs, "text", model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train(secret_scan.corpus_words(docs, "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer=tokenizer_path, capacity=CAPACITY)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

#: No SQL can identify languages, search secrets by models or tokenize; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
