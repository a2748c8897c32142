"""Views of the driver's tables as chunks, edges and vectors; one SQL text for Spark and the oracle."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

from ..operators import fulltext
from ..session import materialize

CHUNKS = """
WITH base AS (
  SELECT doc_id, text, lang, source,
    concat(CASE CAST(doc_id % 10 AS INT) WHEN 6 THEN 'src/__tests__/' WHEN 7 THEN 'node_modules/lib/' WHEN 8 THEN 'examples/' WHEN 9 THEN 'tests/' ELSE 'src/' END,
      lang, '/', source, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '.tsx' WHEN 1 THEN '.rs' ELSE '.md' END) AS file_path,
    CASE CAST(doc_id % 14 AS INT) WHEN 0 THEN 'component' WHEN 1 THEN 'hook' WHEN 2 THEN 'type_def' WHEN 3 THEN 'css_rule' WHEN 4 THEN 'html_element' WHEN 5 THEN 'test_case'
      WHEN 6 THEN 'rust_fn' WHEN 7 THEN 'rust_struct' WHEN 8 THEN 'rust_enum' WHEN 9 THEN 'rust_trait' WHEN 10 THEN 'rust_impl' WHEN 11 THEN 'md_section' WHEN 12 THEN 'other' ELSE 'inner_fn' END AS chunk_type
  FROM {documents})
SELECT doc_id AS chunk_id, file_path, chunk_type, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('use', upper(lang), 'Chunk', doc_id) END AS name, text AS content,
  CAST(10 * row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS INT) AS start_line,
  CAST(10 * row_number() OVER (PARTITION BY file_path ORDER BY doc_id) + 8 AS INT) AS end_line, CASE WHEN chunk_type = 'inner_fn' THEN doc_id - 1 END AS parent_chunk_id,
  CASE WHEN doc_id % 50 = 0 THEN NULL WHEN file_path LIKE 'node_modules/%' THEN 'vendor' WHEN file_path LIKE 'tests/%' OR contains(file_path, '/__tests__/') THEN 'test' ELSE 'src' END AS source_kind
FROM base"""

EDGES = """
SELECT concat('o:', o_orderkey) AS source_file, concat('c:', o_custkey) AS target_file, o_orderpriority AS symbol_name, 'named' AS ref_kind FROM {orders}
UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), c_mktsegment, 'default' FROM {customer}
UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), CAST(NULL AS {string}), 'side_effect' FROM {supplier}
UNION ALL SELECT concat('n:', n_nationkey), concat('r:', n_regionkey), n_name, 'mod_decl' FROM {nation}
UNION ALL SELECT concat('o:', l_orderkey), concat('s:', l_suppkey), concat(l_returnflag, l_linestatus), 'type_only' FROM {lineitem}"""

CYCLE = """
SELECT concat('p:', p_partkey) AS source_file, concat('p:', (p_partkey * 31 + 7) % (SELECT count(*) FROM {part})) AS target_file, p_brand AS symbol_name, 'named' AS ref_kind FROM {part}
UNION ALL SELECT concat('p:', p_partkey), concat('p:', (p_partkey * 17 + 3) % (SELECT count(*) FROM {part})), CAST(NULL AS {string}), 'namespace' FROM {part} WHERE p_partkey % 5 = 0"""

VECS = "SELECT CAST(floor(vec_id / 2) AS BIGINT) AS chunk_id, CAST(vec_id % 2 AS INT) AS sub_idx, embedding, label FROM {embeddings}"

#: Fewer vectors than nine of a hundred embeddable chunks: scores by vectors count for less.
SPARSE = "SELECT * FROM (" + VECS + ") x WHERE chunk_id % 8 = 3"

#: References between the files of chunks.
LINKS = "WITH c AS (" + CHUNKS + """)
SELECT a.file_path AS source_file, b.file_path AS target_file, a.name AS symbol_name, CASE CAST(a.chunk_id % 4 AS INT) WHEN 0 THEN 'named' WHEN 1 THEN 'namespace' WHEN 2 THEN 'type_only' ELSE 'default' END AS ref_kind
FROM c a CROSS JOIN (SELECT count(*) AS n FROM {documents}) k JOIN c b ON b.chunk_id = (a.chunk_id * 7 + 1) % k.n WHERE a.chunk_id % 5 = 0"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{string}", "STRING"), **used)


_indexes: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a folder as an index keeps them, with the forms that full-text search matches: written once a
    session, as an index run writes them, and read by every search."""
    kept = _indexes.setdefault(spark, {})
    if sf_dir not in kept:
        kept[sf_dir] = materialize(fulltext.indexed(view(spark, sf_dir, CHUNKS)), "chunk-index")
    return kept[sf_dir]


def oracle(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES}, string="VARCHAR")


#: Common table expressions for the oracle.
WITH = f"WITH RECURSIVE chunks AS ({oracle(CHUNKS)}), edges AS ({oracle(EDGES)}), cyc AS ({oracle(CYCLE)}), vecs AS ({oracle(VECS)}), sparse AS ({oracle(SPARSE)}), links AS ({oracle(LINKS)})"
