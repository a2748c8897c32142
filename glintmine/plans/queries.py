"""One query for each operator over the given tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, paths, text
from ..operators import brief, chunking, embedding, fulltext, graph, lookups, measures, ranking, search, vectors
from ..sources import index
from . import staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "indexed":
            return staging.chunk_index(self.spark, self.dir)
        if name in ("chunks", "edges", "cycle", "vecs", "sparse", "links"):
            return staging.view(self.spark, self.dir, getattr(staging, name.upper()))
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def index(self, vecs: str = "sparse") -> search.Index:
        return search.Index(self.indexed, getattr(self, vecs), self.links)


def query(sql: str | None):
    def add(make):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[make.__name__] = staging.WITH + sql
        return make

    return add


def rounded(c, name: str, places: int = 6):
    return F.round(c, places).alias(name)


L2 = "sqrt(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
WORDS = ["thing", "oning"]
HIT = "(contains(lower(coalesce(name, '')), '{0}') OR contains(lower(coalesce(content, '')), '{0}') OR contains(lower(coalesce(file_path, '')), '{0}'))"
PARTS = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[-_]+', ' ', 'g'))"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: What full-text search matches.
FTS = f", fts AS (SELECT *, greatest(length(f_name) - 2, 0) + greatest(length(f_content) - 2, 0) + greatest(length(f_file_path) - 2, 0) AS size FROM (SELECT *, {LOWER.format(PARTS.format('name'))} AS f_name, {LOWER.format('content')} AS f_content, {LOWER.format('file_path')} AS f_file_path FROM chunks))"
MATCH = "(contains(f_name, '{0}') OR contains(f_content, '{0}') OR contains(f_file_path, '{0}'))"
EMB = "(chunk_type <> 'inner_fn' AND source_kind IS DISTINCT FROM 'test')"


@query(f""" SELECT CAST(count(DISTINCT file_path) AS BIGINT) AS total_files, count(*) AS total_chunks, count(*) FILTER (WHERE {EMB}) AS embeddable_chunks,
 count(*) FILTER (WHERE {EMB} AND chunk_id IN (SELECT chunk_id FROM vecs)) AS embedded_chunks,
 CAST(floor(100 * count(*) FILTER (WHERE {EMB} AND chunk_id IN (SELECT chunk_id FROM vecs)) / count(*) FILTER (WHERE {EMB})) AS BIGINT) AS coverage_percent FROM chunks""")
def index_stats(t):
    return measures.index_stats(t.chunks, t.vecs)


@query(f" SELECT chunk_id, file_path FROM chunks WHERE {EMB}")
def embeddable_chunks(t):
    return t.chunks.where(measures.embeddable()).select("chunk_id", "file_path")


@query(f" SELECT chunk_id FROM chunks WHERE {EMB} AND chunk_id NOT IN (SELECT chunk_id FROM vecs)")
def unembedded_anti(t):
    return t.chunks.where(measures.embeddable()).join(t.vecs.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id")


@query(""", part_files AS (SELECT doc_id AS chunk_id, concat('n:', doc_id % 25) AS file_path, chunk_type FROM documents JOIN chunks ON chunk_id = doc_id)
SELECT file_path, CAST((SELECT count(*) FROM edges WHERE target_file = f.file_path) + CASE WHEN EXISTS (SELECT 1 FROM part_files p WHERE p.file_path = f.file_path AND chunk_type IN ('hook', 'component')) THEN 3 ELSE 0 END AS BIGINT) AS priority
FROM (SELECT DISTINCT file_path FROM part_files WHERE chunk_id NOT IN (SELECT chunk_id FROM vecs)) f""")
def embed_priority(t):
    files = t.chunks.select("chunk_id", F.concat(F.lit("n:"), F.col("chunk_id") % 25).alias("file_path"), "chunk_type")
    return graph.embedding_priority(files, t.edges, t.vecs)


@query(""" SELECT f.file_path, CAST(coalesce(n, 0) AS BIGINT) AS import_count FROM (SELECT concat('c:', c_custkey) AS file_path FROM customer) f
LEFT JOIN (SELECT target_file, count(DISTINCT source_file) AS n FROM edges GROUP BY 1) e ON e.target_file = f.file_path""")
def import_counts_left(t):
    return graph.import_counts(t.edges, t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("file_path")))


@query(" SELECT chunk_id, chunk_type FROM chunks WHERE chunk_type IN ('hook', 'rust_fn')")
def chunk_type_filter(t):
    return t.chunks.where(F.col("chunk_type").isin("hook", "rust_fn")).select("chunk_id", "chunk_type")


@query(" SELECT chunk_id, file_path FROM chunks WHERE starts_with(file_path, 'src/en') OR starts_with(file_path, 'examples/')")
def path_prefix_filter(t):
    return t.chunks.where(paths.has_prefix(F.col("file_path"), ["src/en", "examples/"])).select("chunk_id", "file_path")


@query(""" SELECT chunk_id, CASE WHEN list_has_any(string_split(file_path, '/')[:-2], ['node_modules', 'vendor', 'third_party', 'bower_components', 'dist', 'build', 'target', '.git']) THEN 'vendor'
WHEN list_has_any(string_split(file_path, '/')[:-2], ['tests', 'test', '__tests__', 'specs', 'spec']) THEN 'test' ELSE 'src' END AS kind FROM chunks""")
def source_kind_classify(t):
    return t.chunks.select("chunk_id", paths.source_kind(F.col("file_path")).alias("kind"))


@query(" SELECT chunk_id, (contains(file_path, '__tests__') OR starts_with(file_path, 'test/') OR starts_with(file_path, 'examples/') OR contains(file_path, '/examples/') OR contains(file_path, '/test/')) AS is_test FROM chunks")
def is_test_path(t):
    return t.chunks.select("chunk_id", paths.is_test_path(F.col("file_path")).alias("is_test"))


@query(" SELECT c.chunk_id, p.name AS parent_name FROM chunks c LEFT JOIN chunks p ON p.chunk_id = c.parent_chunk_id")
def parent_self_join(t):
    parents = t.chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("name").alias("parent_name"))
    return t.chunks.select("chunk_id", "parent_chunk_id").join(parents, "parent_chunk_id", "left").select("chunk_id", "parent_name")


_SOME = "(SELECT file_path FROM chunks WHERE chunk_id % 97 = 0)"
_CONTEXT = "(SELECT file_path, string_agg(chunk_type, chr(10) ORDER BY chunk_id) AS imports_text, CASE WHEN length(file_path) % 3 = 0 THEN NULL ELSE CAST(min(chunk_id) AS BIGINT) END AS mtime_epoch FROM chunks GROUP BY 1)"


def _some(t):
    return t.chunks.where("chunk_id % 97 = 0").select("file_path")


def _context(t):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk_type"))), lambda x: x["chunk_type"]), "\n")
    return t.chunks.groupBy("file_path").agg(lines.alias("imports_text"), F.min("chunk_id").alias("least")).select("file_path", "imports_text", F.when(F.length("file_path") % 3 != 0, F.col("least")).alias("mtime_epoch"))


@query(f" SELECT file_path, name, chunk_type, start_line, end_line FROM chunks WHERE file_path IN {_SOME}")
def siblings(t):
    return lookups.siblings(t.chunks, _some(t))


@query(f" SELECT chunk_id, file_path, start_line FROM chunks WHERE file_path IN {_SOME}")
def chunks_of_files(t):
    return lookups.chunks_of_files(t.chunks, _some(t)).select("chunk_id", "file_path", "start_line")


@query(" SELECT chunk_id, name FROM chunks WHERE chunk_id % 5 = 1 AND chunk_type IN ('hook', 'other') AND starts_with(file_path, 'src/')")
def chunks_by_ids(t):
    return lookups.chunks_by_ids(t.chunks, t.chunks.where("chunk_id % 5 = 1").select("chunk_id"), ["hook", "other"], ["src/"]).select("chunk_id", "name")


@query(f" SELECT c.file_path, imports_text, coalesce(mtime_epoch, -1) AS mtime_epoch FROM {_CONTEXT} c WHERE file_path IN {_SOME}")
def file_context_lookup(t):
    context = _context(t)
    both = lookups.contexts(context, _some(t)).join(lookups.times(context, _some(t)), "file_path", "left")
    return both.select("file_path", "imports_text", F.coalesce("mtime_epoch", F.lit(-1)).cast("long").alias("mtime_epoch"))


@query(f" SELECT DISTINCT file_path FROM chunks WHERE chunk_type = 'rust_impl' AND file_path IN {_SOME}")
def files_with_types(t):
    return lookups.files_with_types(t.chunks, _some(t), ["rust_impl"])


def stored(t, *ids: int) -> list[list[float]]:
    """Query vectors: the stored vectors of given chunks."""
    return [list(r[0]) for r in t.vecs.where(F.col("chunk_id").isin(list(ids)) & (F.col("sub_idx") == 0)).orderBy("chunk_id").select("embedding").collect()]


@query(f" SELECT v.chunk_id, v.sub_idx, round({L2}, 6) AS distance FROM vecs v, (SELECT embedding FROM vecs WHERE chunk_id = 3 AND sub_idx = 0) q ORDER BY {L2}, 1, 2 LIMIT 20")
def knn_topk(t):
    return vectors.knn(t.vecs, stored(t, 3)[0], 20).withColumn("distance", F.round("distance", 6))


@query(f" SELECT chunk_id, round(min(d), 6) AS distance FROM (SELECT v.chunk_id, {L2} AS d FROM vecs v, (SELECT embedding FROM vecs WHERE chunk_id = 3 AND sub_idx = 0) q ORDER BY d, v.chunk_id, v.sub_idx LIMIT 50) GROUP BY 1")
def knn_maxsim(t):
    return vectors.maxsim(vectors.knn(t.vecs, stored(t, 3)[0], 50)).withColumn("distance", F.round("distance", 6))


@query(f""" SELECT chunk_id, round(min(d), 6) AS distance FROM (SELECT v.chunk_id, {L2} AS d, row_number() OVER (PARTITION BY q.chunk_id ORDER BY {L2}, v.chunk_id, v.sub_idx) AS k
FROM vecs v, (SELECT chunk_id, embedding FROM vecs WHERE chunk_id IN (3, 5, 8) AND sub_idx = 0) q) WHERE k <= 30 GROUP BY 1""")
def knn_multi_maxsim(t):
    return vectors.knn_multi(t.vecs, stored(t, 3, 5, 8), 30).withColumn("distance", F.round("distance", 6))


@query(f""" SELECT chunk_id, file_path, round(distance, 6) AS distance FROM (SELECT chunk_id, min(d) AS distance FROM (SELECT v.chunk_id, {L2} AS d FROM vecs v, (SELECT embedding FROM vecs WHERE chunk_id = 3 AND sub_idx = 0) q
ORDER BY d, v.chunk_id, v.sub_idx LIMIT 100) GROUP BY 1) JOIN chunks USING (chunk_id) WHERE chunk_type IN ('component', 'hook', 'other') ORDER BY distance, chunk_id LIMIT 10""")
def knn_post_filter(t):
    return vectors.search(t.vecs, t.chunks, stored(t, 3), 10, types=["component", "hook", "other"]).select("chunk_id", "file_path", rounded("distance", "distance"))


@query(f""" SELECT chunk_id, round(1 / (1 + distance), 6) AS score FROM (SELECT chunk_id, min(d) AS distance FROM (SELECT v.chunk_id, {L2} AS d,
row_number() OVER (PARTITION BY q.sub_idx ORDER BY {L2}, v.chunk_id, v.sub_idx) AS k FROM vecs v, (SELECT sub_idx, embedding FROM vecs WHERE chunk_id = 7) q) WHERE k <= 110 GROUP BY 1)
JOIN chunks USING (chunk_id) WHERE chunk_id <> 7 ORDER BY distance, chunk_id LIMIT 10""")
def from_target_similar(t):
    return vectors.from_target(t.vecs, t.chunks, [7], 10).select("chunk_id", rounded(vectors.similarity(F.col("distance")), "score"))


@query("".join([FTS, " SELECT keyword, df, round(ln(greatest(n, 1) / greatest(df, 1)), 6) AS idf FROM (SELECT count(*) AS n FROM chunks), (", " UNION ALL ".join(f"SELECT '{w}' AS keyword, count(*) FILTER (WHERE {MATCH.format(w)}) AS df FROM fts" for w in WORDS), ")"]))
def keyword_df_idf(t):
    return fulltext.document_frequency(t.indexed, WORDS).select("keyword", "df", rounded("idf", "idf"))


@query(" SELECT chunk_id, round(" + " + ".join(f"CASE WHEN {HIT.format(w)} THEN {x} ELSE 0 END" for w, x in zip(WORDS, (1.5, 0.5), strict=True)) + ", 6) / 2.0 AS ratio FROM chunks")
def keyword_hit_ratio(t):
    return t.chunks.select("chunk_id", ranking.hit_ratio(WORDS, [1.5, 0.5]).alias("ratio"))


def _bm25_sql() -> str:
    parts = []
    for k, w in enumerate(WORDS):
        f = "(" + " + ".join(f"{x} * (length(f_{c}) - length(replace(f_{c}, '{w}', ''))) / {len(w)}.0" for c, x in fulltext.WEIGHTS.items()) + ")"
        parts.append(f"greatest(1e-6, ln((n - df{k} + 0.5) / (df{k} + 0.5))) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * size / avg_size))")
    figures = ", ".join(f"count(*) FILTER (WHERE {MATCH.format(w)}) AS df{k}" for k, w in enumerate(WORDS))
    both = " AND ".join(MATCH.format(w) for w in WORDS)
    return FTS + f", figures AS (SELECT count(*) AS n, avg(size) AS avg_size, {figures} FROM fts), bm AS (SELECT fts.*, {' + '.join(parts)} AS bm25 FROM fts, figures WHERE {both})"


@query(_bm25_sql() + " SELECT chunk_id, round(bm25, 6) AS bm25 FROM bm")
def fts_match_and(t):
    return fulltext.bm25(t.indexed, WORDS).select("chunk_id", rounded("bm25", "bm25"))


@query(_bm25_sql() + " SELECT chunk_id, round(bm25 / (1 + bm25), 6) AS score FROM bm ORDER BY bm25 / (1 + bm25) DESC, chunk_id LIMIT 20")
def fts_bm25_topk(t):
    return fulltext.search(t.indexed, WORDS, 20).select("chunk_id", rounded("score", "score"))


@query(_bm25_sql() + " SELECT chunk_id FROM bm WHERE chunk_id NOT IN (SELECT chunk_id FROM vecs) ORDER BY bm25 / (1 + bm25) DESC, chunk_id LIMIT 20")
def fts_exclude_ids(t):
    return fulltext.search(t.indexed, WORDS, 20, exclude=t.vecs.select("chunk_id").distinct()).select("chunk_id")


@query(_bm25_sql() + " SELECT chunk_id FROM bm WHERE chunk_id IN (SELECT chunk_id FROM vecs) AND chunk_type IN ('hook', 'other') ORDER BY bm25 / (1 + bm25) DESC, chunk_id LIMIT 20")
def fts_include_ids(t):
    return fulltext.search(t.indexed, WORDS, 20, types=["hook", "other"], include=t.vecs.select("chunk_id").distinct()).select("chunk_id")


#: The whole composition, as search does it: limit 10 after 5, vectors of few chunks, references between files.
QUERY, LIMIT, OFFSET = " ".join(WORDS), 10, 5
_TEST = "(contains(file_path, '__tests__') OR starts_with(file_path, 'test/') OR starts_with(file_path, 'examples/') OR contains(file_path, '/examples/') OR contains(file_path, '/test/'))"
_SHARE = " + ".join(f"CASE WHEN {HIT.format(w)} THEN idf{k} ELSE 0 END" for k, w in enumerate(WORDS))
_IMPORTS = "(SELECT target_file AS file_path, count(DISTINCT source_file) AS n FROM links GROUP BY 1)"
_COVERED = f"(SELECT count(*) FILTER (WHERE chunk_id IN (SELECT chunk_id FROM sparse)) / CAST(count(*) AS DOUBLE) AS coverage FROM chunks WHERE {EMB})"
_HYBRID = _bm25_sql() + f""", sem AS (SELECT chunk_id, 1 / (1 + min(d)) AS base, 'semantic' AS source FROM (SELECT v.chunk_id, {L2} AS d FROM sparse v, (SELECT embedding FROM sparse WHERE chunk_id = 3 AND sub_idx = 0) q
ORDER BY d, v.chunk_id, v.sub_idx LIMIT {10 * (LIMIT + OFFSET)}) WHERE chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1 ORDER BY min(d), chunk_id LIMIT {LIMIT + OFFSET}),
txt AS (SELECT chunk_id, bm25 / (1 + bm25) AS base, 'fts' AS source FROM bm WHERE chunk_id NOT IN (SELECT chunk_id FROM sem) ORDER BY base DESC, chunk_id LIMIT {3 * (LIMIT + OFFSET)}),
both_arms AS (SELECT * FROM sem UNION ALL SELECT * FROM txt),
hits AS (SELECT c.*, base, source, coalesce(n, 0) AS import_count FROM both_arms JOIN chunks c USING (chunk_id) LEFT JOIN {_IMPORTS} i USING (file_path)),
pos AS (SELECT list_sort(list(import_count)) AS c FROM (SELECT DISTINCT file_path, import_count FROM hits WHERE import_count > 0)),
q AS (SELECT c[greatest(len(c) - (len(c) // 4 + 1), 0) + 1] AS least FROM pos),
rare AS (SELECT {", ".join(f"ln(n / greatest(df{k}, 1)) AS idf{k}" for k in range(len(WORDS)))} FROM figures),
scored AS (SELECT chunk_id, file_path, source, content, base * CASE WHEN source = 'semantic' THEN least(1.0, 2 * sqrt(coverage) + 0.4) ELSE 1 END
 + CASE WHEN source = 'semantic' THEN 0.05 * ({_SHARE}) / ({" + ".join(f"idf{k}" for k in range(len(WORDS)))}) ELSE 0 END
 + CASE WHEN import_count > 0 AND import_count >= least THEN 0.03 ELSE 0 END - CASE WHEN {_TEST} THEN 0.05 ELSE 0 END AS score FROM hits, q, rare, {_COVERED}),
capped AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, source DESC, chunk_id) AS k FROM scored)"""


def _found(t, capture: bool = False, reranker=None) -> search.Outcome:
    return search.pipeline(t.index(), QUERY, stored(t, 3)[0], LIMIT, OFFSET, reranker, capture=capture)


@query(_HYBRID + " SELECT chunk_id, source, round(base, 6) AS base FROM both_arms")
def hybrid_union(t):
    return _found(t, True).stages["concatenated"].select("chunk_id", "source", rounded("score", "base"))


@query(_HYBRID + " SELECT chunk_id, source, round(score, 6) AS score FROM scored")
def hybrid_rerank(t):
    return _found(t, True).stages["reranked"].select("chunk_id", "source", rounded("score", "score"))


@query(_HYBRID + f" SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY s DESC, source DESC, chunk_id) AS rank FROM (SELECT chunk_id, source, score, score AS s FROM capped WHERE k <= 2 ORDER BY score DESC, source DESC, chunk_id LIMIT {LIMIT} OFFSET {OFFSET})")
def hybrid_search(t):
    return _found(t).results.select("chunk_id", rounded("score", "score"), "rank")


@query(_HYBRID + " SELECT chunk_id, file_path FROM capped WHERE k <= 2")
def cap_per_file(t):
    scored = _found(t, True).stages["reranked"].join(t.chunks.select("chunk_id", "file_path"), "chunk_id")
    return ranking.cap_per_file(scored).select("chunk_id", "file_path")


class _Lengths:
    """A reranker that SQL can follow."""

    def score(self, query: str, contents: list[str]) -> list[float]:
        return [len(c) % 97 / 97 for c in contents]


class _Failing:
    def score(self, query: str, contents: list[str]) -> list[float]:
        raise RuntimeError("no model")


_RERANKED = _HYBRID.replace(f"LIMIT {10 * (LIMIT + OFFSET)})", f"LIMIT {10 * (4 * LIMIT + OFFSET)})").replace(f"chunk_id LIMIT {LIMIT + OFFSET})", f"chunk_id LIMIT {4 * LIMIT + OFFSET})")


@query(_RERANKED + " SELECT chunk_id, round(length(content) % 97 / 97.0, 6) AS score FROM scored")
def cross_encoder_rerank(t):
    return _found(t, True, _Lengths()).stages["reranked"].select("chunk_id", rounded("score", "score"))


@query(_RERANKED + " SELECT chunk_id, round(score, 6) AS score FROM scored")
def cross_encoder_failing(t):
    return _found(t, True, _Failing()).stages["reranked"].select("chunk_id", rounded("score", "score"))


_TEXT = _bm25_sql() + f""", txt AS (SELECT * , bm25 / (1 + bm25) AS base FROM bm ORDER BY base DESC, chunk_id LIMIT {3 * LIMIT}),
hits AS (SELECT txt.*, coalesce(i.n, 0) AS import_count FROM txt LEFT JOIN {_IMPORTS} i USING (file_path)),
q AS (SELECT c[greatest(len(c) - (len(c) // 4 + 1), 0) + 1] AS least FROM (SELECT list_sort(list(import_count)) AS c FROM (SELECT DISTINCT file_path, import_count FROM hits WHERE import_count > 0))),
scored AS (SELECT *, base + CASE WHEN import_count > 0 AND import_count >= least THEN 0.03 ELSE 0 END - CASE WHEN {_TEST} THEN 0.05 ELSE 0 END AS score FROM hits, q),
page AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) AS k FROM scored) WHERE k <= 2 ORDER BY score DESC, chunk_id LIMIT {LIMIT})"""


@query(_TEXT + " SELECT chunk_id, round(score, 6) AS score, rank, true AS degraded FROM page")
def search_without_model(t):
    out = search.search(t.index(), embedding.NoEmbedder(), QUERY, LIMIT)
    return out.results.select("chunk_id", rounded("score", "score"), "rank", F.lit(out.degraded).alias("degraded"))


@query(_TEXT + """, grp AS (SELECT file_path, row_number() OVER (ORDER BY max(score) DESC, min(rank)) AS grp FROM page GROUP BY 1)
 SELECT p.chunk_id, p.rank, grp.grp AS file_group, (SELECT string_agg(concat(coalesce(s.name, '(unnamed)'), ' ', s.chunk_type), ',' ORDER BY s.start_line) FROM chunks s WHERE s.file_path = p.file_path
 AND s.start_line NOT IN (SELECT start_line FROM page x WHERE x.file_path = p.file_path)) AS siblings, CASE WHEN p.parent_chunk_id NOT IN (SELECT chunk_id FROM page) THEN u.name END AS parent FROM page p JOIN grp USING (file_path) LEFT JOIN chunks u ON u.chunk_id = p.parent_chunk_id""")
def enrich_results(t):
    out = search.enriched(t.index(), search.search(t.index(), embedding.NoEmbedder(), QUERY, LIMIT).results)
    beside = F.array_join(F.transform("siblings", lambda x: F.concat(x["name"], F.lit(" "), x["chunk_type"])), ",")
    return out.select("chunk_id", "rank", F.col("group").alias("file_group"), beside.alias("siblings"), F.col("parent.name").alias("parent"))


@query(_bm25_sql() + " SELECT file_path, row_number() OVER (ORDER BY s DESC, id) AS position FROM (SELECT file_path, max(s) AS s, min_by(chunk_id, (-s, chunk_id)) AS id FROM (SELECT file_path, chunk_id, bm25 / (1 + bm25) AS s FROM bm ORDER BY s DESC, chunk_id LIMIT 15) GROUP BY 1 ORDER BY s DESC, id LIMIT 5)")
def seed_inference(t):
    seeds, _ = search.infer_seeds(t.index(), embedding.NoEmbedder(), QUERY)
    return t.spark.createDataFrame([(f, k) for k, f in enumerate(seeds, 1)], "file_path string, position long")


_NEAR = "SELECT chunk_id, sub_idx, [CAST(x AS DOUBLE) * 0.05 for x in embedding] AS embedding FROM vecs"
_TARGET = "(SELECT file_path FROM chunks WHERE chunk_id = 3)"
_SIMILAR = f""", near AS ({_NEAR}), src AS (SELECT chunk_id FROM chunks WHERE file_path = {_TARGET} AND chunk_type <> 'inner_fn'),
qs AS (SELECT *, row_number() OVER (ORDER BY chunk_id, sub_idx) AS q FROM near WHERE chunk_id IN (SELECT chunk_id FROM src) ORDER BY chunk_id, sub_idx LIMIT 20),
knn AS (SELECT chunk_id, min(d) AS distance FROM (SELECT v.chunk_id, {L2} AS d, row_number() OVER (PARTITION BY q.q ORDER BY {L2}, v.chunk_id, v.sub_idx) AS k FROM near v, qs q) WHERE k <= 10 * (20 + (SELECT count(*) FROM src)) GROUP BY 1),
hits AS (SELECT c.*, 1 / (1 + distance) AS base, coalesce(n, 0) AS import_count FROM (SELECT * FROM knn JOIN chunks USING (chunk_id) ORDER BY distance, chunk_id LIMIT 20 + (SELECT count(*) FROM src)) c LEFT JOIN {_IMPORTS} i USING (file_path) WHERE chunk_id NOT IN (SELECT chunk_id FROM src)),
q2 AS (SELECT c[greatest(len(c) - (len(c) // 4 + 1), 0) + 1] AS least FROM (SELECT list_sort(list(import_count)) AS c FROM (SELECT DISTINCT file_path, import_count FROM hits WHERE import_count > 0))),
scored AS (SELECT *, base + CASE WHEN import_count > 0 AND import_count >= least THEN 0.03 ELSE 0 END - CASE WHEN {_TEST} THEN 0.05 ELSE 0 END AS score FROM hits, q2),
page AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20)"""


def _scaled(t) -> search.Index:
    vecs = t.vecs.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 0.05))
    return search.Index(t.indexed, vecs, t.links)


def _target(t) -> str:
    return t.chunks.where("chunk_id = 3").first()["file_path"]


@query(_SIMILAR + " SELECT chunk_id, round(score, 6) AS score FROM page")
def search_from_file(t):
    return search.similar(_scaled(t), _target(t), limit=20).results.select("chunk_id", rounded("score", "score"))


@query(_SIMILAR + " SELECT file_path, round(max(score), 6) AS score FROM page WHERE score >= 0.7 GROUP BY 1")
def semantic_impact(t):
    return search.related(_scaled(t), _target(t)).select("file_path", rounded("score", "score"))


@query(f" SELECT chunk_id FROM chunks WHERE file_path = {_TARGET} AND chunk_type <> 'inner_fn' AND name = (SELECT name FROM chunks WHERE chunk_id = 3)")
def target_chunks(t):
    row = t.chunks.where("chunk_id = 3").first()
    return vectors.target_chunks(t.chunks, row["file_path"], row["name"])


@query(f" SELECT {_TARGET} IN (SELECT file_path FROM chunks) AS here, 'no/such.rs' IN (SELECT file_path FROM chunks) AS there")
def known_files(t):
    return t.spark.createDataFrame([(search.known_file(t.chunks, _target(t)), search.known_file(t.chunks, "no/such.rs"))], "here boolean, there boolean")


def _closure_sql(edges: str, seeds: str, depth: int, reverse: bool, name: str = "walk") -> str:
    a, b = ("target_file", "source_file") if reverse else ("source_file", "target_file")
    return f", {name} AS (SELECT f AS file_path, 0 AS depth FROM ({seeds}) UNION SELECT {b}, depth + 1 FROM {name} JOIN {edges} ON {a} = file_path WHERE depth < {depth})"


@query(_closure_sql("edges", "SELECT 'r:1' AS f", 3, True) + " SELECT file_path, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0")
def dependents_depth3(t):
    return graph.dependents(t.edges, "r:1", 3)


@query(_closure_sql("edges", "SELECT unnest(['o:1', 'o:2', 's:3']) AS f", 3, False) + " SELECT file_path, min(depth) AS depth FROM walk GROUP BY 1")
def dependencies_multi(t):
    return graph.closure(t.edges, t.spark.createDataFrame([("o:1",), ("o:2",), ("s:3",)], "file_path string"), 3)


@query(_closure_sql("edges", "SELECT 'n:4' AS f", 2, False, "fwd") + _closure_sql("edges", "SELECT 'n:4' AS f", 2, True, "bwd") + """
 SELECT file_path, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'seed' WHEN bool_or(fwd) THEN concat('forward-', min(depth)) ELSE concat('impact-', min(depth)) END AS reason
 FROM (SELECT *, true AS fwd FROM fwd UNION ALL SELECT *, false FROM bwd) GROUP BY 1""")
def closure_bidirectional(t):
    return graph.bidirectional(t.edges, t.spark.createDataFrame([("n:4",)], "file_path string"), 2)


@query(_closure_sql("cyc", "SELECT 'p:5' AS f", 6, False) + " SELECT file_path, min(depth) AS depth FROM walk GROUP BY 1")
def closure_cyclic(t):
    return graph.closure(t.cycle, t.spark.createDataFrame([("p:5",)], "file_path string"), 6)


@query(" SELECT DISTINCT source_file, ref_kind, CASE WHEN ref_kind IN ('namespace', 'side_effect') THEN NULL ELSE symbol_name END AS via_symbol FROM edges WHERE target_file = 'n:7'")
def direct_refs(t):
    return graph.direct_references(t.edges, "n:7")


@query(" SELECT DISTINCT source_file FROM edges WHERE target_file = 'n:7' AND symbol_name = 'BUILDING'")
def symbol_dependents(t):
    return graph.symbol_dependents(t.edges, "n:7", "BUILDING")


@query(" SELECT DISTINCT source_file, target_file FROM edges WHERE source_file[1:2] IN ('n:', 'r:', 's:') AND target_file[1:2] IN ('n:', 'r:', 's:')")
def edges_among(t):
    files = t.edges.select(F.col("source_file").alias("file_path")).union(t.edges.select("target_file")).distinct().where(F.substring("file_path", 1, 2).isin("n:", "r:", "s:"))
    return graph.edges_among(t.edges, files)


@query(_closure_sql("edges", "SELECT 'n:4' AS f", 2, True) + """
 SELECT w.file_path, w.depth, CASE WHEN w.depth = 1 THEN coalesce(refs, '') ELSE '' END AS refs FROM (SELECT file_path, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0) w
 LEFT JOIN (SELECT source_file, string_agg(concat(ref_kind, ':', coalesce(via, '-')), ',' ORDER BY ref_kind, via) AS refs FROM (SELECT DISTINCT source_file, ref_kind, CASE WHEN ref_kind IN ('namespace', 'side_effect') THEN NULL ELSE symbol_name END AS via FROM edges WHERE target_file = 'n:4') GROUP BY 1) d ON d.source_file = w.file_path""")
def impact_report(t):
    shown = F.array_join(F.transform("references", lambda x: F.concat(x["ref_kind"], F.lit(":"), F.coalesce(x["via_symbol"], F.lit("-")))), ",")
    return graph.impact_report(t.edges, "n:4", 2).select("file_path", "depth", shown.alias("refs"))


@query(" SELECT count(*) AS n FROM edges")
def reference_count(t):
    return graph.reference_count(t.edges).select(F.col("references").alias("n"))


@query(f""" SELECT CAST(count(DISTINCT file_path) AS BIGINT) AS total_files, count(*) AS total_chunks, (SELECT count(*) FROM edges) AS n_references,
 format('{{}}/{{}} chunks ({{}}%)', count(*) FILTER (WHERE {EMB} AND chunk_id IN (SELECT chunk_id FROM vecs)), count(*), CAST(floor(100 * count(*) FILTER (WHERE {EMB} AND chunk_id IN (SELECT chunk_id FROM vecs)) / count(*) FILTER (WHERE {EMB})) AS BIGINT)) AS coverage FROM chunks""")
def status(t):
    told = measures.status(t.chunks, t.vecs, t.edges)
    return told.select("total_files", "total_chunks", F.col("references").alias("n_references"), codecs.coverage_text(F.col("embedded_chunks"), F.col("total_chunks"), F.col("embeddable_chunks")).alias("coverage"))


@query(" SELECT chunk_id, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS BIGINT) AS round FROM chunks")
def brief_rounds(t):
    return brief.rounds(t.chunks).select("chunk_id", F.col("round").cast("long").alias("round"))


_FOLD = """, queue AS (SELECT *, row_number() OVER (ORDER BY round, depth, import_count DESC, file_path, start_line, chunk_id) AS i FROM rounds),
fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS kept
 UNION ALL SELECT q.i, CASE WHEN fits THEN used + bytes ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN chunk_id END FROM (SELECT f.*, q.i AS qi, q.bytes, q.chunk_id, n < {0} AND used + bytes <= {1} AS fits FROM fold f JOIN queue q ON q.i = f.i + 1) q2 JOIN (SELECT i FROM queue) q ON q.i = q2.qi)"""
_VENDOR = ", rounds AS (SELECT chunk_id, file_path, start_line, strlen(content) AS bytes, 1 AS depth, 0 AS import_count, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS round FROM chunks WHERE source_kind = 'vendor')"


def _bundle(t):
    sized = t.chunks.where("source_kind = 'vendor'").select("chunk_id", "file_path", "start_line", F.octet_length("content").cast("long").alias("bytes"), F.lit(1).alias("depth"), F.lit(0).alias("import_count"))
    return brief.cap(sized, 40, 80_000)


@query(_VENDOR + _FOLD.format(40, 80_000) + " SELECT chunk_id, bytes FROM rounds WHERE chunk_id IN (SELECT kept FROM fold)")
def brief_cap(t):
    return _bundle(t).select("chunk_id", "bytes")


@query(_VENDOR + _FOLD.format(40, 80_000) + """, kept AS (SELECT * FROM rounds WHERE chunk_id IN (SELECT kept FROM fold)),
need AS (SELECT DISTINCT source_file AS a, target_file AS b FROM links WHERE source_file IN (SELECT file_path FROM kept) AND target_file IN (SELECT file_path FROM kept) AND source_file <> target_file),
names AS (SELECT DISTINCT file_path AS f FROM kept),
step AS (SELECT []::VARCHAR[] AS done UNION ALL SELECT list_append(done, nxt) FROM (SELECT done, (SELECT min(f) FROM names WHERE NOT list_contains(s.done, f) AND f NOT IN (SELECT a FROM need WHERE NOT list_contains(s.done, b))) AS nxt FROM step s) WHERE nxt IS NOT NULL),
sorted AS (SELECT done FROM step ORDER BY len(done) DESC LIMIT 1),
ranked AS (SELECT f, CASE WHEN list_contains(done, f) THEN list_position(done, f) ELSE 1000000 END AS p FROM names, sorted)
SELECT chunk_id, row_number() OVER (ORDER BY p, f, start_line, chunk_id) AS position FROM kept JOIN ranked ON f = file_path""")
def brief_topo(t):
    return brief.dependency_order(_bundle(t), t.links)


@query(_closure_sql("links", f"SELECT {_TARGET} AS f", 2, False, "fwd") + _closure_sql("links", f"SELECT {_TARGET} AS f", 2, True, "bwd") + """
, near AS (SELECT file_path, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'seed' WHEN bool_or(fwd) THEN concat('forward-', min(depth)) ELSE concat('impact-', min(depth)) END AS reason
 FROM (SELECT *, true AS fwd FROM fwd UNION ALL SELECT *, false FROM bwd) GROUP BY 1)
, rounds AS (SELECT chunk_id, c.file_path, start_line, strlen(content) AS bytes, depth, reason, coalesce(n, 0) AS import_count, row_number() OVER (PARTITION BY c.file_path ORDER BY start_line, chunk_id) AS round
 FROM chunks c JOIN near USING (file_path) LEFT JOIN """ + _IMPORTS + f""" i USING (file_path) WHERE source_kind IS DISTINCT FROM 'test' OR c.file_path = {_TARGET})""" + _FOLD.format(60, 90_000) + """
 SELECT chunk_id, depth, reason, (SELECT count(DISTINCT file_path) FROM rounds) AS n_reachable FROM rounds WHERE chunk_id IN (SELECT kept FROM fold)""")
def expand_plan(t):
    found = brief.expand(t.chunks, t.links, brief.Task((_target(t),), depth=2, max_chunks=60, max_bytes=90_000))
    return found.chunks.select("chunk_id", "depth", "reason", F.lit(found.reachable.count()).alias("n_reachable"))


PATTERNS = [measures.Pattern("lit", "thing", ("a",)), measures.Pattern("re", r"(?i)\bthe\s+of\b", ("b", "c"), True), measures.Pattern("sign", "%%%", ("d",))]
_FLAGS = r"list_concat(list_concat(CASE WHEN contains(content, 'thing') THEN ['a'] ELSE []::VARCHAR[] END, CASE WHEN regexp_matches(content, '(?i)\bthe\s+of\b') THEN ['b', 'c'] ELSE []::VARCHAR[] END), CASE WHEN contains(content, '%%%') THEN ['d'] ELSE []::VARCHAR[] END)"


@query(f" SELECT chunk_id, array_to_string({_FLAGS}, ',') AS flags FROM chunks")
def injection_flags(t):
    return t.chunks.select("chunk_id", F.array_join(measures.flags(F.col("content"), PATTERNS), ",").alias("flags"))


@query(f" SELECT flag, count(*) AS n FROM (SELECT unnest({_FLAGS}) AS flag FROM chunks) GROUP BY 1")
def injection_counts(t):
    return t.chunks.select(F.explode(measures.flags(F.col("content"), PATTERNS)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(""", j AS (SELECT quality = 0 AS expected, contains(text, '%%%') OR contains(text, '!!') AS found FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE expected AND found) AS tp, count(*) FILTER (WHERE NOT expected AND found) AS fp, count(*) FILTER (WHERE expected AND NOT found) AS fn FROM j)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, tp + fp = 0 OR tp + fn = 0 AS degraded FROM c""")
def verify_metrics(t):
    found = F.contains("text", F.lit("%%%")) | F.contains("text", F.lit("!!"))
    return measures.verification(t.labels.join(t.documents, "doc_id").select((F.col("quality") == 0).alias("expected"), found.alias("found")))


_WANTED = "SELECT doc_id % 7 AS entry, CAST(1 + doc_id % 3 AS DOUBLE) AS weight, doc_id % 2 = 0 AS found, doc_id % 5 <> 0 AS reachable, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE doc_id % 7 < 2 END AS near FROM {documents}"


@query(f", w AS ({staging.oracle(_WANTED)}) SELECT entry, CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*) AS recall, sum(weight) FILTER (WHERE reachable AND found) / sum(weight) FILTER (WHERE reachable) AS cap_fit, false AS degraded FROM w GROUP BY 1")
def recall_capfit(t):
    return measures.recall_report(staging.view(t.spark, t.dir, _WANTED))


@query(f", w AS ({staging.oracle(_WANTED)}) SELECT entry, coalesce(bool_and(near), false) OR bool_or(near IS NULL) AS fails FROM w GROUP BY 1")
def canary(t):
    return measures.canary(staging.view(t.spark, t.dir, _WANTED)).select("entry", F.coalesce("fails", F.lit(False)).alias("fails"))


@query(" SELECT file_path, sha256(string_agg(content, chr(10) ORDER BY chunk_id)) AS file_hash FROM chunks GROUP BY 1")
def sha256_manifest(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"])
    return t.chunks.groupBy("file_path").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("file_hash"))


_OLD, _NEW = "SELECT doc_id AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 1", "SELECT doc_id AS file_path, sha256(CASE WHEN doc_id % 6 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 9 <> 2"


@query(f" SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'orphan' WHEN o.file_path IS NULL THEN 'new' WHEN n.h <> o.h THEN 'changed' ELSE 'unchanged' END AS outcome FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.file_path = o.file_path")
def incremental_diff(t):
    changed = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = t.documents.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("file_path"), F.sha2("text", 256).alias("file_hash"))
    new = t.documents.where("doc_id % 9 <> 2").select(F.col("doc_id").alias("file_path"), F.sha2(changed, 256).alias("file_hash"))
    return index.compare(old, new)


@query(" SELECT chunk_id, concat('// File: ', file_path, chr(10), '// Type: ', chunk_type, chr(10), CASE WHEN name IS NULL THEN '' ELSE concat('// Name: ', name, chr(10)) END, content) AS enriched FROM chunks")
def enrich_text(t):
    return t.chunks.select("chunk_id", chunking.enriched(F.lit(""), F.lit(None).cast("string")).alias("enriched"))


@query(f", w AS ({staging.oracle(_WANTED)}), r AS (SELECT entry, CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*) AS recall, sum(weight) FILTER (WHERE reachable AND found) / sum(weight) FILTER (WHERE reachable) AS cap_fit FROM w GROUP BY 1) SELECT round(avg(recall), 9) AS recall, round(avg(cap_fit), 9) AS cap_fit, false AS degraded, avg(recall) >= 0.5 AS passes FROM r")
def corpus_means(t):
    report = measures.gate(measures.corpus_report(measures.recall_report(staging.view(t.spark, t.dir, _WANTED))), 0.5)
    return report.select(rounded("recall", "recall", 9), rounded("cap_fit", "cap_fit", 9), "degraded", "passes")


_ENRICHED = "concat('// File: ', c.file_path, chr(10), '// Type: ', c.chunk_type, chr(10), CASE WHEN c.name IS NULL THEN '' ELSE concat('// Name: ', c.name, chr(10)) END, CASE WHEN p.name IS NULL THEN '' ELSE concat('// Parent: ', p.name, chr(10)) END, c.content)"
_WORK = f""", prio AS (SELECT file_path, (SELECT count(*) FROM links WHERE target_file = f.file_path) + CASE WHEN EXISTS (SELECT 1 FROM chunks x WHERE x.file_path = f.file_path AND chunk_type IN ('hook', 'component')) THEN 3 ELSE 0 END AS priority,
 CASE WHEN EXISTS (SELECT 1 FROM chunks x WHERE x.file_path = f.file_path AND chunk_type = 'rust_enum') THEN 1 ELSE 0 END AS hinted FROM (SELECT DISTINCT file_path FROM chunks) f),
work AS (SELECT c.file_path, c.chunk_id, {_ENRICHED} AS txt, hinted, priority FROM chunks c LEFT JOIN chunks p ON p.chunk_id = c.parent_chunk_id JOIN prio ON prio.file_path = c.file_path
 WHERE c.chunk_type <> 'inner_fn' AND c.source_kind IS DISTINCT FROM 'test' AND c.chunk_id NOT IN (SELECT chunk_id FROM vecs))"""


def _work(t):
    return embedding.worklist(t.chunks, t.vecs, t.links, hints=["rust_enum"])


@query(_WORK + " SELECT file_path, chunk_id, sha256(txt) AS txt, hinted, priority FROM work")
def embed_worklist(t):
    return _work(t).select("file_path", "chunk_id", F.sha2("text", 256).alias("txt"), "hinted", "priority")


@query(_WORK + """, files AS (SELECT file_path, count(*) AS n, sum(count(*)) OVER (ORDER BY hinted DESC, priority DESC, file_path) AS upto, row_number() OVER (ORDER BY hinted DESC, priority DESC, file_path) AS i FROM work GROUP BY file_path, hinted, priority)
 SELECT file_path FROM files WHERE i < coalesce((SELECT min(i) FROM files WHERE upto > 25 AND i > 1), 1000000) AND upto - n < 25""")
def embed_budget(t):
    return embedding.budgeted(_work(t), 25).select("file_path").distinct()


class _Vowels:
    """An embedder that SQL can follow: the counts of three vowels, and of the first half's."""

    def embed_query(self, text: str) -> list[float]:
        return [float(text.count(c)) for c in "aei"]

    def embed_documents(self, texts: list[str]) -> list[list[list[float]]]:
        return [[self.embed_query(x), self.embed_query(x[:100])] for x in texts]


@query(_WORK + """ SELECT chunk_id, sub_idx, length(x) - length(replace(x, 'a', '')) AS a, length(x) - length(replace(x, 'e', '')) AS e, length(x) - length(replace(x, 'i', '')) AS i
FROM (SELECT chunk_id, 0 AS sub_idx, txt AS x FROM work UNION ALL SELECT chunk_id, 1, substring(txt, 1, 100) FROM work)""")
def embed_pending(t):
    rows, _ = embedding.embed_pending(_work(t), _Vowels())
    return rows.select("chunk_id", "sub_idx", *[F.get("embedding", F.lit(k)).cast("long").alias(c) for k, c in enumerate("aei")])


@query(" SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY sub_idx) - 1 AS INT) AS sub_idx, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM vecs WHERE chunk_id % 2 = 1")
def sub_embeddings(t):
    rows = t.vecs.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_idx", "embedding"))), lambda x: x["embedding"]).alias("embeddings"))
    new = embedding.sub_embeddings(rows, t.vecs.where("chunk_id % 2 = 0"))
    return new.select("chunk_id", "sub_idx", rounded(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), "total", 5))


_FILES = "(SELECT DISTINCT file_path FROM chunks WHERE starts_with(file_path, 'src/') AND file_path LIKE '%.tsx' AND NOT contains(file_path, '__tests__'))"
_SPECS = f"""(SELECT file_path AS source_file, '../en/' || regexp_extract(file_path, '([^/]+)[.]tsx$', 1) AS source, 'src/en/' || regexp_extract(file_path, '([^/]+)$', 1) AS meant FROM {_FILES}
UNION ALL SELECT file_path, './' || regexp_extract(file_path, '([^/]+)$', 1), file_path FROM {_FILES}
UNION ALL SELECT file_path, '@/de/' || regexp_extract(file_path, '([^/]+)[.]tsx$', 1), 'src/de/' || regexp_extract(file_path, '([^/]+)$', 1) FROM {_FILES}
UNION ALL SELECT file_path, 'react', NULL FROM {_FILES} UNION ALL SELECT file_path, '../../../x', NULL FROM {_FILES})"""


@query(f" SELECT source_file, meant AS target_file, 'f' AS symbol_name, 'named' AS ref_kind FROM {_SPECS} WHERE meant IN (SELECT file_path FROM chunks)")
def resolve_edges(t):
    some = t.chunks.where("file_path LIKE 'src/%.tsx' AND NOT contains(file_path, '__tests__')").select("file_path").distinct()
    name = F.regexp_extract("file_path", "([^/]+)[.]tsx$", 1)
    specs = F.array(F.concat(F.lit("../en/"), name), F.concat(F.lit("./"), name, F.lit(".tsx")), F.concat(F.lit("@/de/"), name), F.lit("react"), F.lit("../../../x"))
    imports = some.select(F.col("file_path").alias("source_file"), F.explode(specs).alias("source")).withColumns({"name": F.lit("f"), "kind": F.lit("named")})
    return chunking.resolve(imports, t.chunks, [("@/", "src/"), ("src/", "src/x/")])


_ON_DISK = "SELECT doc_id AS file_path, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE sha256(CASE WHEN doc_id % 6 = 0 THEN concat(text, '!') ELSE text END) END AS h, CASE WHEN doc_id % 22 = 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'errored' ELSE 'read' END AS scan FROM documents WHERE doc_id % 9 <> 2"
_DECIDED = f"SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'orphan' WHEN scan <> 'read' THEN scan WHEN o.h IS DISTINCT FROM n.h THEN 'process' ELSE 'unchanged' END AS outcome FROM ({{old}}) o FULL JOIN ({_ON_DISK}) n ON n.file_path = o.file_path"


def _scanned(t):
    changed = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    scan = F.when(F.col("doc_id") % 22 == 0, "skipped").when(F.col("doc_id") % 11 == 0, "errored").otherwise("read")
    rows = t.documents.where("doc_id % 9 <> 2").select(F.col("doc_id").alias("file_path"), scan.alias("outcome"), F.sha2(changed, 256).alias("h"))
    old = t.documents.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("file_path"), F.sha2("text", 256).alias("file_hash"))
    return old, rows.select("file_path", "outcome", F.when(F.col("outcome") == "read", F.col("h")).alias("file_hash"))


@query(" " + _DECIDED.format(old="SELECT doc_id AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 1"))
def index_decide(t):
    return index.decide(*_scanned(t))


@query(f" SELECT count(*) FILTER (WHERE outcome = 'process') AS files_to_process, count(*) FILTER (WHERE outcome IN ('unchanged', 'skipped')) AS files_to_skip, count(*) FILTER (WHERE outcome <> 'orphan') AS total_files, count(*) FILTER (WHERE outcome = 'errored') AS files_errored, count(*) FILTER (WHERE outcome = 'orphan') AS orphans_to_remove FROM ({_DECIDED.format(old='SELECT doc_id AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 1')})")
def index_dry_run(t):
    told = index.dry_run(*_scanned(t))
    return t.spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


_WINDOWS = """, d AS (SELECT concat(doc_id, '.txt') AS file_path, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS lines FROM documents WHERE text <> ''),
sums AS (SELECT *, len(lines) AS n, list_transform(range(0, len(lines) + 1), lambda i: coalesce(list_sum(list_transform(lines[1:i], lambda x: strlen(x) + 1)), 0)) AS upto FROM d),
win AS (SELECT file_path, CAST(0 AS BIGINT) AS s FROM d UNION ALL SELECT file_path, greatest(e - 4, s + 1) FROM (SELECT w.file_path, s, n, coalesce(list_min(list_filter(range(s + 1, n + 1), lambda i: upto[i + 1] - upto[s + 1] >= 1000)), n) AS e FROM win w JOIN sums USING (file_path)) WHERE e < n),
ends AS (SELECT file_path, s, coalesce(list_min(list_filter(range(s + 1, n + 1), lambda i: upto[i + 1] - upto[s + 1] >= 1000)), n) AS e, lines FROM win JOIN sums USING (file_path)),
windows AS (SELECT file_path, s, e, row_number() OVER (PARTITION BY file_path ORDER BY s) - 1 AS ordinal, array_to_string(lines[s + 1:e], chr(10)) AS content FROM ends WHERE regexp_matches(array_to_string(lines[s + 1:e], chr(10)), '\\S'))"""


@query(_WINDOWS + " SELECT file_path, CAST(ordinal AS INT) AS ordinal, 'other' AS chunk_type, CAST(s + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line FROM windows")
def chunk_fallback(t):
    return chunking.chunk_files(t.documents.select(F.concat("doc_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))).select("file_path", "ordinal", "chunk_type", "start_line", "end_line")


@query(_WINDOWS + " SELECT file_path, sha256(content) AS content, CAST(len(list_filter(['thing', '%%%'], lambda p: contains(content, p))) AS INT) AS n_flags, 'src' AS source_kind FROM windows")
def index_full(t):
    """What an index run writes for documents as files: chunks with their flags and kind."""
    files = t.documents.select(F.concat("doc_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("content")).withColumns({"file_hash": F.sha2("content", 256), "source_kind": paths.source_kind(F.col("file_path")), "mtime_epoch": F.lit(0).cast("long")})
    chunks, _ = index.prepared(files, chunking.parsed(files), [PATTERNS[0], PATTERNS[2]])
    return chunks.select("file_path", F.sha2("content", 256).alias("content"), F.size("injection_flags").alias("n_flags"), "source_kind")


@query(r"""
, lines AS (SELECT doc_id, i, regexp_replace(l, '^([A-Za-z0-9_]+)', '# \1') AS l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END AS t FROM documents WHERE text <> ''))),
marked AS (SELECT *, regexp_matches(l, '^ {0,3}#{1,6}([ \t]+.*)?$') AS head FROM lines),
grouped AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
sections AS (SELECT doc_id, g, min(i) AS s, max(i) AS e, first(l ORDER BY i) AS title, string_agg(l, chr(10) ORDER BY i) AS content FROM grouped GROUP BY 1, 2)
SELECT concat(doc_id, '.md') AS file_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS ordinal, CASE WHEN g = 0 THEN 'other' ELSE 'md_section' END AS chunk_type,
 CASE WHEN g > 0 THEN nullif(trim(regexp_replace(trim(regexp_replace(title, '^ *#+', '')), '(^|[ \t]+)#+[ \t]*$', '')), '') END AS name, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM sections WHERE regexp_matches(content, '\S')""")
def chunk_markdown(t):
    marked = F.regexp_replace("text", r"(?m)^(\w+)", "# $1")
    return chunking.chunk_files(t.documents.select(F.concat("doc_id", F.lit(".md")).alias("file_path"), marked.alias("content"))).select("file_path", "ordinal", "chunk_type", "name", "start_line", "end_line")


@query(None)
def chunk_html(t):
    return chunking.chunk_files(t.pages.select(F.concat("page_id", F.lit(".html")).alias("file_path"), F.col("html").alias("content"))).select("file_path", "ordinal", "chunk_type", "start_line", "end_line")


@query(f" SELECT chunk_id, CASE WHEN name IS NOT NULL THEN {PARTS.format('name')} END AS parts FROM chunks")
def split_identifiers(t):
    return t.chunks.select("chunk_id", F.array_join(text.split_identifier(F.col("name")), " ").alias("parts"))
