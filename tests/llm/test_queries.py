"""The contract queries on the smallest given tables, against brute force, exact round trips or accuracy."""

import zlib

import numpy as np
import pytest

from glintmine.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_language(spark):
    found = q.op1_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert len(found) == 200 and found.score.between(0, 1).all()
    assert (found.held_out == [brute.crc(i) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.9


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    found = q.op2_packing(spark, SF).toPandas()
    used = {}
    for d, group in found.groupby("doc_id"):
        group = group.sort_values("piece")
        assert group.piece.tolist() == list(range(len(group)))
        assert group.start.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() == len(ids[d])
        if len(group) > 1:
            assert len(ids[d]) > 2048 and (group.length.iloc[1:] == 2048).all()
        for r in group.itertuples():
            assert zlib.crc32(np.asarray(ids[d][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found.doc_id) == set(ids)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-found.length.sum() // 2048)
    assert len(used) <= least * 1.03 + 1


def test_secrets(spark, docs):
    found = {r["doc_id"]: r for r in q.op3_secret_scan(spark, SF).collect()}
    for d, text in docs:
        counts, base = brute.secret_base(text)
        r = found[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert r["base_sha256"] == brute.sha(base)
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base.split(",") if base else []) <= set(spans)
        assert ",".join(x for x in spans if not x.startswith("markov")) == base


def test_quality(spark, docs):
    found = rows(q.op4_quality_rules(spark, SF), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted((d, *brute.quality(t)) for d, t in docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(q.op4_quality_rules(spark, SF).toPandas(), on="doc_id")
    good = labels[(labels.quality == 1) & ~labels.base_failed]
    assert good.kept.mean() > 0.97


def test_html(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in q.op5_html_text(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_urls(spark):
    def rule_of(host, path):
        best = None
        for x in q.URL_RULES:
            name, _, rest = x.where.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(x.where) > len(best.where)):
                best = x
        return best

    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = q.op6_url_filter(spark, SF).collect()
    assert {r["page_id"] for r in found} == set(pages)
    for r in found:
        rest = pages[r["page_id"]].partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        assert (r["host"], r["path"]) == (host.lower(), slash + path)
        best = rule_of(r["host"], r["path"])
        assert r["rule"] == (best.where if best else None) and r["verdict"] in ("allow", "block")
        if best:
            assert r["verdict"] == ("allow" if best.allow else "block")


def test_urls_held_out(spark):
    """The models alone on URLs that rules decide and that they were not fitted on."""
    from pyspark.sql import functions as F

    from glintmine.llm import url_filter as u

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = u.host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"), u.reading(F.col("url")).alias("text"), F.pmod(F.xxhash64("url"), F.lit(5)).alias("fold"))
    rows = rows.withColumn("allows", u.decided(q.URL_RULES, F.col("host"), F.col("path"))[1]).where("allows is not null").cache()
    model = u.as_array(u.gram_table(rows.where("fold > 1").select("text", "allows")))
    threshold = u.calibrated(u.scored(rows.where("fold = 1"), model).select("allows", "score"))
    held = u.scored(rows.where("fold = 0"), model).select("allows", (F.col("score") >= threshold).alias("found")).toPandas()
    shares = {k: (x.found == k).mean() for k, x in held.groupby("allows")}
    print("held-out URLs", len(held), shares)
    assert len(held) > 100 and min(shares.values()) > 0.9


def test_contamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows(q.op7_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted(brute.contamination(docs, items)) and any(r[2] for r in found)


def test_near_duplicates(spark, docs):
    found = rows(q.op8_ngram_join(spark, SF), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute.near(docs, 4, 85)) and any(a != c for a, _, c in found)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    found = q.op9_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id", how="left")
    assert len(found) == 1000 and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    held = found[found.held_out & found.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.93


def test_substrings(spark, docs):
    found = rows(q.op10_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(brute.dedup(docs)) and any(r[2] for r in found)
