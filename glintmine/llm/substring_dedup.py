"""Exact substring dedup with fixed-block anchors.

Blocks: each document is cut into non-overlapping blocks of ``width // 2`` words, which are indexed by hash
with the smallest id that has them. Any window of ``width`` words holds at least one whole block of its
first document, so the windows that a later document shares with it are found by probing the index with
every rolling window of a block's size. Hits are extended to maximal exact repeats: each ``width``-word
window over an anchor is compared with the smallest id that has the same window; what stays covered is the
union of the confirmed windows.

Exact copies of a word sequence are one text here: a later copy is covered altogether, and a block that only
copies of one sequence have is no anchor.

Edge cases: null and empty texts have no words and keep nothing (the hash of an empty string). Documents of
fewer than ``width`` words keep all. Rows that repeat an id are judged one by one, against smaller ids only;
rows with a null id are never smaller than any, nor have smaller ones. Extra columns are ignored. Word
sequences are compared by 64-bit hashes of runs of word hashes. Texts of any length are read whole. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, batches_of, bit_filter, materialize, per_row, signed, small_batches, window_hashes, word_hashes

EMPTY = hashlib.sha256(b"").hexdigest()


def _identity(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _chunks(schema: pa.Schema, columns: list[np.ndarray], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield batches_of(schema, *(c[i : i + size] for c in columns))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, in the contract's terms."""
    marked = removed(docs, doc_id, text, width)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_removed, sums = [], [], []
            for t, gone, whole in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = ascii_words(t)
                keep = kept(words, gone, width, whole)
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                sums.append(hashlib.sha256(b" ".join(keep)).hexdigest() if keep else EMPTY)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

        return step

    return marked.mapInArrow(per_row(work), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, text) of every row: the kept words, joined by one space."""
    marked = removed(docs, doc_id, text, width)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(kept(ascii_words(t), g, width, w)).decode("utf-8", "surrogatepass") for t, g, w in rows], pa.string())], names=["doc_id", "text"])

        return step

    return marked.mapInArrow(per_row(work), f"doc_id {kind}, text string")


def kept(words: list[bytes], starts: bytes | None, width: int, whole: bool) -> list[bytes]:
    """``words`` without those that the windows starting at ``starts`` (int32) cover."""
    if whole and len(words) >= width:
        return []
    if not starts:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.frombuffer(starts, np.int32))
    change[at] += 1
    change[at + width] -= 1
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered, strict=True) if not c]


def removed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, text, starts, copy): ``starts``, int32 bytes, of the windows that occur in a document with a
    smaller id; ``copy``: the whole word sequence is that of a smaller id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    half = width // 2

    # 1. Word sequences that more rows than one have, and the smallest id of each.
    id_schema = pa.schema([("seq", pa.int64()), ("doc_id", pa.int64())])

    def sequences(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(seq, i) for i, _, seq in _rows(batch, width)]
        return batches_of(id_schema, *zip(*found, strict=True)) if found else pa.RecordBatch.from_pylist([], id_schema)

    firsts = known.mapInArrow(per_row(lambda: sequences), "seq long, doc_id long").groupBy("seq").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = firsts.where("last > first").select("seq", "first")

    # 2. Blocks, by hash, with the least and greatest sequence that has them.
    block_schema = pa.schema([("h", pa.int64()), ("seq", pa.int64())])
    extremes = [F.min("seq").alias("least"), F.max("seq").alias("most")]

    def blocks(batches):
        for batch in batches:
            hs, ids = [], []
            for _, words, seq in _rows(batch, width):
                h = window_hashes(word_hashes(words), half)[::half]
                hs.append(signed(h))
                ids.append(np.full(len(h), seq))
            if hs:
                yield from _chunks(block_schema, [np.concatenate(hs), np.concatenate(ids)])

    index = materialize(known.mapInArrow(blocks, "h long, seq long").groupBy("h").agg(*extremes), "blocks")

    # 3. Probes: every rolling window of a block's size, but for a text's own blocks and what surely no
    #    index entry matches. An anchor is a block that two different sequences have.
    in_index = bit_filter(index, "h", marks=3)

    def probes(batches):
        maybe = in_index.value.maybe
        for batch in batches:
            hs, ids = [], []
            for _, words, seq in _rows(batch, width):
                h = window_hashes(word_hashes(words), half)
                own = np.zeros(len(h), bool)
                own[::half] = True
                h = np.unique(h[maybe(h) & ~own])
                hs.append(signed(h))
                ids.append(np.full(len(h), seq))
            if hs:
                yield from _chunks(block_schema, [np.concatenate(hs), np.concatenate(ids)])

    probed = known.mapInArrow(probes, "h long, seq long").groupBy("h").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    anchors = index.join(probed, "h", "left").where("least != most or low != least or high != least").select("h")
    anchored = bit_filter(anchors, "h", marks=3)

    # 4. Extension: the windows over one of a text's own blocks that is an anchor (any window that another
    #    text shares is one), in every text that has such; the smallest id of those that two ids have.
    place_schema = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("at", pa.int32())])

    def windows(batches):
        maybe = anchored.value.maybe
        for batch in batches:
            parts = []
            for i, words, seq in _rows(batch, width):
                base = word_hashes(words)
                own = np.arange(0, len(base) - half + 1, half)
                found = own[maybe(window_hashes(base, half)[own])]
                if len(found):
                    change = np.zeros(len(base) + 1, np.int64)
                    np.add.at(change, np.maximum(0, found + half - width), 1)
                    np.add.at(change, found + 1, -1)
                    at = np.flatnonzero(np.cumsum(change)[: len(base) - width + 1] > 0)
                    parts.append((signed(window_hashes(base, width)[at]), np.full(len(at), i), np.full(len(at), seq), at.astype(np.int32)))
            if parts:
                yield from _chunks(place_schema, [np.concatenate(x) for x in zip(*parts, strict=True)])

    places = materialize(known.mapInArrow(windows, "w long, doc_id long, seq long, at int"), "places")
    held = places.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = materialize(held.where("last > first").select("w", "first"), "shared")
    in_shared = bit_filter(shared, "w", marks=3)

    def maybe_shared():
        return lambda batch: batch.filter(pa.array(in_shared.value.maybe(batch.column(0).to_numpy().view(np.uint64))))

    placed = places.mapInArrow(per_row(maybe_shared), places.schema).join(shared, "w").where("doc_id > first")
    packed = pack_starts(placed.select("seq", "doc_id", "at"))

    # 5. Back to the texts, by word sequence; texts that surely lose nothing take no part in the join. A text that
    #    a third of all rows copy makes a skewed partition of this join, which Spark splits.
    #    Larger ids of a sequence are covered altogether, so only its smallest id's windows matter.
    both = packed.withColumnRenamed("doc_id", "of").join(copies, "seq", "full_outer")
    facts = both.groupBy("seq").agg(F.max("first").alias("first"), F.max(F.when(F.coalesce(F.col("of") == F.col("first"), F.lit(True)), F.col("starts"))).alias("starts"))
    facts = materialize(facts, "repeats")
    losing = bit_filter(facts, "seq", marks=3)

    def split(wanted: bool):
        def work():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                seqs = np.fromiter((_identity(ascii_words(t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
                known = np.asarray(batch.column(0).is_valid())
                maybe = losing.value.maybe(seqs.view(np.uint64)) & known
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs)], names=["doc_id", "text", "seq"]).filter(pa.array(maybe == wanted))

            return step

        return rows.mapInArrow(per_row(work), f"doc_id {kind}, text string, seq long")

    joined = split(True).join(facts, "seq", "left").select("doc_id", "text", "starts", F.coalesce(F.col("doc_id").cast("long") > F.col("first"), F.lit(False)).alias("copy"))
    clean = split(False).select("doc_id", "text", F.lit(None).cast("binary").alias("starts"), F.lit(False).alias("copy"))
    return joined.unionByName(clean)


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(id, words, hash of the word sequence) of the texts that are long enough to hold a window."""
    for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        words = ascii_words(text)
        if len(words) >= width:
            yield i, words, _identity(words)


def pack_starts(starts: DataFrame) -> DataFrame:
    """(seq, doc_id, starts): the places of each text as int32 bytes; a text bounds how many there are."""
    packed = starts.groupBy("seq", "doc_id").agg(F.collect_set("at").alias("ats"))

    def work():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.asarray(x, np.int32).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["seq", "doc_id", "starts"])

    return packed.mapInArrow(per_row(work), "seq long, doc_id long, starts binary")
