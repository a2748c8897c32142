"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``width`` consecutive words of an item is a pattern; a shorter item is one pattern. Patterns
of one length are searched together: a block of two words gives a shift from a table, which skips
positions where no pattern can end; a block with shift 0 leads to a bucket of patterns that end in it, and
direct comparison confirms each occurrence.

Edge cases: null and empty texts have no words; items without words have no windows. The windows of an item
with a null id hit words like any other, but the item can't be named, so it is not among the items found. Items
that repeat an id are one item; repeated document rows are judged one by one. Texts of any length are read
whole. An empty benchmark finds nothing, and an empty table gives no rows. Extra columns are ignored by
``find_contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words: runs of digits, a-z and all beyond ASCII, after A-Z are lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so bytes split as characters do."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


class WuManber:
    """Patterns of one length m. shift: by block of the last words of a window, the least distance from the
    block's places in any pattern to the pattern's end; bucket: by the hash of that block, the patterns that
    end in it, as (pattern, items)."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], tuple[int, ...]]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.bucket.setdefault(pattern[-self.block :], {}).setdefault(pattern, set()).update(items)

    def occurrences(self, words: list[bytes]):
        """(start, items) of each place where a pattern occurs."""
        m, n, shift, default = self.m, len(words), self.shift.get, self.default
        end = m
        if self.block == 1:
            for i, w in enumerate(words):
                if (found := self.bucket.get((w,))) is not None:
                    yield i, found[(w,)]
            return
        while end <= n:
            skip = shift((words[end - 2], words[end - 1]), default)
            if skip:
                end += skip
                continue
            window = tuple(words[end - m : end])
            if (items := self.bucket[window[-2:]].get(window)) is not None:
                yield end - m, items
            end += 1


class Search:
    """Automata for all pattern lengths of a block of items; items without a name have patterns, but no number."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        known: dict[str, int] = {}
        for name, text in items:
            numbers = () if name is None else (known.setdefault(name, len(known)),)
            for w in windows(words_of(text), width):
                by_length.setdefault(len(w), {}).setdefault(w, set()).update(numbers)
        self.names = list(known)
        self.machines = [WuManber(m, found) for m, found in sorted(by_length.items())]

    def __call__(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Marks hit words; the names of the items that occur."""
        found: set[int] = set()
        for machine in self.machines:
            for start, items in machine.occurrences(words):
                hit[start : start + machine.m] = True
                found |= items
        return {self.names[i] for i in found}


def blocks(benchmark: DataFrame, item_id: str, text: str, most_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most ``most_chars`` characters (a longer item is a block of its own), one at a time:
    that bounds what the driver holds and what is broadcast at once."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    block: list[tuple[str | None, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > most_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def _searched(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, width: int, most_chars: int, at: int, finish: Callable, held_bytes: int = 64 << 20):
    """A mapInArrow function that runs the blocks over all rows and lets ``finish`` (batch, [(words, hit words,
    names)]) make each batch. With one block, batches go one by one; with more, a task holds rows of about
    ``held_bytes`` of text while the blocks pass over them, so a block's automata are built once for as many."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in blocks(benchmark, item_id, item_text, most_chars)]

    def search(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [words_of(t) for batch in batches for t in batch.column(at).to_pylist()]
        hits = [np.zeros(len(w), bool) for w in words]
        items: list[set[str]] = [set() for _ in words]
        for one in sent:
            machine = _machine(one, width, len(sent) == 1)
            for w, h, x in zip(words, hits, items, strict=True):
                if w:
                    x |= machine(w, h)
        found = iter([(len(w), int(h.sum()), x) for w, h, x in zip(words, hits, items, strict=True)])
        for batch in batches:
            yield finish(batch, list(islice(found, batch.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(at).nbytes
            if len(sent) == 1 or size > held_bytes:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    return run


_machines: dict = {}


def _machine(sent, width: int, keep: bool) -> Search:
    if not keep:
        return Search(sent.value, width)
    key = (id(sent.value), width)
    if key not in _machines:  # the value is kept too, so its id stays its own
        _machines.clear()
        _machines[key] = (sent.value, Search(sent.value, width))
    return _machines[key][1]


def digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, most_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row. ``most_chars``
    bounds a broadcast block of the benchmark."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]

    def finish(batch: pa.RecordBatch, got: list) -> pa.RecordBatch:
        found = [sorted(x) for _, _, x in got]
        columns = [
            batch.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([h for _, h, _ in got], pa.int64()), pa.array([len(x) for x in found], pa.int64()),
            pa.array([digest(x) for _, _, x in got], pa.string()), pa.array([h > 0 for _, h, _ in got], pa.bool_()), pa.array(found, pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    run = _searched(chosen, benchmark, item_id, item_text, width, most_chars, 1, finish)
    return chosen.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, most_chars: int = 20_000_000) -> DataFrame:
    """The rows, unchanged, in which no pattern occurs."""

    def finish(batch: pa.RecordBatch, got: list) -> pa.RecordBatch:
        return batch.filter(pa.array([h == 0 for _, h, _ in got], pa.bool_()))

    return docs.mapInArrow(_searched(docs, benchmark, item_id, item_text, width, most_chars, docs.columns.index(text), finish), docs.schema)
