"""Shared plumbing: bounded bit filters, byte-exact word splitting, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few_files, materialize, reachable  # noqa: F401 (operators take few_files and materialize from here)

#: ``[^\x20\x09-\x0D]+``: the word rule that most contracts share (for Java's regular expressions).
SPACES = r"[\x20\x09-\x0D]+"
#: Fixed size of the bit filters that are broadcast: 2**26 bits are 8 MB, whatever the input.
FILTER_BITS = 26
_MIX = np.uint64(0x9E3779B97F4A7C15)

def small_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker, by rows and, since a text can be of
    any length, by bytes; let workers import this package. Plans read these settings when they run, so they stay
    set in the session; smaller ones that a user has chosen are kept."""
    reachable(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        now = int(now) if now and now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def ascii_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() splits at exactly these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    """As ``ascii_words``, A-Z lower-cased: bytes.lower() touches nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes (none if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, span = words.copy(), 1
    # doubling: a window of 2k words is made from two windows of k; an odd rest is added at the end
    parts: list[tuple[int, np.ndarray]] = []
    left = width
    while True:
        if left & 1:
            parts.append((span, out))
        left >>= 1
        if not left:
            break
        out = _join(out[:-span], out[span:])
        span *= 2
    size, whole = parts[-1]
    for extra, piece in reversed(parts[:-1]):
        length = len(words) - size - extra + 1
        whole = _join(whole[:length], piece[size : size + length])
        size += extra
    return whole[:n]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence (a, b) for arrays of hashes; not symmetric."""
    x = (a ^ (a >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) + (b ^ (b >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def batches_of(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: A bit filter is built in blocks of 2**16 bits; an entry's bits all lie in one block.
BLOCK_BITS = 16


class BitFilter:
    """A bit set of fixed size of 64-bit hashes, ``marks`` bits for each, for dropping rows that surely have no
    partner before a shuffle. It answers "maybe" or "no": results never depend on it. With more entries than
    it can tell apart it only drops fewer rows."""

    def __init__(self, bits: np.ndarray, size_bits: int = FILTER_BITS, marks: int = 1):
        self.bits, self.size_bits, self.marks = bits, size_bits, marks

    def __contains__(self, value: int) -> bool:
        return bool(self.maybe(np.array([value], dtype=np.uint64))[0])

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        block = hashes >> np.uint64(64 - self.size_bits + BLOCK_BITS) << np.uint64(BLOCK_BITS)
        found, left = np.ones(len(hashes), bool), np.arange(len(hashes))
        for k in range(self.marks):
            at = block[left] | hashes[left] >> np.uint64(64 - self.size_bits - k * BLOCK_BITS) & np.uint64((1 << BLOCK_BITS) - 1)
            hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found[left[~hit]] = False
            left = left[hit]
        return found


def bit_filter(df: DataFrame, column: str, size_bits: int = FILTER_BITS, marks: int = 1):
    """Broadcast ``BitFilter`` of a bigint column of well-mixed hashes, built by blocks on the executors:
    the driver gets at most 2**size_bits bits, however many rows there are, in one job."""
    size = 1 << (BLOCK_BITS - 3)
    block = F.shiftrightunsigned(F.col(column), 64 - size_bits + BLOCK_BITS).cast("int")
    ats = [F.shiftrightunsigned(F.col(column), 64 - size_bits - k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias(f"at{k}") for k in range(marks)]
    places = df.select(block.alias("block"), *ats).distinct()

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << BLOCK_BITS, np.uint8)
        for k in range(marks):
            flags[frame[f"at{k}"].to_numpy()] = 1
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    bits = np.zeros(1 << (size_bits - 3), np.uint8)
    for row in places.groupBy("block").applyInPandas(packed, "block int, bits binary").collect():
        bits[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(BitFilter(bits, size_bits, marks))


def remainder(column: str, by: int) -> Column:
    """crc32 of an id written as text, modulo ``by``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def per_row(work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from ``work``, which sets up once a task and returns a batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or work()
                yield step(batch)

    return run


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, such as a model and its cache. It keeps one such thing: workers
    outlive the stages of a pipeline, and would hold those of all stages at once."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what ``held`` keeps, and give the memory back."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism_off() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
