"""Best-fit packing by length-histogram planning.

The plan is made over counts, not documents: a histogram of piece lengths (at most ``capacity`` entries)
is packed best-fit, longest first, and gives runs of planned slots for each length. Documents then take
slots by joining on their rank within their length, which is found in salted groups, so that a length
that a third of all pieces share is dealt over many tasks.

Edge cases: null text is an empty one, of one token (the closing id). Repeated rows are packed as often as
they occur. Null ids are kept. An empty table gives no rows. Extra columns are ignored, whatever they are called.
Only documents of more than ``capacity`` tokens are cut, whatever their length; the remainder is their first
piece. Pieces of one length are ranked by id, piece and content, so which of two equal rows takes which slot is
open, and doesn't matter.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, few_files, held, materialize, parallelism_off, per_row, small_batches

#: A single space between characters that no tokenizer takes for white space: text may be cut here, since
#: the tokenizer's own pattern starts a new piece at each such space.
CUT = re.compile("(?<=[^\\s\\x1c-\\x1f\u180e\u200b-\u200d\ufeff]) (?=[^\\s\\x1c-\\x1f\u180e\u200b-\u200d\ufeff])")
#: Texts (for Arrow's regular expressions) that only CUT can cut: white space in a row, or of a rarer kind.
ODD = r"[\s\x0b]{2}|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes. Each different space-delimited stretch is encoded
    once; what it gave is kept in a cache of bounded size. ``tokenizers`` sets what the ids are: it reads the
    file and encodes texts with special tokens, and all stretches for which ``quick_encoder`` doesn't vouch."""

    def __init__(self, path: str, most: int = 300_000):
        parallelism_off()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.first, self.rest, self.older = most, {}, {}, {}
        self.quick, self.sure = quick_encoder(self.tokenizer, path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stretches(self, texts: list[str]) -> list[bytes]:
        if self.quick is None:
            return self.whole(texts)
        out, sure, quick = [b""] * len(texts), self.sure.fullmatch, self.quick
        others = []
        for k, text in enumerate(texts):
            if sure(text):
                out[k] = array("I", quick(text)).tobytes()
            else:
                others.append(k)
        for k, ids in zip(others, self.whole([texts[k] for k in others]), strict=True):
            out[k] = ids
        return out

    def known(self, found: dict[str, bytes], texts: list[str], lead: str) -> list[bytes]:
        """Ids of different stretches, each after ``lead``, from the cache ``found`` or encoded now."""
        lacking = [x for x in texts if x not in found]
        if found is self.rest:
            found.update((x, self.older[x]) for x in lacking if x in self.older)
            lacking = [x for x in lacking if x not in found]
        for i in range(0, len(lacking), 4096):
            some = lacking[i : i + 4096]
            found.update(zip(some, self.stretches([lead + x for x in some]), strict=True))
        return list(map(found.__getitem__, texts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) > self.most:  # what is still in use comes back from the older generation
            self.first, self.rest, self.older = {}, {}, self.rest
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        whole = np.array([any(s in t for s in self.special) for t in texts], bool)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(np.flatnonzero(whole).tolist(), self.whole([t for t, w in zip(texts, whole, strict=True) if w]), strict=True):
            out[k] = ids
        plain = np.flatnonzero(~whole)
        if not len(plain):
            return out
        cut_up = pc.split_pattern(column.take(pa.array(plain)), " ")
        if odd[plain].any():
            cut_up = pa.array([CUT.split(texts[k]) if odd[k] else x for k, x in zip(plain.tolist(), cut_up.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
        # the batch's different stretches, and each text's first, which no space precedes
        coded = cut_up.flatten().dictionary_encode()
        bounds = np.asarray(cut_up.offsets) - int(cut_up.offsets[0].as_py())
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        heads = [different[k] for k in at[bounds[:-1]].tolist()]
        at[bounds[:-1]] = len(different) + np.arange(len(plain))
        entries = self.known(self.rest, different, " ") + self.heads(heads)
        of, at, bounds = entries.__getitem__, at.tolist(), bounds.tolist()
        for k, start, stop in zip(plain.tolist(), bounds, bounds[1:], strict=False):
            out[k] = b"".join(map(of, at[start:stop]))
        return out

    def heads(self, texts: list[str]) -> list[bytes]:
        self.known(self.first, list(dict.fromkeys(texts)), "")
        return list(map(self.first.__getitem__, texts))


#: Characters that a quick encoder is asked about: Latin, Greek, Cyrillic, and typographic signs.
ASKED = ["\t", "\n", "\r", *map(chr, range(0x21, 0x500)), *map(chr, range(0x2010, 0x2028)), *map(chr, range(0x2030, 0x205F)), *map(chr, range(0x20A0, 0x20C0))]


def quick_encoder(tokenizer, path: str):
    """(the byte-pair vocabulary of a byte-level tokenizer file as a ``tiktoken`` function of short strings, a pattern
    of the strings for which it gives the ids of ``tokenizers``), or nothing if the file is of another kind.

    Why the ids are equal: ``tokenizers`` merges the pair of the earliest rule, ``tiktoken`` the pair that makes the
    token of the least id. Here ids follow the order of rules, and each rule makes another token. What stands
    within a pair's bounds when it is merged has been merged as the pair's text alone would be, so the pair is
    the one that the text alone ends with. Tokens that ``tokenizers`` doesn't make of their own text are made
    nowhere, and are left out; of all others the last pair is that of their only rule: both merge the same.
    The two cut strings into pieces by the same pattern, but have tables of letters and digits of their own,
    so only characters are sure that both cut alike after a letter, a digit, a sign and a space."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    plain, model = told.get("pre_tokenizer") or {}, told["model"]
    shaped = model.get("type") == "BPE" and plain.get("type") == "ByteLevel" and not plain.get("add_prefix_space") and plain.get("use_regex", True)
    if not shaped or told.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None, None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(x, -1) for x in merged]
    if ids != sorted(set(ids)) or -1 in ids:
        return None, None
    # the printable stand-ins of a byte-level vocabulary: bytes that print stand for themselves
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in told.get("added_tokens", [])}
    made = tokenizer.model.tokenize
    ranks = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in special and (len(token) == 1 or [t.id for t in made(token)] == [k])}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None, None
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    quick = tiktoken.Encoding("stretches", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # a vocabulary of the probes: a probe that isn't cut is one token
    probes = {c: [x + c for x in "a1. "] for c in ASKED}
    known = {x.encode(): 256 + k for k, x in enumerate(x for some in probes.values() for x in some)}
    cuts = tiktoken.Encoding("cuts", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | known, special_tokens={}).encode_ordinary
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str
    alike = [c for c, some in probes.items() if all((len(cuts(x)) == 1) == (len(pieces(x)) == 1) for x in some)]
    return quick, re.compile("[ " + re.escape("".join(alike)) + "]*")


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: Callable[[], str], capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's pieces. ``tokenizer`` gives the path of the
    vocabulary file where it is called: on each executor."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    closing = np.asarray([end_id], "<u4").tobytes()

    def work():
        encode = encoder(tokenizer())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            at, number, starts, lengths, crcs = [], [], [], [], []
            for i, ids in enumerate(encode(texts)):
                ids += closing
                view = memoryview(ids)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    number.append(k)
                    starts.append(s)
                    lengths.append(n)
                    crcs.append(zlib.crc32(view[4 * s : 4 * (s + n)]))
            owner = batch.column(0).take(pa.array(at, pa.int32()))
            schema = pa.schema([("doc_id", owner.type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            return batches_of(schema, owner, number, starts, lengths, crcs)

        return step

    return chosen.mapInArrow(per_row(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit over counts, longest first: runs (length, first rank, first sequence, slots in each sequence,
    offset of the first slot), sorted, and the number of sequences. A run's slots go to consecutive
    sequences. Equal sequences stay together as one group, so the work and the plan depend on the number
    of different lengths, never on the number of documents."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: groups (first sequence, sequences)
    free: list[int] = []  # the keys of room, sorted
    runs, used = [], 0

    def leave(left: int, first: int, many: int) -> None:
        if not many:
            return
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append((first, many))

    for length in sorted(histogram, reverse=True):
        count, rank = int(histogram[length]), 0
        while count:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
            else:
                left, first = capacity, used
                many = -(-count // (capacity // length))
                used += many
            each = left // length
            full, some = min(many, count // each), 0
            if full:
                runs.append((length, rank, first, each, capacity - left))
                rank, count = rank + full * each, count - full * each
                leave(left - each * length, first, full)
            if full < many and count:  # one more sequence takes the few that are left
                some = count
                runs.append((length, rank, first + full, each, capacity - left))
                rank, count = rank + some, 0
                leave(left - some * length, first + full, 1)
            rest = many - full - bool(some)
            leave(left, first + full + bool(some), rest)
    return np.asarray(sorted(runs), np.int64).reshape(-1, 5), used


def pack(cuts: DataFrame, capacity: int, group_rows: int = 5000) -> DataFrame:
    """``cuts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = cuts.sparkSession
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=0) // group_rows))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))
    sent = spark.sparkContext.broadcast(runs)  # a few rows for each different length
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def work():
        runs = sent.value
        keys = (runs[:, 0] << 44) + runs[:, 1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            k = rank - run[:, 1]
            kept = [batch.column(i) for i in range(5)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

        return step

    return few_files(ranked.mapInArrow(per_row(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: Callable[[], str], capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut and pack all rows: (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Texts are
    encoded once; the small table of pieces is written, since it is read for the plan and for the ranks."""
    return pack(materialize(pieces(docs, doc_id, text, tokenizer, capacity, end_id), "pieces"), capacity)
