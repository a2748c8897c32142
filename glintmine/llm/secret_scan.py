"""Secret scans: base patterns plus character Markov models of random strings and ordinary identifiers.

Both models are trained from labelled strings: random strings drawn from a seeded generator, and
identifiers and numbers composed from the corpus's own words, of which every different one is used, for the model and
for each threshold. Words are dealt by hash into groups that are composed apart, so nothing depends on
partitions and the driver gets counts of fixed size. A token of ``LEAST`` or more characters is a
secret when its log-likelihood ratio, for each character, passes the threshold of its length, calibrated on
other identifiers. A token that base patterns cover only in part is scored as a whole, and if that does not
pass, so are its parts that nothing covers: no rest of a secret stays beside a base span. Shorter tokens are
left to the base patterns, since so few characters don't tell a secret from a word.

Positions are code points, ends exclusive. Null and empty texts have no spans, empty tables give no rows, and
texts and tokens of any length are read whole. Rows are judged one by one, so repeated rows and ids give
repeated results; extra columns are ignored by ``scan`` and kept by ``redact``. Spans that start together
stand in the order of their kinds. A corpus without words is trained on the fixed words alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, materialize, per_row, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of 24 or more: the runs of [0-9a-f]+ that pass.
HEX = re.compile(r"[0-9a-f]{24,}")
#: The shortest tokens that are scored, and where the classes of lengths begin that have thresholds of their own.
LEAST, CLASSES = 12, (12, 14, 16, 20, 28)
#: Whole runs of the alphabet that secrets are written in.
LONG = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SIDE = len(ALPHABET) + 1
#: Words of a group, about; scores are counted by steps of 1 / STEPS.
GROUP, STEPS = 10_000, 4096
#: All bytes but the alphabet's become spaces.
_APART = bytes(c if chr(c) in ALPHABET else 32 for c in range(256))

#: Words of ordinary identifiers, beside the corpus's own.
COMMON = (
    "access account action address alias allocation application argument array attribute authentication background balance binary boundary buffer builder button calculate callback category channel character "
    "children client collection column command comment compile component configuration connection constant constructor container content context control controller conversion coordinate counter create "
    "current custom database default define delete dependency description destination detail development device dictionary direction directory display distance document download dynamic element enable "
    "encoding environment error evaluate event example exception execute expression extension feature field filter format function generate global handler header height history identifier implementation "
    "import include index information initialize input instance integer interface international internationalization iterator keyboard language length library listener location manager material measure memory message method"
).split()

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind; a match that fails its length is dropped but uses up its text."""
    found: list[Span] = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


@dataclass
class SecretModel:
    """Log ratio of the two trigram models, by (last two characters, character), and the thresholds by class of
    length."""

    ratio: np.ndarray
    thresholds: np.ndarray

    def scores(self, tokens: list[str]) -> np.ndarray:
        """The mean log ratio of each token's characters."""
        if not tokens:
            return np.empty(0)
        # two marks before each token, so that nothing is remembered from the one before
        at = _CODE[np.frombuffer(("\0\0" + "\0\0".join(tokens)).encode("ascii"), np.uint8)]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        each = np.concatenate([[0.0], np.cumsum(self.ratio[at[:-2], at[1:-1], at[2:]])])
        ends = np.cumsum(sizes + 2) - 2
        return (each[ends] - each[ends - sizes]) / sizes

    def passed(self, tokens: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return self.scores(tokens) >= self.thresholds[np.maximum(0, np.searchsorted(CLASSES, sizes, side="right") - 1)]

    def spans(self, texts: list[str], taken: list[list[Span]]) -> list[list[Span]]:
        """The spans that the models add to those already ``taken``."""
        tokens, places = [], []  # (text, start, end, whether it is a part of a token)
        for k, (text, spans) in enumerate(zip(texts, taken, strict=True)):
            for m in LONG.finditer(text):
                start, end = m.span()
                rest = uncovered(start, end, spans) if spans else [(start, end)]
                if not rest:
                    continue
                tokens.append(m.group())
                places.append((k, start, end, False))
                if rest != [(start, end)]:
                    for s, e in rest:
                        if e - s >= LEAST:
                            tokens.append(text[s:e])
                            places.append((k, s, e, True))
        out: list[list[Span]] = [[] for _ in texts]
        whole_end = (-1, -1)
        for (k, s, e, part), secret in zip(places, self.passed(tokens).tolist(), strict=True):
            if secret and not (part and whole_end >= (k, e)):
                out[k].append((s, e, "markov"))
                if not part:
                    whole_end = (k, e)
        return out


def uncovered(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches of start:end that no span (by start) covers."""
    out, at = [], start
    for s, e, _ in spans:
        if e > at and s < end:
            if s > at:
                out.append((at, s))
            at = max(at, e)
    return [*out, (at, end)] if at < end else out


def random_strings(many: int, seed: int, length: int | None = None) -> list[str]:
    """Positive samples: uniform strings over the alphabets that keys come in, of one length or of many."""
    draw = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[26:62]]
    return ["".join(draw.choices(draw.choice(alphabets), k=n)) for n in [length or draw.randint(LEAST, 64) for _ in range(many)]]


def identifiers(words: list[str], many: int, seed: int | str, length: int | None = None) -> list[str]:
    """Negative samples: words alone or joined as identifiers, paths, rules and numbers are, of ``length``
    characters or a few more. At least ``many``, and as many as it takes to use every word."""
    draw = random.Random(seed)
    plain = sorted({w for w in words if re.fullmatch(r"[A-Za-z]{1,24}", w)}.union(COMMON))
    draw.shuffle(plain)
    used = 0
    joined = {"": "", "_": "_", "-": "-", "/": "/", "+": "+", "=": "="}
    out = []
    while len(out) < many or used < len(plain):
        n = length or draw.randint(LEAST, 64)
        style = draw.randrange(10)
        if style == 0:
            made = draw.choice("-=_+/aeno0") * n
        elif style == 1:
            made = "".join(draw.choices("0123456789", k=n))
        elif style == 2:
            made = draw.choice(["-", "/", ""]).join([f"{draw.randint(1990, 2030)}", f"{draw.randint(1, 12):02}", f"{draw.randint(1, 31):02}"])
        else:
            made = ""
        case = draw.choice([str, str.lower, str.upper, str.capitalize, str.capitalize])
        glue = joined[draw.choice(["", "", "_", "_", "-", "/", "+", "="])]
        while len(made) < n:
            if draw.random() < 0.7:
                part, used = case(plain[used % len(plain)]), used + 1
            else:
                part = case(draw.choice(COMMON))
            if draw.random() < 0.1:
                part += str(draw.randint(0, draw.choice([9, 99, 2030])))
            made += (glue if made else "") + part
        out.append(made)
    return out


def _counts(samples: list[str]) -> np.ndarray:
    """How often each trigram stands in the samples, marks before each included."""
    at = _CODE[np.frombuffer(("\0\0" + "\0\0".join(samples)).encode("ascii"), np.uint8)]
    cells = (at[:-2] * SIDE + at[1:-1]) * SIDE + at[2:]
    return np.bincount(cells[at[2:] > 0], minlength=SIDE**3)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """Trigram probabilities, smoothed towards bigrams and those towards uniform."""
    three = counts.reshape(SIDE, SIDE, SIDE)
    two = three.sum(0)
    p2 = (two + 1.0) / (two.sum(1, keepdims=True) + SIDE)
    return np.log((three + 8.0 * p2[None]) / (three.sum(2, keepdims=True) + 8.0))


Tally = Callable[[list[str], int, int], pd.DataFrame]  # (words, at least so many strings, group) -> (k, cell, n)


def _tally_grams(seed: int) -> Tally:
    def tally(words: list[str], many: int, group: int) -> pd.DataFrame:
        counts = _counts(identifiers(words, many, f"{seed}:{group}"))
        cells = np.flatnonzero(counts)
        return pd.DataFrame({"k": np.zeros(len(cells), np.int32), "cell": cells, "n": counts[cells]})

    return tally


def _tally_scores(model: SecretModel, seed: int) -> Tally:
    """How many identifiers of each class of length have which score, in steps; all below 0 are one."""

    def tally(words: list[str], many: int, group: int) -> pd.DataFrame:
        parts = []
        for k, length in enumerate(CLASSES):
            scores = model.scores(identifiers(words, many, f"{seed + k}:{group}", length))
            cells, n = np.unique(np.floor(np.maximum(scores, 0) * STEPS).astype(np.int64), return_counts=True)
            parts.append(pd.DataFrame({"k": np.full(len(cells), k, np.int32), "cell": cells, "n": n}))
        return pd.concat(parts)

    return tally


def _summed(words: DataFrame | list[str], samples: int, tally: Tally) -> pd.DataFrame:
    """The tallies of all groups of words, added up by (k, cell)."""
    if isinstance(words, list):
        return tally(words, samples, 0)
    total = words.count()
    groups = -(-total // GROUP)
    if groups <= 1:  # the same as one group on an executor
        return tally(sorted(r["w"] for r in words.collect()), samples, 0)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return tally(sorted(frame["w"]), -(-samples * len(frame) // total), int(frame["g"].iloc[0]))

    dealt = words.select("w", F.pmod(F.xxhash64("w"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(work, "k int, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()


def train(words: DataFrame | list[str], samples: int = 6000, seed: int = 20, false_rate: float = 1e-3) -> SecretModel:
    """Fit on ``samples`` random strings and at least as many identifiers, made of all ``words``, a list or a table of
    different ones (w), and set the thresholds so that of others of each class of length at most ``false_rate`` of
    the identifiers pass."""
    grams, counts = _summed(words, samples, _tally_grams(seed + 1)), np.zeros(SIDE**3)
    counts[grams["cell"].to_numpy()] = grams["n"].to_numpy()
    ratio = _log_model(_counts(random_strings(samples, seed))) - _log_model(counts)
    model = SecretModel(ratio, np.full(len(CLASSES), 0.25))
    held = _summed(words, samples, _tally_scores(model, seed + 2))
    for k, of in held.groupby("k"):
        of = of.sort_values("cell", ascending=False)
        cells, passing = of["cell"].to_numpy(), np.cumsum(of["n"].to_numpy())
        # just above the highest score that may not pass
        last = cells[np.searchsorted(passing, passing[-1] * false_rate, side="right")]
        model.thresholds[k] = max(0.25, float(last + 1) / STEPS)
    return model


def corpus_words(docs: DataFrame, text: str, most: int = 200_000) -> DataFrame:
    """(w): the different words of all texts, runs of 2 to 24 letters between characters that keys don't hold, for
    the negative samples. A task holds about ``most`` words before it passes them on."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in seen if x.isalpha() and 2 <= len(x) <= 24], pa.string())], names=["w"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    seen.update(x.encode("utf-8", "surrogatepass").translate(_APART).split())
                if len(seen) >= most:
                    yield passed_on()
                    seen.clear()
        if seen:
            yield passed_on()

    return materialize(few_files(docs.select(F.col(text).alias("t")).mapInArrow(work, "w string").distinct()), "secret-words")


def all_spans(texts: list[str | None], model: SecretModel) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by start and then by kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    plain = [x or "" for x in texts]
    base = [sorted(base_spans(x), key=order) for x in plain]
    return [(x, sorted(x + more, key=order) if more else x) for x, more in zip(base, model.spans(plain, base), strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with each stretch that any span covers replaced by ``mark``."""
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= end:
            out += [text[at:s], mark] if end < 0 else [text[end:s], mark]
        end = max(end, e)
    return text if end < 0 else "".join(out) + text[end:]


def scan(docs: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = all_spans(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS[:3]]
            sums = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, sums, pa.array([written(x) for _, x in got], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return step

    return chosen.mapInArrow(per_row(work), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SecretModel, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span replaced by ``mark``; ``length``, if there is such a column, follows."""
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    def work():
        model = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            spans = [x for _, x in all_spans(texts, model)]
            if not any(spans):
                return batch
            new = [redacted(x, s, mark) if s else x for x, s in zip(texts, spans, strict=True)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                old = batch.column(size).to_pylist()
                columns[size] = pa.array([len(y) if s else o for y, s, o in zip(new, spans, old, strict=True)], batch.schema.field(size).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return step

    return docs.mapInArrow(per_row(work), docs.schema)
