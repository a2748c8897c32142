"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to its character
n-grams, longest first, and is scored at the first length at which any of its n-grams is known.

Edge cases: null text or a text without a letter gives ``und`` with score 0. A text whose words and
n-grams are all unknown gets the most frequent learned language with score 1 / (number of languages).
Without any usable training row, as in an empty table, every text is ``und``; rows with a null text or language
are not learned from. Texts of any length are read whole. Rows are judged one by one, so repeated rows and
repeated ids give repeated results; extra columns are ignored by ``identify``, whatever they are called, and kept
by ``keep_identified``. Ties go to the first language by name, and among features of equal frequency the first
by name is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, few_files, held, materialize, per_row, small_batches

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5  # characters of the longest n-gram
#: What one pair of n-gram tables says for an unseen word, relative to a known word.
GRAM_WEIGHT = 0.6


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters. ``\\w`` without digits also has number forms such as a superscript two,
    so a run counts only if a real letter is in it."""
    found = WORD.findall(text.lower()) if text else []
    return found if text is None or text.isascii() else [w for w in found if w.isascii() or any(c.isalpha() for c in w)]


def grams(word: str, n: int) -> set[str]:
    edged = f"^{word}$"
    return {edged[i : i + n] for i in range(len(edged) - n + 1)}


@dataclass
class LanguageModel:
    """Centred log frequencies, one float per language, of words and n-grams; bounded by fit()'s limits."""

    languages: list[str]
    prior: list[float]
    words: dict[str, list[float]]
    tables: dict[int, dict[str, list[float]]]

    def word_score(self, word: str) -> list[float]:
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.tables.get(n, {})
            hits = [table[g] for g in grams(word, n) if g in table]
            if hits:
                return [GRAM_WEIGHT * sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(self.languages)


class Scorer:
    """Adds up word scores; what a word scores is kept, in a cache of bounded size."""

    def __init__(self, model: LanguageModel, most: int = 300_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self.reset()
        at = self.at
        for w in set(words).difference(at):
            k = len(at)
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k], at[w] = self.model.word_score(w), k
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letters(text)
        model = self.model
        if not words or not model.languages:
            return "und", 0.0
        total = self.rows_of(words)
        if not np.any(total):
            return model.languages[int(np.argmax(model.prior))], 1.0 / len(model.languages)
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return model.languages[best], float(p[best] / p.sum())

    def rows_of(self, words: list[str]) -> np.ndarray:
        at = self.places(words)
        return self.rows[at].sum(0)


def fit(docs: DataFrame, text: str, lang: str, usable: Column, salt: Column, per_language: int = 3000, most_words: int = 60_000, most_grams: int = 60_000, most_languages: int = 200) -> LanguageModel:
    """Learn from the rows where ``usable`` holds and text and language are not null. Bounded by
    parameters: about ``per_language`` rows of each of the ``most_languages`` most frequent languages (others
    are not learned) are drawn by the hash of ``salt``, and the tables keep the most frequent ``most_words``
    words and ``most_grams`` n-grams. All limits hold for counts over the whole sample, so the model does not
    depend on how rows are dealt over tasks."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), salt.alias("s"), usable.alias("u")).where("u and t is not null and l is not null")
    have = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_languages).toLocalIterator()}
    languages = sorted(have)
    if not languages:
        return LanguageModel([], [], {}, {})
    rate = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("s"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.try_element_at(rate, F.col("l"))).select("l", "t")
    word_schema = pa.schema([("l", pa.string()), ("f", pa.string()), ("c", pa.int64())])
    gram_schema = pa.schema([("l", pa.string()), ("n", pa.int32()), ("f", pa.string()), ("c", pa.int64())])

    def pieces_of(found: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 20_000):
            yield batches_of(schema, *zip(*found[i : i + 20_000], strict=True))

    def count_words(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(l, Counter()).update(letters(t))
        for l, found in words.items():
            yield from pieces_of([(l, w, c) for w, c in found.items()], word_schema)

    def count_grams(batches):
        found: Counter = Counter()
        for batch in batches:
            for l, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[l, n, g] += min(c, 8)  # one frequent word is not the whole evidence of its n-grams
        yield from pieces_of([(*k, c) for k, c in found.items()], gram_schema)

    whole = materialize(few_files(sample.mapInArrow(count_words, "l string, f string, c long").groupBy("l", "f").agg(F.sum("c").alias("c"))), "lang-words")
    parts = whole.mapInArrow(count_grams, "l string, n int, f string, c long").groupBy("l", "n", "f").agg(F.sum("c").alias("c"))
    size = whole.groupBy("l").agg(F.count("*").alias("size"))
    both = whole.select("l", F.lit(0).alias("n"), "f", "c").unionByName(parts)
    # a feature seen once says little and is most of what there is
    counted = both.join(F.broadcast(size), "l").where("c > 1 or n in (1, 2) or size < 2000")
    by = counted.groupBy("n", "f").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("by"))
    words = by.where("n = 0").orderBy(F.desc("c"), "f").limit(most_words)
    pieces = by.where("n > 0").orderBy(F.desc("c"), "n", "f").limit(most_grams)
    tables: dict[int, dict[str, dict[str, int]]] = {n: {} for n in range(LONGEST + 1)}
    for r in words.unionByName(pieces).toLocalIterator():
        tables[r["n"]][r["f"]] = r["by"]
    scored: dict[int, dict[str, list[float]]] = {}
    for n, found in tables.items():
        total = {l: sum(x.get(l, 0) for x in found.values()) for l in languages}
        size = max(1, len(found))
        smooth = 0.5
        table = {}
        for f, c in found.items():
            p = [math.log((c.get(l, 0) + smooth) / (total[l] + smooth * size)) for l in languages]
            mean = sum(p) / len(p)
            table[f] = [round(x - mean, 4) for x in p]
        scored[n] = table
    return LanguageModel(languages, [float(have[l]) for l in languages], scored.pop(0), scored)


def identify(docs: DataFrame, keys: list[Column], text: str, model: LanguageModel) -> DataFrame:
    """(keys..., lang_pred, score) of every row; whole texts, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    names = chosen.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    sent = spark.sparkContext.broadcast(model)

    def work():
        score = scorer(sent)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [score(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*names, "lang_pred", "score"])

        return step

    return chosen.mapInArrow(per_row(work), f"{fields}, lang_pred string, score double")


def keep_identified(docs: DataFrame, text: str, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The rows, unchanged, whose text has a language with a score of ``least`` or more."""
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work():
        score = scorer(sent)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            mask = [lang != "und" and p >= least for lang, p in map(score, batch.column(at).to_pylist())]
            return batch.filter(pa.array(mask, pa.bool_()))

        return step

    return docs.mapInArrow(per_row(work), docs.schema)


def scorer(sent) -> Scorer:
    """One scorer for a model in a Python worker: its cache outlives a task. It keeps the model, whose id so stays its
    own."""
    model = sent.value
    return held(("scorer", id(model)), lambda: Scorer(model))
