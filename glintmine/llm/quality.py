"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is an expression over a document's measures. On a bounded sample a rule's cost (the time of its
measures and comparison over the texts) and its selectivity (the share it rejects) are estimated; rules then stand in one CASE in
the order of rejections per cost, so a row that one rule rejects is not asked the next. The order changes the
work, never the verdict.

Edge cases: null and empty texts have no words, symbols or lines, and fail. Ties between rules keep the
order given. Repeated rows, and rows with null or repeated ids, are judged one by one. Texts of any length are
read whole, their repeated windows told apart by hash before any are compared. Empty tables give no rows. Extra
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none of a null one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def duplicate_lines(found: Column) -> Column:
    return let(found, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(found: Column, width: int) -> Column:
    """Words in windows of ``width`` words that the text has twice or more. Windows are told apart by hash
    first; only a text in which hashes meet goes on to compare the windows themselves."""

    def exact(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (width - 1))
        windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("text"), i.alias("at")))

        def covered(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["text"] == F.get(s, j)["text"], F.lit(False))
            places = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["at"])), lambda x: x.isNotNull())
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda acc, at: F.struct((at + width).alias("end"), (acc["n"] + width - F.greatest(F.lit(0), acc["end"] - at)).alias("n"))
            return F.aggregate(F.array_sort(places), start, step, lambda acc: acc["n"].cast("long"))

        return let(F.array_sort(windows), covered)

    def maybe(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(F.when(unique, F.lit(0).cast("long")).otherwise(exact(w)))

    return let(found, maybe)


MEASURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{Lu}", "")).cast("long")


def with_text(docs: DataFrame, doc_id: str, text: str, window: int = 8) -> DataFrame:
    """MEASURES and the text as ``__text``."""
    whole = F.col(text)
    got = let(words(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w, window).alias("n_repeat_words")))
    first = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("__text"), got.alias("__w"))
    text_ = F.col("__text")
    return first.select(
        "doc_id", F.col("__w.n_words").alias("n_words"), word_chars(text_).alias("word_chars"), symbols(text_).alias("n_symbols"),
        duplicate_lines(lines(text_)).alias("n_dup_lines"), F.col("__w.n_repeat_words").alias("n_repeat_words"),
        line_count(text_).alias("n_lines"), capitals(text_).alias("n_upper"), text_,
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 8) -> DataFrame:
    """MEASURES of whole texts; no shuffle."""
    return with_text(docs, doc_id, text, window).select(*MEASURES)


def alone(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """The same measures, each worked out by itself, so that a rule over them costs what it needs."""
    whole = F.col(text)
    return docs.select(
        F.size(words(whole)).cast("long").alias("n_words"), word_chars(whole).alias("word_chars"), symbols(whole).alias("n_symbols"),
        duplicate_lines(lines(whole)).alias("n_dup_lines"), repeated_words(words(whole), window).alias("n_repeat_words"),
        line_count(whole).alias("n_lines"), capitals(whole).alias("n_upper"), whole.alias("__text"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean over the columns of measures(), or over ``__text``, the text: a measure that only
    this rule reads is then worked out only for rows that no earlier rule rejects."""

    name: str
    rejects: Column


def base_rules(least_words: int = 20, repeat_percent: int = 30) -> list[Rule]:
    return [Rule("too short", F.col("n_words") < least_words), Rule("repeats itself", 100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))]


def junk_rules() -> list[Rule]:
    """What ordinary prose in any language doesn't do."""
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("word length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("duplicate lines", 100 * F.col("n_dup_lines") > 30 * F.greatest(line_count(F.col("__text")), F.lit(5))),
        Rule("capitals", 10 * capitals(F.col("__text")) > 5 * F.col("word_chars")),
    ]


def seconds(job: Callable[[], object], tries: int = 2) -> float:
    """The shortest time of a few runs; the first one also compiles."""
    found = []
    for _ in range(tries):
        began = time.perf_counter()
        job()
        found.append(time.perf_counter() - began)
    return min(found)


def ordered(sample: DataFrame, rules: list[Rule], text: str = "text") -> list[Rule]:
    """``rules`` by rejections per cost on the texts of ``sample``, a small table. A rule's cost is the time of
    its measures and its comparison, without that of a job that only reads the texts."""
    if sample.isEmpty():
        return rules
    idle = seconds(lambda: sample.agg(F.max(F.length(text))).collect())
    found = []
    for k, rule in enumerate(rules):
        job = alone(sample, text).agg(F.count_if(rule.rejects))
        cost = seconds(lambda job=job: job.collect()) - idle
        found.append((-job.first()[0] / max(1e-3, cost), k))
    return [rules[k] for _, k in sorted(found)]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: list[Rule] | None = None, extra: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """measures() with base_failed, kept and ``failed`` (the rule that rejects). Base rules come first, since
    their verdict is a column of its own; the order within both lists is estimated on a random sample of
    at most ``sample_rows`` rows, whatever their ids are. The order changes the work, never the verdict."""
    base, extra = base_rules() if base is None else base, junk_rules() if extra is None else extra
    rate = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.select(F.col(text).alias("text")).sample(rate, 7).limit(sample_rows)
    order = ordered(materialize(drawn, "quality-sample"), base + extra)
    base, extra = [r for r in order if r in base], [r for r in order if r in extra]
    measured = with_text(docs, doc_id, text)
    base_failed = F.coalesce(F.col("failed").isin([r.name for r in base]), F.lit(False))
    judged = measured.select(*MEASURES, cascade([*base, *extra]).alias("failed"))
    return judged.withColumns({"base_failed": base_failed, "kept": F.col("failed").isNull()})
