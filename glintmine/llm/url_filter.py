"""URL filters: allow and block rules, and a character language-model ratio for what no rule fits.

All URLs that rules decide train two smoothed variable-order Markov models, one of accepted and one of rejected
URLs. A model's table has, for each context of up to ``ORDER`` characters and next character, the log ratio
of the two models' probabilities, each smoothed towards the next shorter context. A URL's score is the mean,
over its characters, of the ratio at the longest known context. The threshold is calibrated on all of them too,
each scored by models of the other half, so no URL is scored by a model that has seen it. DataFrame functions
only; grams are hashed into cells, and the table goes to the executors as one array of cells, the value of a
scalar subquery. A cell holds every gram that falls there by its 64-bit key, so the table grows with the number
of different grams; unknown ones back off to shorter contexts.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its
characters, the end mark alone if there are none. Without URLs that rules allow or block, no model can be
fitted: the verdict is allow. Scores that tie with the threshold are allowed. URLs of any length are read whole.
Repeated rows and ids are judged one by one; extra columns are ignored, whatever they are called. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ORDER = 4  # characters of the longest context
TABLE_BITS = 16  # cells, each a small map
FOLDS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``where``: a host and the beginning of a path, as in ``example.org/es/``."""

    where: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.where.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def decided(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(the longest rule that fits, whether it allows); nulls if none does."""
    longest = sorted(rules, key=lambda r: -len(r.where))
    which = reduce(lambda out, r: F.when(r.fits(host, path), F.lit(r.where)).otherwise(out), reversed(longest), F.lit(None).cast("string"))
    allows = reduce(lambda out, r: F.when(r.fits(host, path), F.lit(r.allow)).otherwise(out), reversed(longest), F.lit(None).cast("boolean"))
    return which, allows


def reading(url: Column) -> Column:
    """What the models read: the whole url, query and fragment included, a start mark for each character of
    context."""
    return F.concat(F.lit("^" * ORDER), F.lower(F.coalesce(url, F.lit(""))), F.lit("$"))


def places(text: Column) -> Column:
    return F.sequence(F.lit(ORDER + 1), F.length(text))


def cell(key: Column) -> Column:
    return F.pmod(key, F.lit(1 << TABLE_BITS)).cast("int")


def gram_counts(training: DataFrame, *by: str) -> DataFrame:
    """(by, g, a, b): how often each gram stands in allowed and in blocked rows (text, allows)."""
    each = training.select(*by, "allows", F.explode(F.transform(places(F.col("text")), lambda i: F.substring(F.col("text"), i - ORDER, F.lit(ORDER + 1)))).alias("g"))
    return each.groupBy(*by, "g").agg(F.count_if("allows").cast("double").alias("a"), F.count_if(~F.col("allows")).cast("double").alias("b"))


def gram_table(training: DataFrame) -> DataFrame:
    """The model's table from rows (text, allows)."""
    return ratio_table(gram_counts(training))


def ratio_table(grams: DataFrame) -> DataFrame:
    """(place, key, ratio) of the model's table from rows (g, a, b), where a gram may repeat; its key is its 64-bit
    hash."""
    # counts of (context, next) for every length of context, and of the contexts
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring(F.col("g"), F.lit(ORDER + 2) - k, k)))
    levels = grams.select(ends.alias("g"), "a", "b").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    context = Window.partitionBy(F.substring(F.col("g"), F.lit(1), F.length("g") - 1))
    counted = materialize(levels.select("g", "a", "b", F.sum("a").over(context).alias("ca"), F.sum("b").over(context).alias("cb"), F.count("*").over(context).alias("kinds")), "url-grams")
    # each gram with its own ends, the shortest first: a context passes on as much to the next shorter one as
    # it has seen different characters
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.substring(F.col("g"), F.length("g") - k + 1, k)))
    chains = counted.select(F.col("g").alias("of"), tails.alias("g")).join(counted.hint("merge"), "g")
    steps = chains.groupBy("of").agg(F.array_sort(F.collect_list(F.struct(F.length("g").alias("n"), "a", "b", "ca", "cb", "kinds"))).alias("steps"))

    def longer(below: Column, s: Column) -> Column:
        return F.struct(*[((s[k] + s["kinds"] * below[k]) / (s[f"c{k}"] + s["kinds"])).alias(k) for k in "ab"])

    p = F.aggregate("steps", F.struct(F.lit(1 / 64.0).alias("a"), F.lit(1 / 64.0).alias("b")), longer)
    key = F.xxhash64(F.concat((F.length("of") - 1).cast("string"), F.lit(":"), "of"))
    return steps.select(cell(key).alias("place"), key.alias("key"), F.log(p["a"] / p["b"]).alias("ratio"))


def as_array(gram_rows: DataFrame) -> Column:
    """The table as one array of 2**TABLE_BITS maps from key to ratio, null where a cell has no gram: one row of a written
    table, read as a scalar subquery, so no join, no shuffle and no large literal is in the plans that use it."""
    # equal keys, which only different grams with the same 64-bit hash could have, share a ratio
    grams = gram_rows.groupBy("place", "key").agg(F.max("ratio").alias("ratio"))
    held = grams.groupBy("place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "ratio")))).alias("entries"))
    cells = gram_rows.sparkSession.range(1 << TABLE_BITS).join(held, F.col("id") == F.col("place"), "left")
    # by id alone, since maps have no order
    row = cells.agg(F.array_sort(F.collect_list(F.struct("id", "entries")), lambda x, y: (x["id"] - y["id"]).cast("int")).alias("cells"))
    return materialize(row.select(F.col("cells.entries").alias("entries")), "url-model").scalar()


def score(text: Column, model: Column) -> Column:
    """Mean log ratio of a text's characters, each at the longest context that the table knows."""

    def total(table: Column) -> Column:
        def at(i: Column) -> Column:
            keys = [F.xxhash64(F.concat(F.lit(f"{n}:"), F.substring(text, i - n, F.lit(n + 1)))) for n in range(ORDER, -1, -1)]
            return F.coalesce(*[F.get(table, cell(k))[k] for k in keys], F.lit(0.0))

        return F.aggregate(places(text), F.lit(0.0), lambda acc, i: acc + at(i))

    # the table is named once, by a lambda's variable
    return F.transform(F.array(model), total)[0] / F.size(places(text))


def scored(rows: DataFrame, model: Column) -> DataFrame:
    """``rows`` with the score of ``text``; a subquery has to be a column before a lambda can take it."""
    return rows.withColumn("__table", model).withColumn("score", score(F.col("text"), F.col("__table"))).drop("__table")


def fitted(labelled: DataFrame) -> tuple[Column, float]:
    """(the models' table, the threshold) from all rows (text, allows). Copies of a text share a fold."""
    rows = materialize(labelled.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "url-labelled")
    grams = materialize(gram_counts(rows, "fold"), "url-counts")
    apart = []
    for k in range(FOLDS):
        others = as_array(ratio_table(grams.where(F.col("fold") != k)))
        apart.append(materialize(scored(rows.where(F.col("fold") == k), others).select("allows", "score"), "url-scores"))
    return as_array(ratio_table(grams)), calibrated(reduce(DataFrame.unionAll, apart))


def judge(pages: DataFrame, rules: list[UrlRule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; the models are fitted on all URLs that rules
    decide."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), reading(F.col(url)).alias("text"))
    which, allows = decided(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": which, "allows": allows})
    labelled = rows.where("allows is not null").select("text", "allows")
    kinds = labelled.agg(F.count_if("allows").alias("yes"), F.count_if(~F.col("allows")).alias("no")).first()
    if not kinds["yes"] or not kinds["no"]:
        return rows.select("page_id", "host", "path", "rule", F.when(F.coalesce("allows", F.lit(True)), "allow").otherwise("block").alias("verdict"), F.lit(0.0).alias("score"))
    model, threshold = fitted(labelled)
    judged = scored(rows, model)
    allowed = F.coalesce("allows", F.col("score") >= threshold)
    return judged.select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score")


def calibrated(rows: DataFrame) -> float:
    """The score that best parts the labels, among their deciles, both labels weighted alike; 0 if one lacks."""
    marks = [k / 20 for k in range(1, 20)]
    found = rows.agg(F.percentile_approx("score", marks, 1000).alias("q"), F.count_if("allows").alias("yes"), F.count_if(~F.col("allows")).alias("no")).first()
    if not found["yes"] or not found["no"]:
        return 0.0
    tries = sorted({0.0, *found["q"]})
    right = rows.agg(*[(F.count_if(F.col("allows") & (F.col("score") >= t)) / found["yes"] + F.count_if(~F.col("allows") & (F.col("score") < t)) / found["no"]).alias(f"t{k}") for k, t in enumerate(tries)]).first()
    return max(zip(right, (-abs(t) for t in tries), tries, strict=True))[2]
