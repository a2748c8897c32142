"""Toxicity scores of deobfuscated text.

Noisy-channel restoration: a word written with digits and signs for letters, with letters held down, spelled
with gaps or torn in pieces becomes a lattice of readings, in which gaps and word ends are readings too, and
Viterbi search finds the likeliest path under a character trigram model of all documents. The restored words
are then scored by a sparse linear model over words and word beginnings and ends, fitted on labelled rows.

Words are in pieces everywhere in ordinary text, so pieces are decoded only where they make a word that the
fitted model knows. A letter that is held down, and a run of one sign, count as one letter or two.

Edge cases: null and empty texts have no evidence and get the base score. Texts, tokens and runs of any length
are read whole. Rows are judged one by one, so repeated rows and ids give repeated results; extra columns are
ignored, and may be called as anything. A label counts if a document has its id; an id with several labels is
toxic if one of them says so. Among features of equal strength the first by name is kept. Without labelled rows
of both kinds, or with an empty table, every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize, per_row, small_batches

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãçèéêëìíîïñòóôöõùúûüßœæ"
SIDE = len(LETTERS) + 1  # 0: anything else, a word's edge
_CODE = np.zeros(0x250, np.uint8)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, SIDE)
AT = {c: i + 1 for i, c in enumerate(LETTERS)}

_SIGNS = re.escape("".join(LEET))
#: A word; a word with signs among or after its letters; three or more single characters with gaps between.
PLAIN = re.compile(r"[^\W\d_]+")
MIXED = re.compile(rf"[^\W_{_SIGNS}]*(?:[{_SIGNS}]+[^\W\d_]+)+[{_SIGNS}]*|[^\W\d_]+[{_SIGNS}]*[^\W\d_][@$013457]+(?!\w)")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W\d_]|[{_SIGNS}])(?:[ .*_-]+(?:[^\W\d_]|[{_SIGNS}])){{2,}}(?![^\W_])")
GAP = re.compile(r"[ .*_-]+")
HELD = re.compile(r"([^\W\d_])\1\1")
TRIGGER = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|[{_SIGNS}][^\W\d_]{{2}}|[^\W\d_]{{2}}[@$013457](?!\w)")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (letter, letter, letter) codes over whole texts; runs of other characters count as one edge."""
    table = np.zeros(SIDE**3, np.int64)
    for text in texts:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(raw < len(_CODE), _CODE[np.minimum(raw, len(_CODE) - 1)], 0).astype(np.int64)
        code = np.concatenate([[0], code, [0]])
        kept = np.ones(len(code), bool)
        kept[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code = code[kept]
        edge = np.zeros(len(code) + 1, np.int64)
        edge[1:] = code  # two edges before the first letter
        before = np.where(edge[1:-1] == 0, 0, edge[:-2])  # nothing is remembered across an edge
        table += np.bincount((before * SIDE + edge[1:-1]) * SIDE + edge[2:], minlength=SIDE**3)
    return table


def corpus_model(docs: DataFrame, text: str) -> np.ndarray:
    """log P(c | a, b) from the trigram counts of every row's whole text. Each task sends its counts, at most
    SIDE**3 of them; the result has that size whatever the corpus."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("g", pa.int32()), ("c", pa.int64())])

    def count(batches):
        table = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            table += trigram_counts([x for x in batch.column(0).to_pylist() if x])
        at = np.flatnonzero(table)
        for i in range(0, len(at), 50_000):
            yield batches_of(schema, at[i : i + 50_000].astype(np.int32), table[at[i : i + 50_000]])

    table = np.zeros(SIDE**3)
    for r in docs.select(F.col(text)).mapInArrow(count, "g int, c long").groupBy("g").agg(F.sum("c").alias("c")).collect():  # SIDE**3 counts
        table[r["g"]] = r["c"]
    return log_model(table)


def log_model(counts: np.ndarray) -> np.ndarray:
    three = counts.reshape(SIDE, SIDE, SIDE).astype(float)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + SIDE)
    p2 = (two + 4 * p1[None]) / (two.sum(1, keepdims=True) + 4)
    return np.log((three + 4 * p2[None]) / (three.sum(2, keepdims=True) + 4)).astype(np.float32)


def lattice(token: str, ends: bool = False) -> list[list[tuple[str, float]]]:
    """For each place the readings (letters, cost): a sign may be any letter it stands for or, at a price,
    nothing; a letter that is held down is one or two; a gap is nothing. With ``ends``, a word may end between
    any two characters, and a space in the token is a wide gap, which costs something to read over."""
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if ends and places and c != " " and token[i - 1] != " ":
            places.append([("", 0.0), (" ", 0.0)])
        if c in AT:
            if j - i >= 3:
                places.append([(c, 0.0), (c + c, 1.0)])
                if ends:  # a word's last letters and the next one's first; nothing is held if none is dropped
                    places[-1] += [(x, 0.0 if len(x) - 1 == j - i else 1.0) for x in (f"{c} {c}", f"{c}{c} {c}", f"{c} {c}{c}", f"{c}{c} {c}{c}") if len(x) - 1 <= j - i]
            else:
                places.append([(c * (j - i), 0.0)])
                if ends and j - i == 2:
                    places[-1].append((f"{c} {c}", 0.0))
        elif c in LEET:
            for k in range(min(2, j - i)):
                if ends and k:
                    places.append([("", 0.0), (" ", 0.0)])
                places.append([(x, 0.5) for x in LEET[c]] + [("", 3.0)])
        elif c.isalpha():
            places.append([(c, 0.0)])
        elif ends and c == " ":
            places.append([(" ", 0.0), ("", 3.0)])
        i = j
    return places


def spelled(run: str) -> str:
    """The characters of a run that is spelled with gaps, with a space for each gap wider than its narrowest."""
    gaps = GAP.findall(run)
    least = min(map(len, gaps))
    letters = GAP.split(run)
    return letters[0] + "".join((" " if len(g) > least else "") + c for g, c in zip(gaps, letters[1:], strict=True))


def decode(token: str, model: np.ndarray, ends: bool = False) -> str:
    """The likeliest reading: Viterbi over states (last two letters), the best path kept for each. A path is
    (letters, path before), so the work is linear in the token's length. With ``ends``, the reading's words have
    spaces between."""
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(token, ends):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in beam.items():
            for letters, cost in readings:
                x, y, s = a, b, score - cost
                for ch in letters:
                    if ch == " ":  # after an edge, another one is nothing
                        s += float(model[x, y, 0]) if y else 0.0
                        x = y = 0
                        continue
                    k = AT.get(ch, 0)
                    s += float(model[x, y, k])
                    x, y = y, k
                found = after.get((x, y))
                if found is None or s > found[0]:
                    after[(x, y)] = (s, (letters, path))
        beam = after
    _, path = max(((s + float(model[a, b, 0]), path) for (a, b), (s, path) in beam.items()), key=lambda x: x[0])
    parts = []
    while path is not None:
        letters, path = path
        parts.append(letters)
    return "".join(reversed(parts))


class Restorer:
    """Restores what looks obfuscated; any other word has a lattice of one path, itself."""

    def __init__(self, model: np.ndarray, wanted: frozenset[str] = frozenset(), most: int = 100_000):
        self.model, self.wanted, self.most, self.known = model, wanted, most, {}
        self.starts = {w[:k] for w in wanted for k in range(1, len(w))}

    def word(self, token: str, ends: bool = False) -> str:
        found = self.known.get((token, ends))
        if found is None:
            found = decode(token, self.model, ends)
            if len(self.known) > self.most:
                self.known.clear()
            if len(token) <= 80:  # longer ones are restored too, but not remembered
                self.known[token, ends] = found
        return found

    def words(self, text: str | None) -> set[str]:
        """The different words of the whole restored text, lower-cased."""
        if not text:
            return set()
        text = text.lower()
        plain = PLAIN.findall(text)
        words = set(plain)
        words.update(self.torn(plain, text))
        for w in [w for w in words if HELD.search(w)]:
            words.add(self.word(w))
        if TRIGGER.search(text):
            words.update(self.word(m.group()) for m in MIXED.finditer(text))
        for m in SPACED.finditer(text):
            run = spelled(m.group())
            letters = run.replace(" ", "")
            if len(set(letters)) > 1:
                words.add(self.word(letters))  # the run as one word, and its likeliest words
                words.update(self.word(run, True).split())
        return words


    def torn(self, plain: list[str], text: str) -> list[str]:
        """``wanted`` words in pieces with gaps between ("idi ot"), if the likeliest reading of the pieces has the
        word whole."""
        starts, wanted, found = self.starts, self.wanted, []
        for i, piece in enumerate(plain):
            if piece not in starts:
                continue
            for j in range(i + 1, len(plain)):
                piece += plain[j]
                if piece in wanted:
                    parts = plain[i : j + 1]
                    if re.search(r"(?<![^\W_])" + GAP.pattern.join(parts) + r"(?![^\W_])", text) and piece in self.word(" ".join(parts), True).split():
                        found.append(piece)
                if piece not in starts:
                    break
        return found


def features(word: str) -> list[str]:
    """The word, and beginnings and ends of 4 to 6 characters, which inflected forms share."""
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if k <= n), *(f"{word[-k:]}$" for k in (4, 5, 6) if k <= n)]


@dataclass
class ToxicityModel:
    """Weights of at most ``most`` features, a base score and the character model."""

    weights: dict[str, float]
    bias: float
    scale: float
    characters: np.ndarray

    def usable(self) -> bool:
        return self.scale > 0


class Judge:
    def __init__(self, model: ToxicityModel, most: int = 300_000):
        self.model, self.most = model, most
        self.restore = Restorer(model.characters, frozenset(f[1:] for f in model.weights if f[0] == "="))
        self.weight: dict[str, float] = {}

    def raw(self, text: str | None) -> float:
        words = self.restore.words(text)
        weight, table = self.weight, self.model.weights
        if len(weight) > self.most:
            weight.clear()
        for w in words.difference(weight):
            got = [table[f] for f in features(w) if f in table]
            weight[w] = max(got) if got else 0.0
        return math.fsum(sorted(map(weight.__getitem__, words)))

    def __call__(self, text: str | None) -> float:
        m = self.model
        if not m.usable():
            return 0.0
        x = m.bias + m.scale * self.raw(text)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str, text: str, label_id: str, label: str, rows: int = 6000, most: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample: about ``rows`` / 2 rows of each label for which ``usable`` (over the
    documents' ``doc_id``) holds, drawn by the hash of the text. The character model covers all rows."""
    small_batches(docs.sparkSession)
    characters = corpus_model(docs, text)
    marks = labels.select(F.col(label_id).alias("i"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and i is not null").groupBy("i").agg(F.max("y").alias("y"))
    ids = docs.where(usable).select(F.col(doc_id).alias("i"))
    marks = materialize(marks.join(ids, "i", "left_semi"), "toxicity-labels")  # what is drawn of these can be broadcast
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel({}, 0.0, 0.0, characters)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    wanted = marks.where(draw < F.when(F.col("y") == 1, min(1.0, rows / 2 / counts[1])).otherwise(min(1.0, rows / 2 / counts[0])))
    sample = docs.where(usable).select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(wanted), "i").select("t", "y")
    sent = docs.sparkSession.sparkContext.broadcast(characters)
    schema = pa.schema([("f", pa.string()), ("p", pa.int64()), ("n", pa.int64())])

    def count(batches):
        restore, found = Restorer(sent.value), (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update({f for w in restore.words(t) for f in features(w)})
        rows = [(f, found[1][f], found[0][f]) for f in {*found[0], *found[1]}]
        for i in range(0, len(rows), 50_000):
            yield batches_of(schema, *zip(*rows[i : i + 50_000], strict=True))

    have = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = have.get(1, 0), have.get(0, 0)
    if not pos or not neg:
        return ToxicityModel({}, 0.0, 0.0, characters)
    # Evidence enough that a feature that means nothing would rarely show it: its signed root of the
    # log-likelihood ratio statistic.
    p, n = F.col("p"), F.col("n")
    share = float(pos) / (pos + neg)
    expected_p, expected_n = (p + n) * share, (p + n) * (1 - share)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    counted = sample.mapInArrow(count, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    strong = counted.where(p / float(pos) > n / float(neg)).withColumn("z", F.sqrt(2 * (part(p, expected_p) + part(n, expected_n)))).where("z > 4.2")
    weight = F.log(((p + 0.1) / (pos + 0.2)) / ((n + 0.1) / (neg + 0.2)))
    weights = {r["f"]: float(r["w"]) for r in strong.where(weight > 1.5).select("f", weight.alias("w"), "z").orderBy(F.desc("z"), "f").limit(most).collect()}
    trial = ToxicityModel(weights, 0.0, 1.0, characters)
    seen = docs.sparkSession.sparkContext.broadcast(trial)

    def raw(batches):
        judge = Judge(seen.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([judge.raw(x) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "y"])

    got = sample.mapInArrow(raw, "x double, y int").toPandas()  # two numbers a sample row
    trial.bias, trial.scale = logistic(got["x"].to_numpy(), got["y"].to_numpy())
    return trial


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, float]:
    """Bias and slope by Newton steps, both labels weighted alike; a little ridge keeps separable data finite."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order].astype(float)
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a, b = 0.0, 0.1
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        grad = design.T @ (w * (y - p)) - ridge * np.array([a, b])
        hess = (design * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * np.eye(2)
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), max(1e-6, float(b))


def score(docs: DataFrame, keys: list[Column], text: str, model: ToxicityModel) -> DataFrame:
    """(keys..., score, predicted) of every row; whole texts, no shuffle."""
    small_batches(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    names = chosen.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        judge = _judge(sent)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [judge(x) for x in batch.column(len(names)).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], names=[*names, "score", "predicted"])

        return step

    return chosen.mapInArrow(per_row(work), f"{fields}, score double, predicted int")


_judges: dict[int, Judge] = {}


def _judge(sent) -> Judge:
    model = sent.value
    if id(model) not in _judges:
        _judges.clear()
        _judges[id(model)] = Judge(model)
    return _judges[id(model)]
