"""Identifiers, keywords, stems, type hints and text normalisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
STOP_WORDS = ("the", "a", "an", "in", "for", "of", "with", "and", "or")
KEEP_ING = ("string", "bring", "thing", "nothing", "something", "everything", "ring", "king", "spring", "swing", "sing", "sting", "wing")
KEEP_S = ("class", "this", "alias", "canvas", "focus", "status", "bus", "process", "address", "access", "express", "progress")
TYPE_HINTS = {
    "hook": "hook", "hooks": "hook", "component": "component", "components": "component", "type": "type_def", "types": "type_def", "interface": "type_def",
    "css": "css_rule", "style": "css_rule", "styles": "css_rule", "test": "test_case", "tests": "test_case", "spec": "test_case",
}


#: Where an identifier is cut: at - and _, before a capital after a small letter, and before the last capital of
#: an acronym that a small letter follows. One rule for columns and for queries.
CUTS = r"[-_]|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"

#: Endings that stems lose: (ending, bytes that a word has to exceed, words that keep it, ending that isn't one).
ENDINGS = (("ing", 5, KEEP_ING, None), ("s", 3, KEEP_S, "ss"))


def split_identifier(name: Column) -> Column:
    """Parts of an identifier."""
    return F.filter(F.split(name, CUTS), lambda x: x != "")


def split_name(name: str) -> list[str]:
    return [x for x in regex.split(CUTS, name, flags=regex.V1) if x]


def stem(word: str) -> str | None:
    """The word without -ing or plural -s; None where there is nothing to take off. Lengths are in bytes."""
    for ending, longer, kept, no in ENDINGS:
        if word.endswith(ending) and len(word.encode()) > longer and word not in kept and not (no and word.endswith(no)):
            rest = word.removesuffix(ending)
            return rest if len(rest.encode()) >= 2 else None
    return None


def keywords(query: str) -> list[str]:
    """Lower-cased words and identifier parts in order, without stop words and single characters; stems that
    are no keyword themselves come last."""
    found: list[str] = []
    for token in query.split():
        for x in (token.lower(), *(p.lower() for p in split_name(token))):
            if len(x) >= 2 and x not in STOP_WORDS and x not in found:
                found.append(x)
    stems = [s for s in map(stem, found) if s is not None]
    return found + [s for s in stems if s not in found]


def type_hints(query: str) -> list[str]:
    return list(dict.fromkeys(TYPE_HINTS[w] for w in query.lower().split() if w in TYPE_HINTS))


def _stable() -> str:
    """A character class of what NFKC leaves alone wherever it stands: composed letters of the commoner scripts,
    and signs, without marks that combine. Built from the rule, so that only other text leaves the JVM."""
    keeps = [k for k in (*range(0x80, 0x250), *range(0x370, 0x530), *range(0x2010, 0x2027), *range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0x4E00, 0xA000)) if unicodedata.normalize("NFKC", chr(k)) == chr(k) and not unicodedata.combining(chr(k))]
    spans: list[list[int]] = []
    for k in keeps:
        if spans and spans[-1][1] == k - 1:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    return "\\x00-\\x7F" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


STABLE = _stable()


def normalized(text: Column) -> Column:
    """NFKC with A-Z lower-cased, for full-text matching. Only text that NFKC may change leaves the JVM."""
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower(F.when(text.rlike(f"[^{STABLE}]"), _nfkc(text)).otherwise(text))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), unicodedata.normalize("NFKC", text))
