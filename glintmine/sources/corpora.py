"""Pattern and ground-truth corpora in YAML, the ones that come with the package, and labelled cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.resources import files

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..operators.measures import Pattern, flags


@dataclass(frozen=True)
class Case:
    """A labelled text: the flags that a scan should find at least one of, or none for a clean one."""

    id: str
    content: str
    expected_flags: tuple[str, ...] = ()


def entries(text: str) -> list[dict]:
    try:
        told = yaml.safe_load(text)
        return list(told["entries"])
    except (yaml.YAMLError, TypeError, KeyError) as e:
        raise InvalidInput(f"YAML parse error: {e}") from e


def _made(each: list[dict], make: Callable) -> list:
    out = []
    for e in each:
        try:
            out.append(make(e))
        except (KeyError, TypeError) as problem:
            raise InvalidInput(f"entry {e.get('id') if isinstance(e, dict) else e!r} lacks {problem}") from problem
    return out


def patterns(text: str) -> list[Pattern]:
    """The patterns of a corpus; one whose regular expression can't be compiled is an error that names it."""
    kinds = {"literal": False, "regex": True}
    return _made(entries(text), lambda e: Pattern(e["id"], e["pattern"], tuple(e["expected_flags"]), kinds[e["pattern_type"]]))


def positives(text: str) -> list[Case]:
    """The labelled cases of a corpus: every entry has to have a text."""

    def make(e: dict) -> Case:
        if not (e.get("test_content") or "").strip():
            raise InvalidInput(f"corpus entry {e['id']} is missing non-empty `test_content`")
        return Case(e["id"], e["test_content"], tuple(e["expected_flags"]))

    return _made(entries(text), make)


def negatives(text: str) -> list[Case]:
    return _made(entries(text), lambda e: Case(e["id"], e["content"]))


def judged(spark: SparkSession, scanner: list[Pattern], cases: list[Case]) -> DataFrame:
    """(id, expected, found, expected_flags, actual_flags) of labelled cases, for measures.verification(): a positive case
    is found if one of its flags is, a negative one if any is."""
    rows = spark.createDataFrame([(c.id, c.content, list(c.expected_flags)) for c in cases], "id string, content string, expected_flags array<string>")
    scanned = rows.withColumn("actual_flags", flags(F.col("content"), scanner))
    expected = F.size("expected_flags") > 0
    found = F.when(expected, F.arrays_overlap("expected_flags", "actual_flags")).otherwise(F.size("actual_flags") > 0)
    return scanned.select("id", expected.alias("expected"), found.alias("found"), "expected_flags", "actual_flags")


def ground_truth(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(wanted (entry, path, weight), seeds (entry, path), entries) of a corpus: every entry has files to find, each of
    a positive weight."""
    told = entries(text)

    def check(e: dict) -> dict:
        if not e["must_include"]:
            raise InvalidInput(f"gt entry {e['id']!r} has an empty must-include set")
        for f in e["must_include"]:
            if f["weight"] <= 0:
                raise InvalidInput(f"gt entry {e['id']!r} must-include {f['path']!r} has zero weight; weight must be positive")
        return {k: e[k] for k in ("id", "repo", "task", "seed", "must_include")}

    checked = _made(told, check)
    wanted = spark.createDataFrame([(e["id"], f["path"], float(f["weight"])) for e in checked for f in e["must_include"]], "entry string, path string, weight double")
    seeds = spark.createDataFrame([(e["id"], p) for e in checked for p in e["seed"]], "entry string, path string")
    return wanted, seeds, checked


def bundled(name: str) -> str:
    """A corpus that comes with the package: ``patterns``, ``negatives`` or ``ground_truth``."""
    return files("glintmine.data").joinpath(f"{name}.yaml").read_text(encoding="utf-8")
