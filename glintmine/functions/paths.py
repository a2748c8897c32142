"""Path predicates and file classification."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput

# Fixed values that results depend on.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "css", "html", "rs", "md")
VENDOR_DIRS = ("node_modules", "vendor", "third_party", "bower_components", "dist", "build", "target", ".git")
TEST_DIRS = ("tests", "test", "__tests__", "specs", "spec")
TEST_INFIXES = ("__tests__", "__mocks__", "__fixtures__", ".test.", ".spec.", ".stories.", "/test/", "/examples/", "/fixtures/", "/e2e/")
TEST_PREFIXES = ("test/", "examples/")
TEST_NAME = r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$|_test\.(rs|go|py)$|^tests\.rs$"


def is_test_path(path: Column) -> Column:
    return reduce(or_, [*(F.contains(path, F.lit(x)) for x in TEST_INFIXES), *(path.startswith(x) for x in TEST_PREFIXES)])


def source_kind(path: Column) -> Column:
    """vendor, test or src: a vendor directory above the file counts before a test directory, and that before
    the file's name."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    under = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    return F.when(under(VENDOR_DIRS), "vendor").when(under(TEST_DIRS), "test").when(name.rlike(TEST_NAME), "test").otherwise("src")


def has_prefix(path: Column, prefixes: list[str]) -> Column:
    """Any of the prefixes; no prefixes, no filter."""
    return reduce(or_, [path.startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def parse_target(target: str) -> tuple[str, str | None]:
    """``file:symbol`` at the last colon; what can't be a symbol belongs to the file."""
    file, colon, symbol = target.rpartition(":")
    return (file, symbol) if colon and file and symbol and not {"/", "\\"} & set(symbol) else (target, None)


def check_path(path: str) -> str:
    if ".." in path or path.startswith("/"):
        raise InvalidInput(f"'{path}' must be a relative path inside the project and must not contain '..'", "use a relative path inside the project root")
    return path
