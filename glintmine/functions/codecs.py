"""Closed vocabularies, JSON flags, packed vectors and coverage texts."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that tables store, and what an unknown one counts as.
CHUNK_TYPES = ("component", "hook", "type_def", "css_rule", "html_element", "test_case", "rust_fn", "rust_struct", "rust_enum", "rust_trait", "rust_impl", "md_section", "other", "inner_fn")
SOURCE_KINDS = ("vendor", "test", "src")
REF_KINDS = ("named", "default", "namespace", "type_only", "side_effect", "mod_decl")
UNKNOWN = {CHUNK_TYPES: "other", SOURCE_KINDS: "src", REF_KINDS: "named"}


def coded(value: Column, names: tuple[str, ...]) -> Column:
    """``value`` if it is one of ``names``, else what unknown names count as; null stays null."""
    return F.when(value.isNull() | value.isin(*names), value).otherwise(UNKNOWN[names])


def flags_json(flags: Column) -> Column:
    """Flags as a JSON array; null (not scanned) stays null."""
    return F.to_json(flags)


def flags_of(json: Column) -> Column:
    """The flags of a JSON array; null where there is none, or it can't be read as one."""
    return F.from_json(json, "array<string>")


def packed(vector: list[float]) -> bytes:
    """A vector as little-endian 32-bit floats, as other stores keep them."""
    return struct.pack(f"<{len(vector)}f", *vector)


def unpacked(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data[: len(data) // 4 * 4]))


def coverage_text(embedded: Column, total: Column, embeddable: Column) -> Column:
    """``a/b chunks (p%)``: b counts all chunks, p is of those that can have a vector, floored and at most 100."""
    percent = F.when(embeddable == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(100 * embedded / embeddable)))
    return F.format_string("%d/%d chunks (%d%%)", embedded, total, percent.cast("long"))
