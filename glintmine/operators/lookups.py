"""Rows of an index by key: chunks by id or file, other chunks of a file, contexts, times and files by chunk type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import has_prefix


def chunks_by_ids(chunks: DataFrame, ids: DataFrame, types: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Chunks of ``ids`` (chunk_id); no types or no prefixes, no filter of that kind."""
    found = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").where(has_prefix(F.col("file_path"), prefixes or []))
    return found.where(F.col("chunk_type").isin(types)) if types else found


def chunks_of_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """All chunks of ``files`` (file_path), by file and line."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_semi").orderBy("file_path", "start_line", "chunk_id")


def siblings(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, name, chunk_type, start_line, end_line) of the chunks of ``files``, by file and line."""
    return chunks_of_files(chunks, files).select("file_path", "name", "chunk_type", "start_line", "end_line")


def contexts(context: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, imports_text) of those of ``files`` that have any."""
    return context.join(files.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "imports_text")


def times(context: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, mtime_epoch) of those of ``files`` whose time is known."""
    return context.where("mtime_epoch is not null").join(files.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "mtime_epoch")


def files_with_types(chunks: DataFrame, files: DataFrame, types: list[str]) -> DataFrame:
    """Those of ``files`` that have a chunk of one of ``types``; no types, no files."""
    wanted = F.col("chunk_type").isin(types) if types else F.lit(False)
    return files.select("file_path").distinct().join(chunks.where(wanted), "file_path", "left_semi")
