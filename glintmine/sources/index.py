"""Scans of source files, and the index job: what changed, its chunks, edges and context, and what is gone."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, source_kind
from ..operators import chunking, fulltext
from ..operators.measures import Pattern, flags
from ..session import materialize, reachable
from . import config
from .store import Store

MOST_BYTES = 1_000_000
SCANNED = "file_path string, content string, file_hash string, mtime_epoch long, outcome string"


def scan(spark: SparkSession, root: str, exclude_vendor: bool = False) -> DataFrame:
    """(file_path, content, file_hash, source_kind, mtime_epoch, outcome) of the source files under ``root``: outcome is
    read, skipped (too large, and never read) or errored (can't be read, or isn't UTF-8). A path is walked on the
    machines that share it, with its ignore files; a URI is listed by Spark."""
    files = listed(spark, root) if "://" in root else walked(spark, root)
    files = files.withColumn("source_kind", source_kind(F.col("file_path")))
    return files.where("source_kind != 'vendor'") if exclude_vendor else files


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Files of a store that only Spark reads: small ones with their content, of the others the name alone. Spark
    leaves out names that start with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = root.rstrip("/").replace("file:///", "file:/") + "/"
    path = F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(base) + 1})")
    seconds = F.unix_timestamp("modificationTime")
    own = [path.alias("file_path"), F.when(seconds >= 0, seconds).alias("mtime_epoch")]
    small = files.where(F.col("length") <= MOST_BYTES).select(*own, "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    read = small.select("file_path", text.alias("content"), F.sha2(text, 256).alias("file_hash"), "mtime_epoch", F.when(valid, "read").otherwise("errored").alias("outcome"))
    none = F.lit(None).cast("string")
    large = files.where(F.col("length") > MOST_BYTES).select(*own).select("file_path", none.alias("content"), none.alias("file_hash"), "mtime_epoch", F.lit("skipped").alias("outcome"))
    return read.unionByName(large).where(~F.col("file_path").rlike(r"(^|/)\."))


@dataclass(frozen=True)
class _Folder:
    path: str  # relative to the root, "" for it
    ignored: config.Ignored


def _look(root: str, folder: _Folder) -> tuple[list[str], list[_Folder]]:
    """(source files, folders) directly in a folder, without hidden and ignored ones and links."""
    files, folders = [], []
    try:
        found = sorted(os.scandir(os.path.join(root, folder.path)), key=lambda x: x.name)
    except OSError:
        return [], []
    names = {x.name for x in found}
    ignored = folder.ignored
    for name in (".gitignore", ".ignore"):
        if name in names:
            ignored = ignored.within(folder.path, config.read_text(os.path.join(root, folder.path, name)))
    for entry in found:
        path = f"{folder.path}/{entry.name}" if folder.path else entry.name
        if entry.name.startswith(".") or entry.is_symlink():
            continue
        if entry.is_dir(follow_symlinks=False):
            if not ignored(path, True):
                folders.append(_Folder(path, ignored))
        elif entry.is_file(follow_symlinks=False) and entry.name.rpartition(".")[2] in EXTENSIONS and "." in entry.name and not ignored(path, False):
            files.append(path)
    return files, folders


def _read(root: str, path: str) -> tuple:
    """A row of SCANNED. A name that isn't UTF-8 is written as near as that goes."""
    whole, shown = os.path.join(root, path), os.fsencode(path).decode("utf-8", "replace")
    when = config.modified(whole)
    try:
        if os.stat(whole).st_size > MOST_BYTES:
            return shown, None, None, when, "skipped"
        with open(whole, "rb") as file:
            data = file.read()
        return shown, data.decode("utf-8"), hashlib.sha256(data).hexdigest(), when, "read"
    except (OSError, UnicodeDecodeError):
        return shown, None, None, when, "errored"


def walked(spark: SparkSession, root: str, spread: int = 64, size: int = 32 << 20) -> DataFrame:
    """Files of a path. The driver goes down until it knows ``spread`` folders, tasks go on from there; a task holds
    ``size`` bytes of files at a time."""
    reachable(spark)
    files: list[str] = []
    folders = [_Folder("", config.Ignored())]
    while folders and len(folders) < spread:
        level, folders = folders, []
        for folder in level:
            some, below = _look(root, folder)
            files += some
            folders += below
    work: list = [folders[k::spread] for k in range(min(spread, len(folders)))] + [files[k::spread] for k in range(min(spread, len(files)))]
    schema = pa.schema([("file_path", pa.string()), ("content", pa.string()), ("file_hash", pa.string()), ("mtime_epoch", pa.int64()), ("outcome", pa.string())])

    def paths(items: list) -> Iterator[str]:
        stack = list(reversed(items))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                some, below = _look(root, item)
                yield from some
                stack += reversed(below)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, held = [], 0
                for path in paths(work[k]):
                    rows.append(_read(root, path))
                    held += len(rows[-1][1] or "")
                    if held > size:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.range(len(work)).repartition(max(1, len(work)), "id").mapInArrow(run, SCANNED)


def compare(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, outcome): new, changed, unchanged or orphan, by content hash."""
    both = indexed.select("file_path", F.col("file_hash").alias("old")).join(current.select("file_path", F.col("file_hash").alias("new")), "file_path", "full_outer")
    return both.select("file_path", F.when(F.col("new").isNull(), "orphan").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged").alias("outcome"))


def decide(indexed: DataFrame, scanned: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, outcome) of an index run: process, unchanged, skipped, errored or orphan. What is on disk is no
    orphan, even if it can't be read."""
    old = indexed.select("file_path", F.col("file_hash").alias("old"))
    both = old.join(scanned.select("file_path", "file_hash", F.col("outcome").alias("scan")), "file_path", "full_outer")
    process = F.lit(True) if force else ~F.col("old").eqNullSafe(F.col("file_hash"))
    return both.select("file_path", F.when(F.col("scan").isNull(), "orphan").when(F.col("scan") != "read", F.col("scan")).when(process, "process").otherwise("unchanged").alias("outcome"))


def outcomes(decided: DataFrame) -> dict[str, int]:
    found = {r["outcome"]: r["n"] for r in decided.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    return {k: found.get(k, 0) for k in ("process", "unchanged", "skipped", "errored", "orphan")}


def dry_run(indexed: DataFrame, scanned: DataFrame, force: bool = False) -> dict[str, int]:
    """What an index run would do, without doing it."""
    n = outcomes(decide(indexed, scanned, force))
    total = n["process"] + n["unchanged"] + n["skipped"] + n["errored"]
    return {"files_to_process": n["process"], "files_to_skip": n["unchanged"] + n["skipped"], "total_files": total, "files_errored": n["errored"], "orphans_to_remove": n["orphan"]}


def prepared(files: DataFrame, parsed: DataFrame, patterns: list[Pattern]) -> tuple[DataFrame, DataFrame]:
    """(chunks, context) of parsed files, given (file_path, file_hash, source_kind, mtime_epoch) of all."""
    facts = files.select("file_path", "file_hash", "source_kind", "mtime_epoch")
    rows = chunking.identified(chunking.chunk_rows(parsed)).join(facts.drop("mtime_epoch"), "file_path")
    chunks = rows.withColumn("injection_flags", flags(F.col("content"), patterns)).drop("ordinal", "parent")
    context = parsed.select("file_path", "imports_text").join(facts.drop("source_kind"), "file_path")
    return fulltext.indexed(chunks), context


def run(store: Store, scanned: DataFrame, patterns: list[Pattern], aliases: list[tuple[str, str]] | None = None, crate: str | None = None, force: bool = False) -> dict[str, int]:
    """One index run: changed files are chunked and resolved, their rows replaced, those of files that are gone
    dropped. Other files' rows, and edges into a changed file, stay. A file without chunks is skipped and keeps
    what it had. Returns counters."""
    scanned = materialize(scanned, "scanned")
    decided = materialize(decide(store.read("context"), scanned, force), "decided")
    files = scanned.join(decided.where("outcome = 'process'").select("file_path"), "file_path", "left_semi")
    parsed = materialize(chunking.parsed(files, crate).where(F.size("chunks") > 0), "parsed")
    chunks, context = prepared(files, parsed, patterns)
    edges = chunking.resolve(chunking.imports_of(parsed), scanned, aliases, crate)
    done = parsed.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks")).first()
    n = outcomes(decided)
    if done["files"] or n["orphan"]:
        gone = parsed.select("file_path").unionByName(decided.where("outcome = 'orphan'").select("file_path"))
        store.replace(gone, {"chunks": chunks, "context": context, "edges": edges}, last_indexed_at=datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), covered=True)
    skipped = n["unchanged"] + n["skipped"] + n["process"] - done["files"]
    return {"files_processed": done["files"], "chunks_created": done["chunks"], "files_skipped": skipped, "files_errored": n["errored"]}
