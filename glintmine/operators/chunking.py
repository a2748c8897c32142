"""Files to chunks and import edges, by one Arrow pass, and the text that goes to an embedder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunkers import chunk_file
from ..session import reachable

FILES = "file_path string, imports_text string, chunks array<struct<ordinal:int,chunk_type:string,name:string,content:string,start_line:int,end_line:int,parent:int>>, imports array<struct<source:string,name:string,kind:string>>"
_CHUNK = pa.struct([("ordinal", pa.int32()), ("chunk_type", pa.string()), ("name", pa.string()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent", pa.int32())])
_IMPORT = pa.struct([("source", pa.string()), ("name", pa.string()), ("kind", pa.string())])


def parsed(files: DataFrame, crate: str | None = None) -> DataFrame:
    """FILES of (file_path, content): chunks, imports and the text of the import statements of each file, by one pass.
    An import without names is one side-effect reference. Files without content have no row."""
    reachable(files.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if not text:
                    continue
                texts: list[str] = []
                chunks, found = chunk_file(text, path.rpartition(".")[2], crate, texts)
                cs = [{"ordinal": k, "chunk_type": c.chunk_type, "name": c.name, "content": c.content, "start_line": c.start_line, "end_line": c.end_line, "parent": c.parent} for k, c in enumerate(chunks)]
                ims = [{"source": i.source, "name": n, "kind": k} for i in found for n, _, k in (i.specifiers or [(None, None, "side_effect")])]
                rows.append((path, "\n".join(texts), cs, ims))
            if rows:
                paths, statements, chunks, imports = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(statements, pa.string()), pa.array(chunks, pa.list_(_CHUNK)), pa.array(imports, pa.list_(_IMPORT))], names=["file_path", "imports_text", "chunks", "imports"])

    return files.select("file_path", "content").where("file_path is not null").mapInArrow(run, FILES)


def chunk_rows(files: DataFrame) -> DataFrame:
    """Chunks of parsed() files; ``parent`` is an earlier ordinal of the same file."""
    return files.select("file_path", F.explode("chunks").alias("c")).select("file_path", "c.*")


def chunk_files(files: DataFrame, crate: str | None = None) -> DataFrame:
    return chunk_rows(parsed(files, crate))


def identified(chunks: DataFrame) -> DataFrame:
    """Adds stable ids: chunk_id of (file, ordinal) and the parent's, without a join."""
    key = lambda n: F.xxhash64("file_path", n)
    return chunks.withColumns({"chunk_id": key(F.col("ordinal")), "parent_chunk_id": F.when(F.col("parent").isNotNull(), key(F.col("parent")))})


def import_rows(files: DataFrame, crate: str | None = None) -> DataFrame:
    return imports_of(parsed(files, crate))


def imports_of(files: DataFrame) -> DataFrame:
    """(source_file, source, name, kind) of parsed() files."""
    return files.select(F.col("file_path").alias("source_file"), F.explode("imports").alias("i")).select("source_file", "i.*")


# What a script import may leave out, and what it may name.
PROBED = ("tsx", "ts", "jsx", "js")
NAMED = (*PROBED, "css", "html")


def resolve(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None, crate: str | None = None) -> DataFrame:
    """Edges from import rows by joining candidate paths with the list of files: of an import's candidates the
    first that is a file wins; imports without one are dropped."""
    rust = F.col("source_file").endswith(".rs")
    paths = F.when(rust, rust_candidates(crate)).otherwise(script_candidates(aliases or []))
    each = imports.select("source_file", "source", F.posexplode(paths).alias("rank", "target_file")).distinct()
    known = files.select(F.col("file_path").alias("target_file")).distinct()
    first = each.join(known, "target_file").groupBy("source_file", "source").agg(F.min_by("target_file", "rank").alias("target_file"))
    return imports.join(first, ["source_file", "source"]).select("source_file", "target_file", F.col("name").alias("symbol_name"), F.col("kind").alias("ref_kind"))


def script_candidates(aliases: list[tuple[str, str]]) -> Column:
    """Paths that a script's import may mean, best first: the file itself if its extension is of a kind that is
    looked for, the name with another extension, and index files of a folder. The first alias (prefix, target) that
    fits is replaced, once; names that no alias has and that aren't relative are packages, and have none."""
    source = F.col("source")
    folder = F.regexp_replace("source_file", r"(^|/)[^/]*$", "")
    path = F.when(source.startswith("."), F.concat_ws("/", F.when(folder != "", folder), source))
    for prefix, target in reversed(aliases):
        path = F.when(source.startswith(prefix), F.concat(F.lit(target), F.substring(source, len(prefix) + 1, F.length(source)))).otherwise(path)
    whole = _collapsed(path)
    plain = F.regexp_replace(whole, r"(?<=[^/])\.[^./]*$", "")
    itself = F.when(whole.rlike(r"\.(" + "|".join(NAMED) + r")$"), F.array(whole)).otherwise(F.array().cast("array<string>"))
    inside = F.when(whole == "", F.lit("")).otherwise(F.concat(whole, F.lit("/")))
    others = [F.concat(plain, F.lit(f".{x}")) for x in PROBED] + [F.concat(inside, F.lit(f"index.{x}")) for x in PROBED]
    return F.when(whole.isNotNull(), F.concat(itself, F.array(*others)))


def rust_candidates(crate: str | None = None) -> Column:
    """Paths that a Rust path may mean, best first: the module's file, its folder's mod.rs, then those of the path
    without its last part, which may be a symbol. Paths start at the crate (also by its own name), at the module itself
    or at modules above it; all others, and paths above the root, have none."""
    parts = F.split("source", "::")
    inside = F.split(F.regexp_replace("source_file", r"^src/", ""), "/")
    stem = F.regexp_replace(F.element_at(inside, -1), r"\.[^.]*$", "")
    folders = F.slice(inside, 1, F.size(inside) - 1)
    none = F.array().cast("array<string>")
    module = F.when(stem.isin("lib", "main"), none).when(stem == "mod", folders).otherwise(F.concat(folders, F.array(stem)))
    ups = F.floor((F.length(F.regexp_extract("source", r"^(super(::|$))+", 0)) + 2) / 7).cast("int")
    head = parts[0]
    at_root = head.isin("crate", *([crate] if crate else []))
    base = F.when(at_root, none).when(head == "self", module).when((head == "super") & (ups <= F.size(module)), F.slice(module, 1, F.greatest(F.size(module) - ups, F.lit(0))))
    rest = F.when(head == "super", F.slice(parts, ups + 1, F.size(parts))).otherwise(F.slice(parts, 2, F.size(parts)))
    files = lambda x: F.array(F.concat(F.lit("src/"), F.array_join(x, "/"), F.lit(".rs")), F.concat(F.lit("src/"), F.array_join(x, "/"), F.lit("/mod.rs")))
    whole = F.concat(base, rest)
    shorter = F.when(F.size(whole) > F.greatest(F.size(base), F.lit(1)), files(F.slice(whole, 1, F.size(whole) - 1))).otherwise(none)
    roots = F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))
    return F.when(base.isNotNull(), F.when(F.size(whole) == 0, roots).when(F.size(rest) == 0, files(base)).otherwise(F.concat(files(whole), shorter)))


def _collapsed(path: Column) -> Column:
    """``path`` without . and .. parts; null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>")))
    return F.when(up.isNotNull(), F.array_join(up, "/"))


def enriched(imports: Column, parent: Column) -> Column:
    """A chunk's text for an embedder: a header of // lines, then the content."""
    line = lambda label, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"// {label}: "), value, F.lit("\n")))
    lines = F.when(imports == "", "").otherwise(F.concat(F.array_join(F.transform(F.split(imports, "\n"), lambda x: F.concat(F.lit("// "), x)), "\n"), F.lit("\n")))
    return F.concat(line("File", F.col("file_path")), line("Type", F.col("chunk_type")), line("Name", F.col("name")), line("Parent", parent), lines, F.col("content"))
