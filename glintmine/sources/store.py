"""The tables of an index as Parquet, in buckets by file; a manifest, written last, says which files are current."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaMismatch, StoreError

VERSION = 11
#: The tables, each with the column that names the file a row belongs to.
TABLES = {
    "chunks": ("file_path", "file_path string, chunk_type string, name string, content string, start_line int, end_line int, chunk_id long, parent_chunk_id long, file_hash string, source_kind string, "
               "injection_flags array<string>, fts_name string, fts_content string, fts_file_path string, fts_size int"),
    "context": ("file_path", "file_path string, imports_text string, file_hash string, mtime_epoch long"),
    "edges": ("source_file", "source_file string, target_file string, symbol_name string, ref_kind string"),
    "vecs": ("file_path", "file_path string, chunk_id long, sub_idx int, embedding array<float>"),
}
MANIFEST = "number long, version int, last_indexed_at string, layout string"


class Store:
    """Rows lie in ``buckets`` by the hash of their file. An update writes the buckets that it touches to a folder of
    its own and then a manifest row that names the folder of each bucket, so readers see all of an update or
    nothing, and files that don't change are not written again. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def manifest(self) -> dict | None:
        """The current manifest row of this schema version; None for a new store and for one of another version, which
        has to be built anew."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").where(F.col("version") == VERSION).orderBy(F.desc("number")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise StoreError(f"can't open {self.root}: {e}") from e
        return rows[0].asDict() | {"layout": json.loads(rows[0]["layout"])} if rows else None

    def last_indexed_at(self) -> str | None:
        return (self.manifest() or {}).get("last_indexed_at")

    def read(self, table: str, required: tuple[str, ...] | None = None) -> DataFrame:
        """A table as it is now, empty in a new store. ``required`` columns (all, if not given) that its files lack are an
        error that names them."""
        schema = self.spark.createDataFrame([], TABLES[table][1])
        layout = ((self.manifest() or {"layout": {}})["layout"]).get(table, {})
        if not layout:
            return schema
        found = self.spark.read.parquet(*[f"{self.root}/{run}/{table}/bucket={b}" for b, run in sorted(layout.items())])
        if missing := sorted(set(schema.columns if required is None else required).difference(found.columns)):
            raise SchemaMismatch(f"{table} lacks the columns {', '.join(missing)}")
        return found.select([c for c in schema.columns if c in found.columns])

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def replace(self, gone: DataFrame, rows: dict[str, DataFrame], last_indexed_at: str | None = None, covered: bool = False) -> None:
        """Drops the rows of files in ``gone`` (file_path) from every table, and adds ``rows``. ``covered``: all rows are
        of files in ``gone``, so that they needn't be read to know the buckets."""
        now = self.manifest() or {"number": 0, "last_indexed_at": None, "layout": {}}
        keys = gone.select("file_path").distinct()
        touched = keys.select(self._bucket("file_path").alias("b"))
        for table, df in rows.items() if not covered else ():
            touched = touched.unionByName(df.select(self._bucket(TABLES[table][0]).alias("b")))
        wanted = {str(r["b"]) for r in touched.distinct().collect()}  # at most as many as there are buckets
        run, layout = f"run={uuid.uuid4().hex}", {t: dict(x) for t, x in now["layout"].items()}

        def write(table: str) -> list[str] | None:
            key, schema = TABLES[table]
            old = [f"{self.root}/{r}/{table}/bucket={b}" for b, r in sorted(layout.get(table, {}).items()) if b in wanted]
            parts = [self.spark.read.parquet(*old).join(keys.withColumnRenamed("file_path", key), key, "left_anti")] if old else []
            parts += [rows[table]] if table in rows else []
            if not parts:
                return None
            columns = self.spark.createDataFrame([], schema).columns
            whole = reduce(DataFrame.unionByName, [p.select(columns) for p in parts])
            dealt = whole.withColumn("bucket", self._bucket(key)).repartition("bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{run}/{table}")
            return self._buckets_of(f"{self.root}/{run}/{table}")

        with ThreadPoolExecutor(len(TABLES)) as pool:  # tables are written side by side
            written = dict(zip(TABLES, pool.map(write, TABLES), strict=True))
        for table, buckets in written.items():
            if buckets is not None:
                layout[table] = {b: r for b, r in layout.get(table, {}).items() if b not in wanted} | {b: run for b in buckets}
        row = (now["number"] + 1, VERSION, last_indexed_at or now["last_indexed_at"], json.dumps(layout))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def append(self, table: str, rows: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], "file_path string"), {table: rows})

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _buckets_of(self, path: str) -> list[str]:
        fs, where = self._folder(path)
        return [name.partition("=")[2] for x in fs.listStatus(where) if (name := x.getPath().getName()).startswith("bucket=")]

    def vacuum(self) -> int:
        """Deletes the folders of runs that the current manifest doesn't name; how many."""
        now = self.manifest()
        used = {run for x in (now or {"layout": {}})["layout"].values() for run in x.values()}
        fs, where = self._folder(self.root)
        old = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("run=") and x.getPath().getName() not in used] if now else []
        for path in old:
            fs.delete(path, True)
        return len(old)
