"""Session helpers: a local session for tests and benches, and the worker path of this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the driver's files (local mode). On a cluster
    the package is shipped with ``--py-files`` or installed, and this entry of the path finds nothing."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a local master gets
    a folder of our own; on a cluster no machine's own folder will do, so that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found and (set_by_user := context._jsc.sc().getCheckpointDir()).isDefined():
        found = set_by_user.get()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glintmine-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: A file for so many bytes of input, and at least so many for each core.
FILE_BYTES, FILES_A_CORE = 8 << 20, 2


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than the bytes of the tables that it reads call for, so that small tables aren't
    written as a file for each of a shuffle's partitions: where Hadoop has no native library, each local file costs
    two processes (chmod), which show all of the executor's memory as their own until they run. For plans that
    make about as many bytes as they read; rows stay the same, large tables keep all their partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.length()))
    most = max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return df.coalesce(most) if most < 1 << 31 else df  # tables of unknown size count as huge


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and a lost executor costs no
    recomputation. The files go when the driver's Python ends (or by ``release``)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/glintmine/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if spark not in _written:
        _written[spark] = []
        atexit.register(_release_quietly, weakref.ref(spark))
    _written[spark].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that ``materialize`` wrote in this session."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def _release_quietly(ref) -> None:
    spark = ref()
    try:
        if spark is not None:
            release(spark)
    except Exception:  # the JVM may be gone when Python ends
        pass


def local_session(cpus: int = 8, name: str = "glintmine", **settings: str) -> SparkSession:
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": name,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | settings
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reachable(spark)
    return spark
