"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WRITE_BYTES = 256 << 20
#: Folders made, for each `last_kept` that is open.
_OPEN: list[list] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset one is chosen: a temporary
    folder if driver and executors are one process, else a subfolder of the warehouse."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    spark.conf.set(SETTING, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's file system closes."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at.getParent())
    for made in _OPEN:
        made.append((fs, at.getParent()))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage is cut, a lost executor costs
    no recomputation, and the planner knows the table's size. Some partitions share a writing task, so that tables
    have few files, with two tasks a core at least and by the planner's estimate WRITE_BYTES a task at most."""
    spark = df.sparkSession
    path = new_path(spark, name)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8, size // WRITE_BYTES)
    df.coalesce(min(tasks, 1 << 20)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def last_kept():
    """Removes the tables written inside when it ends, but for the last one: no frame may still read the others."""
    _OPEN.append([])
    try:
        yield
    finally:
        for fs, folder in _OPEN.pop()[:-1]:
            fs.delete(folder, True)


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts bounded by bytes, so that they fit small executors. Results don't depend on it. As
    plans run later, the setting stays; one that the session was given stays as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))
