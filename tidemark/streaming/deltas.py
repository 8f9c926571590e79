"""Fact changes as a stream: each micro-batch becomes one version of a relation on disk, once.

A change is a row of the relation with `op` ('upsert' or 'retract'). Versions are folders named by micro-batch,
complete when their marker exists, so a batch delivered again after a failure is recognised and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import schema

KEY = ("corpus", "source", "native_id")


class Versions:
    def __init__(self, spark: SparkSession, path: str, relation: str):
        self.spark, self.path, self.relation = spark, path.rstrip("/"), relation
        self._path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        at = self._path("done")
        return max([-1, *(int(x.getPath().getName()) for x in self._fs.listStatus(at))]) if self._fs.exists(at) else -1

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], schema.schema(self.relation))
        return self.spark.read.schema(schema.schema(self.relation)).parquet(f"{self.path}/v{version}")

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """One version from the last and the newest change of each key; False if the batch is known."""
        if batch <= self.latest():
            return False
        order = [F.col(c).desc() for c in ("seq",) if c in changes.columns] or [F.lit(1)]
        newest = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_n = 1")
        kept = self.read().join(newest.select(*KEY), list(KEY), "left_anti").select(*schema.fields(self.relation))
        rows = kept.unionByName(schema.conform(self.relation, newest.where("op = 'upsert'")))
        rows.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        self._fs.mkdirs(self._path("done"))
        self._fs.createNewFile(self._path(f"done/{batch}"))
        return True


def follow(changes: DataFrame, versions: Versions, checkpoint: str, **trigger):
    """A streaming query that applies every micro-batch of changes."""
    return changes.writeStream.foreachBatch(lambda df, i: versions.apply(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
