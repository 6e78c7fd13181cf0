"""Intermediate tables that outlive any executor.

Every cut of a lineage is a Parquet table below the folder named by
``spark.checkpoint.dir``, which driver and executors share.  Nothing is kept in
executor memory or on a machine's own disk, so a lost executor costs a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a session on one machine names none (tests)."""
    named = spark.conf.get(SETTING, None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


class Workspace:
    """A folder of written tables; removed when the driver ends, single tables earlier by :meth:`drop`."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lattiq/{label}-{uuid.uuid4().hex}"
        path = self._path("")
        self._fs(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def settle(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return what was written; its shuffle files go as soon as it stands."""
        at = f"{self.root}/{name}"
        before, rows = self.spark.conf.get(CLEANUP, "false"), self.spark.conf.get(BATCH)
        self.spark.conf.set(CLEANUP, "true")
        self.spark.conf.set(BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        try:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, before)
            self.spark.conf.set(BATCH, rows)
        return self.spark.read.schema(frame.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            self._fs(path).delete(path, True)


def parts(spark: SparkSession) -> int:
    """How many ways the session deals out a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
