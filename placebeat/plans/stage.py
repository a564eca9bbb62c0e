"""Intermediate tables in shared storage.

Iterations and many-table jobs cut their lineage by writing an intermediate result once and reading it back. A
written table outlives lost executors, and its size on disk tells Spark whether it may be broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []
ROWS_PER_BUCKET = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and driver and executors are one process, a temporary folder, which goes when that process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="placebeat-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        return _own[0]
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


class Stage:
    """A folder of intermediate Parquet tables, one name each; usable as a context manager that removes it."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.path = f"{(folder or shared_folder(spark)).rstrip('/')}/stage-{uuid.uuid4().hex}"
        self._tables: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, name: str, frame: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write the frame, in a folder for each value of ``partition_by`` if that is given, and return a frame that reads it."""
        target = f"{self.path}/{name}"
        writer = frame.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(target)
        return self.spark.read.schema(frame.schema).parquet(target)

    def size_buckets(self, rows: int) -> None:
        """Buckets for tables of up to so many rows: one per ``ROWS_PER_BUCKET`` and one per core, at most the shuffle's partitions.

        A bucket is a task wherever it is read, and every aggregation after it writes a piece for each partition of its shuffle:
        with 200 of both that is 40,000 pieces each time, however few the rows. Call this before the first bucketed table.
        """
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(most, max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_BUCKET)))

    def write_bucketed(self, name: str, frame: DataFrame, by: str) -> DataFrame:
        """Write the frame in the stage's number of buckets of ``by``, a file each, and return a frame that reads it.

        That number is the shuffle's number of partitions, or what :func:`size_buckets` has found, and the same for all tables.

        Joins and aggregations by that column then read their side as it lies, whatever its size; what Spark knows of the buckets
        is kept in the session's catalog until the stage is closed.
        """
        table = f"{self.path.rpartition('/')[2].replace('-', '_')}_{name}"
        writer = frame.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).mode("errorifexists")
        writer.option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
