"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="docquarry-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


class Scratch:
    """A folder of its own for one run of an operator.

    A written table cuts the lineage: what is read again does not depend on the executors that
    made it, so that a lost executor costs only the tasks it was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows_per_batch: int | None = None, small: bool = False, share: int = 8) -> DataFrame:
        """Writes df and returns what is read again. Python workers get at most so many rows at once.

        A table that is a small part of the input is written by an eighth (or another share) of the usual tasks, so that it is not a great
        many files of a few rows where adaptive execution does not put partitions together.
        """
        if small:
            df = df.coalesce(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share))
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        if rows_per_batch:
            self.spark.conf.set(key, rows_per_batch)
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes the tables whose names begin with none of the given ones, and lets their shuffle files go."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(path):
            self.drop(*(name for x in files.listStatus(path) if not (name := x.getPath().getName()).startswith(names)))
        self.release()

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver's
        memory is collected."""
        self.spark._jvm.System.gc()
