"""Tables written between the steps of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is missing."""
    files, where = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def read_file(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file, whole or not at all; False where it is there already."""
    files, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, where, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def dealt(table: DataFrame) -> DataFrame:
    """A table that grows with its web: a join with it deals both sides by key, and doesn't send it whole to the driver
    and from there to every task."""
    return table.hint("merge")


class Scratch:
    """A folder for one job's tables, under ``spark.checkpoint.dir``; where that is unset, under a temporary
    folder on a local master, and an error on a cluster, whose executors wouldn't share one."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = _own.setdefault(spark.sparkContext.applicationId, "")
            if not base:
                base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        self.spark, self.root, self.count = spark, f"{base.rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        """A place for a table of this job."""
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save(self, table: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: its plan ends here, and a lost executor costs a read."""
        path = self.path(name)
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)
