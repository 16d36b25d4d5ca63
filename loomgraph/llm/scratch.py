"""Tables written to the cluster's shared folder, to cut lineage between the phases of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_opened: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one of our own on a local
    master, whose executors share it; an error on a cluster, where they wouldn't."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own[app]


class Scratch:
    """Intermediate Parquet tables of one job, each in a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
        self._n, self._tables = 0, []
        _opened.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    @contextmanager
    def _freeing(self) -> Iterator[None]:
        """While it lasts, the shuffle files of a finished write, which are of no further use, are deleted."""
        conf, was = self.spark.conf, self.spark.conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            conf.set(_CLEANUP, was)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table, so that a lost executor costs a read and no recomputation."""
        path = self.path(name)
        with self._freeing():
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def save_bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """As :meth:`save`, in as many buckets by ``column`` as a shuffle has partitions, so that joins and
        aggregations on it read the table as it lies."""
        path, table = self.path(name), f"scratch_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with self._freeing():
            df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
        self._tables.append(table)
        saved = self.spark.table(table)
        saved._scratch_path = path
        return saved

    def drop(self, table: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(table, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete all tables; plans that read them can't run any more."""
        for table in self._tables:
            self.spark.sql(f"drop table if exists {table}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def opened() -> list[Scratch]:
    """The scratch folders opened since the last call, for a caller that knows when their tables are of no further use."""
    out = list(_opened)
    _opened.clear()
    return out
