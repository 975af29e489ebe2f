"""Tables cut out of a plan: written to the folder the cluster shares, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Roots of scratch tables that are not deleted yet, oldest first, by application.
_ROOTS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one in local mode; on a cluster, whose executors don't share
    such a folder, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held(spark: SparkSession) -> int:
    """How many scratch roots there are, a mark for `release`."""
    return len(_ROOTS.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch tables of all operators called after the mark was taken. Call it when their results are written: a result
    that is not reads some of them."""
    roots = _ROOTS.get(spark.sparkContext.applicationId, [])
    while len(roots) > since:
        _delete(spark, roots.pop())


class Scratch:
    """Named Parquet tables of one run, under one new folder of the shared folder.

    A saved table cuts the lineage: a lost executor costs the tasks it ran, not the stages before. `release` deletes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            _delete(self.spark, self.path(name))
