"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where the session has none, which is so only in local tests, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="linkloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Written tables that cut lineage: an executor that is lost later costs nothing that is already in one.

    On leaving the block the scratch tables are removed; those of ``keep`` stay, since a result is read from them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.scratch: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
        if not keep:
            self.scratch.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self.save(df, name, keep=True)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_) -> None:
        for path in self.scratch:
            self.drop(path)
