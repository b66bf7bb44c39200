"""Tables that iterative work writes on its way: they cut the lineage, and stand when executors are lost."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where executors are threads of the driver, and
    the setting is not there, it is made: a folder of this session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"tidemark-{spark.sparkContext.applicationId}")
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as read back from a folder of its own, which stays: for results whose sources go with the work they came from."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class Work:
    """Tables of one piece of work; dropped when it ends, each by itself when a later one takes its place."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        self._drop(self.folder)

    def write(self, df: DataFrame, instead: DataFrame | None = None, distinct: bool = False) -> DataFrame:
        """df as read back from where it now stands. `instead` is an earlier table of this work, which goes. distinct: of
        wide tables of doubles, for which looking for repeated values costs more than it saves."""
        path, schema = f"{self.folder}/{self.count}", df.schema
        df.write.option("parquet.enable.dictionary", not distinct).parquet(path)
        if instead is not None:
            self._drop(f"{self.folder}/{self.count - 1}")
        self.count += 1
        return self.spark.read.schema(schema).parquet(path)

    def _drop(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
