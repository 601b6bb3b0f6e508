"""Cutting the lineage of iterative jobs so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The checkpoint folder, set up if it is not yet.

    The folder is the one the session names in spark.checkpoint.dir, which on
    a cluster is shared storage.  Only a local session may leave it unset.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to shared storage")
            folder = tempfile.mkdtemp(prefix="clausegraph-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into a new folder, `name` and a number, of the checkpoint folder and read it back."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, in whichever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """The state of an iterative job as a chain of Parquet folders of which only the last is kept.

    `step` writes a round's state and reads it back, so its lineage is a scan;
    the state before it, which nothing needs any more, is then removed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def step(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        if self.n:
            remove(self.spark, f"{self.folder}/{self.n - 1}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


class Staged:
    """A plan of named stages whose results are stored, so that a run that failed goes on where it stopped.

    A stage's table lies under the run's name in the checkpoint folder, or in
    `root`; the mark that Spark's writers leave last tells that it is whole.
    A stage that is whole is read, whatever its builder would do now, so a run
    belongs to one state of its inputs; `finish` removes it.
    """

    def __init__(self, spark: SparkSession, run: str, root: str | None = None):
        self.spark = spark
        self.folder = f"{root or scratch(spark)}/{run}"

    def _whole(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._whole(path):
            # what a killed write left behind is written over
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def finish(self) -> None:
        remove(self.spark, self.folder)
