"""Tables written between the stages of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in spark.checkpoint.dir.

    Only where that setting is absent and the master is one machine (tests) a
    temporary folder is made, and the setting is then kept for the session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="axiomata-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/axiomata/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs no more than the tasks that were
    running on it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: a small file of one row group would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a task sorts or groups, about.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt by ``keys`` to partitions of about ``TASK_ROWS`` each.

    Adaptive execution merges the partitions of other shuffles by their
    compressed bytes until there are about as many as cores, so that what a
    task holds would grow with the table; it leaves a given number as it is.
    """
    return df.repartition(max(ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


class Levels:
    """A table that grows by a written level each round; a plan over it reads one folder, however many rounds there were."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.number, self.schema = spark, new_folder(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next level and return it."""
        path = f"{self.folder}/round={self.number}"
        df.write.parquet(path)
        self.number, self.schema = self.number + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """All levels so far."""
        return self.spark.read.schema(self.schema).parquet(self.folder).select(self.schema.names)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
