"""Intermediate results that later stages read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from matloom.functions.options import resolve


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, a temporary folder in local runs and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="matloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """A table that every step replaces: the one before is deleted once the new one is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.path = spark, name, ""

    def put(self, df: DataFrame) -> DataFrame:
        path, before = f"{shared_folder(self.spark)}/matloom/{self.name}-{uuid.uuid4().hex}", self.path
        df.write.parquet(path)
        self.path = path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        if self.path:
            remove(self.spark, self.path)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/matloom/{name}-{uuid.uuid4().hex}"
    codec = resolve("compression")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
