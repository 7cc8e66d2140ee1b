"""Running column statistics of a stream of rows, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_col_stats(stream: DataFrame, columns: list[str]) -> DataFrame:
    """``j, n, sum, mean, sd`` of each column over all rows so far (output mode complete or update).

    The state is a few numbers for each column, whatever the stream's length."""
    cells = stream.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])).alias("x")).select("x.*")
    return cells.groupBy("j").agg(F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def windowed_col_stats(stream: DataFrame, columns: list[str], time: str, window: str, late: str) -> DataFrame:
    """The same by time windows; rows later than ``late`` behind the newest are passed over. A time without a zone is read
    in the session's."""
    cells = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(time).alias("t"), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])).alias("x"))
    return cells.groupBy(F.window("t", window), F.col("x.j").alias("j")).agg(F.count("x.v").alias("n"), F.avg("x.v").alias("mean"))
