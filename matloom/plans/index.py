"""Dense positions in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.plans.durable import durable


def with_position(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """``df`` with each row's position (from 0) by ``order``.

    Rows are range-partitioned and sorted; a task numbers its own rows, and the counts of the partitions before it (one
    number for each partition, all that reaches the driver) are added.
    """
    column = F.monotonically_increasing_id()
    local = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", column), "sorted")
    local = local.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    offsets, total = [], 0
    for row in sorted(local.groupBy("_part").count().collect()):
        offsets.append((row["_part"], total))
        total += row["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    return local.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")
