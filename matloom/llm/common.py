"""What several text operators share: durable intermediate tables, ordered buckets of ids, folds of labels."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without one, a temporary folder in local
    runs and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matloom-")
        context.setCheckpointDir(found)
    return found


class Tables:
    """Intermediate tables of one job in the shared folder. Writing one cuts the lineage: a later loss of executors
    costs no recomputation. A table that no unfinished plan reads is deleted."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/matloom/{job}-{uuid.uuid4().hex}"
        self.written: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a new table and read it back."""
        path = f"{self.folder}/{len(self.written)}-{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.written[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def delete(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.written[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder."""
    return Tables(df.sparkSession, name).write(df, name)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with lines below it a name that no column of ``df`` has."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


class OrderedBuckets:
    """Splits the rows of a table into consecutive ranges of (key, tie), rows without a key first.

    The pair of numbers alone is range-partitioned by Spark, so ranges follow the rows, wherever the keys lie; the first
    and the last pair of each range reach the driver, one for about ``target`` rows but at most ``MOST`` of them. Rows
    with equal key and equal tie share a range.
    """

    MOST = 1 << 16

    def __init__(self, df: DataFrame, key: Column, tie: Column, target: int = 2000):
        pairs = df.select(key.isNotNull().cast("long").alias("there"), F.coalesce(key, F.lit(0)).cast("long").alias("key"), tie.cast("long").alias("tie"))
        self.rows = pairs.count()
        parts = max(1, min(self.MOST, self.rows // target))
        ranged = pairs.repartitionByRange(parts, "there", "key", "tie").groupBy(F.spark_partition_id().alias("part"))
        ends = ranged.agg(F.min(F.struct("there", "key", "tie")).alias("low"), F.max(F.struct("there", "key", "tie")).alias("high")).collect()
        #: of each range, in ascending order, its first and last (there, key, tie)
        self.ranges = sorted((tuple(r["low"]), tuple(r["high"])) for r in ends)
        self.key, self.tie = key, tie

    def __len__(self) -> int:
        return len(self.ranges)

    def place(self) -> tuple[Column, Column, Column]:
        return self.key.isNotNull().cast("long"), F.coalesce(self.key, F.lit(0)).cast("long"), self.tie.cast("long")

    def bucket(self) -> Column:
        """The number of a row's range, by binary search among the ranges' first pairs."""
        lows = [low for low, _ in self.ranges] or [(0, 0, 0)]
        columns = [F.split(F.lit(",".join(str(x[k]) for x in lows)), ",").cast("array<bigint>") for k in range(3)]
        there, key, tie = self.place()

        def reached(at: Column) -> Column:
            h, k, t = (F.element_at(c, at + 1) for c in columns)
            return (there > h) | ((there == h) & ((key > k) | ((key == k) & (tie >= t))))

        steps = [1 << k for k in reversed(range(max(1, (len(lows) - 1).bit_length())))]
        search = lambda at, step: F.when(F.when(at + step < F.lit(len(lows)), reached(at + step)).otherwise(F.lit(False)), at + step).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)


def fold(doc_id: str, folds: int):
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most ``rows`` rows, the same ones in every run: those with the lowest hash of ``key``."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


_cached: dict[str, Callable[[], None]] = {}


def own_cache(name: str, clear: Callable[[], None]) -> None:
    """Tell that this worker's memory now belongs to the cache ``name``: those of other operators, which ran in the
    worker before, are cleared."""
    others = [k for k in _cached if k != name]
    for other in others:
        _cached.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _cached[name] = clear


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for Python workers while a table is written; afterwards the session's size holds again."""
    before = spark.conf.getAll.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def texts_for_python(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python workers: in batches of 500 rows at most, unless the session sets a size.

    Texts may be long, and a batch is held on both sides. The size belongs to the session, so it stays set."""
    if _BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCH, "500")
    return df
