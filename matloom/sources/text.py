"""Delimited text as matrices. Spark reads plain, gzip and bzip2 files, in parallel where they can be split."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from matloom.matrix import Matrix
from matloom.plans.index import with_position


def separator(path: str) -> str:
    """By the extension: a comma for csv, else a tab."""
    name = os.path.basename(path)
    for packed in (".gz", ".bz2"):
        name = name.removesuffix(packed)
    return "," if name.endswith(".csv") else "\t"


def read_text(spark: SparkSession, path: str, *, sep: str | None = None, header: bool = True, rownames: bool = False) -> Matrix:
    """All columns numeric (a cell that isn't fails the read); with ``rownames`` the first column holds names.

    Rows keep the order of the files' names and, within a file, of its lines: a line's place is its file, the byte at
    which its split begins, and its number within the split. Every file has its own header."""
    sep = sep or separator(path)
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("an empty file")
    names = [x.strip().strip('"') for x in first[0].split(sep)]
    if not header:
        names = [f"V{k + 1}" for k in range(len(names))]
    fields = [StructField(f"_{k}", StringType() if rownames and k == 0 else DoubleType()) for k in range(len(names))]
    table = spark.read.csv(path, sep=sep, header=header, schema=StructType(fields), mode="FAILFAST", enforceSchema=True)
    own = names[1:] if rownames else names
    values = F.array(*[F.col(f.name) for f in fields if isinstance(f.dataType, DoubleType)])
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line")]
    placed = with_position(table.select(*place, *([F.col("_0").alias("name")] if rownames else []), values.alias("vec")), ["_file", "_split", "_line"])
    m = Matrix(placed.select("i", "vec"), placed.count(), len(own), "rows")
    return m.with_labels(placed.select(F.col("i").alias("idx"), "name") if rownames else None, own)


def read_many(spark: SparkSession, paths: list[str], names: list[str], **options) -> dict[str, Matrix]:
    """By the last part of their names."""
    if len(paths) != len(names):
        raise ValueError("as many names as files")
    return {n.rsplit("/", 1)[-1]: read_text(spark, p, **options) for p, n in zip(paths, names)}


def write_text(m: Matrix, path: str, *, sep: str = ",", files: int | None = None) -> None:
    """A folder of files in row order, each with a header; about ``files`` of them if given."""
    wide = m.to_wide()
    rows = wide.df.orderBy("i") if files is None else wide.df.repartitionByRange(files, "i").sortWithinPartitions("i")
    rows.select(*wide.names).write.csv(path, sep=sep, header=True)
