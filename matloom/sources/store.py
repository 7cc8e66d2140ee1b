"""A store of named matrices: Parquet tables under one folder of any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.functions.options import resolve
from matloom.matrix import Matrix
from matloom.operators.subset import assign_cells, last_cells, patch_of


class Store:
    """Paths are ``group[/group]/dataset``. A dataset has its cells, its shape and attributes, and tables of labels."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str, *more: str) -> str:
        parts = path.strip("/").split("/")
        if len(parts) < 2 or not all(parts) or any(p.startswith(("_", ".")) for p in parts):
            raise ValueError(f"{path!r} is not group/dataset")
        return "/".join([self.folder, *parts, *more])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(self._at(path, "_meta")))

    def create_group(self, group: str) -> None:
        self._fs.mkdirs(self._path(f"{self.folder}/{group.strip('/')}"))

    def _write_meta(self, path: str, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(self._at(path, "_meta"))

    def _meta(self, path: str) -> dict:
        if not self.exists(path):
            raise FileNotFoundError(path)
        return json.loads(self.spark.read.text(self._at(path, "_meta")).first()[0])

    def write(self, path: str, m: Matrix, *, overwrite: bool = False, compression: str | None = None, attributes: dict | None = None) -> Matrix:
        """Write a matrix and return it as read from the store."""
        if self.exists(path):
            if not overwrite:
                raise FileExistsError(path)
            self.remove(path)
        codec = resolve("compression", compression, "zstd")
        m.df.write.option("compression", codec).parquet(self._at(path, "_cells"))
        for side, labels in (("rows", m.row_labels), ("cols", m.col_labels)):
            if labels is not None:
                labels.write.parquet(self._at(path, f"_{side}"))
        self._write_meta(path, {"nrow": m.nrow, "ncol": m.ncol, "layout": m.layout, "attributes": attributes or {}})
        return self.open(path)

    def append(self, path: str, m: Matrix, *, by_cols: bool = False) -> Matrix:
        """Rows (or columns, if cells are stored one by one) behind the dataset's; what is there isn't rewritten."""
        meta = self._meta(path)
        old = self.open(path)
        if (old.nrow != m.nrow) if by_cols else (old.ncol != m.ncol):
            raise ValueError("non-conformable")
        if by_cols and old.layout != "coo":
            raise ValueError("columns can be appended to the coo layout only")
        m = {"coo": m.to_coo, "rows": m.to_rows, "wide": m.to_wide}[old.layout]()
        df = m.df.withColumn("j", (F.col("j") + old.ncol).cast("int")) if by_cols else m.df.withColumn("i", F.col("i") + old.nrow)
        df.write.mode("append").parquet(self._at(path, meta.get("cells", "_cells")))
        self._write_meta(path, meta | ({"ncol": old.ncol + m.ncol} if by_cols else {"nrow": old.nrow + m.nrow}))
        return self.open(path)

    def open(self, path: str, *, version: int | None = None) -> Matrix:
        """The dataset with the cells assigned up to ``version`` (all by default; 0: as written) merged while it is read.

        The plan is the same however many assignments there were: one scan of their cells, one aggregation, one join."""
        meta = self._meta(path)
        labels = [self.spark.read.parquet(self._at(path, s)) if self._fs.exists(self._path(self._at(path, s))) else None for s in ("_rows", "_cols")]
        m = Matrix(self.spark.read.parquet(self._at(path, meta.get("cells", "_cells"))), meta["nrow"], meta["ncol"], meta["layout"], *labels)
        base, latest = meta.get("base", 0), meta.get("version", 0)
        wanted = latest if version is None else version
        if not base <= wanted <= latest:
            raise ValueError(f"{path!r} has the versions {base} to {latest}")
        if wanted == base:
            return m
        patches = self.spark.read.schema("i long, j int, w double, version int").parquet(self._at(path, "_patches"))
        return assign_cells(m, patches.where(F.col("version").between(base + 1, wanted)).withColumnRenamed("version", "at"))

    def versions(self, path: str) -> tuple[int, int]:
        """The oldest and the newest version that can be opened."""
        meta = self._meta(path)
        return meta.get("base", 0), meta.get("version", 0)

    def assign(self, path: str, rows, cols, value) -> Matrix:
        """``m[rows, cols] = value`` in the store: the cells alone are written."""
        return self.assign_cells(path, patch_of(self.open(path), rows, cols, value))

    def assign_cells(self, path: str, patch: DataFrame) -> Matrix:
        """Cells ``i, j, w`` of any number as the dataset's next version. Of several values for one cell the one with the
        largest ``at`` counts, if there is such a column, then the largest; a cell without a value becomes NaN."""
        meta = self._meta(path)
        version, order = meta.get("version", 0) + 1, ["at"] if "at" in patch.columns else []
        held = patch.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(float("nan"))).alias("w"), *order)
        # a version that isn't in the description yet is what an interrupted job left
        last_cells(held, *order).write.mode("overwrite").parquet(self._at(path, "_patches", f"version={version}"))
        self._write_meta(path, meta | {"version": version})
        return self.open(path)

    def compact(self, path: str) -> Matrix:
        """Write the newest version as the dataset's cells; older versions, and handles on them, end."""
        meta = self._meta(path)
        base, latest = self.versions(path)
        if base == latest:
            return self.open(path)
        before, after = meta.get("cells", "_cells"), f"_cells-{latest}"
        self.open(path).df.write.mode("overwrite").option("compression", resolve("compression", None, "zstd")).parquet(self._at(path, after))
        self._write_meta(path, meta | {"cells": after, "base": latest})
        for old in (before, "_patches"):
            self._fs.delete(self._path(self._at(path, old)), True)
        return self.open(path)

    def list(self, group: str = "", *, recursive: bool = True, prefix: str = "") -> DataFrame:
        """``name, nrow, ncol`` of the datasets under a group."""
        found: list[str] = []

        def walk(folder: str, name: str, deep: bool) -> None:
            path = self._path(folder)
            if not self._fs.exists(path):
                return
            inner = [s.getPath().getName() for s in self._fs.listStatus(path) if s.isDirectory()]
            if "_meta" in inner:
                found.append(name)
            for x in inner:
                if not x.startswith(("_", ".")) and (deep or name == group.strip("/")):
                    walk(f"{folder}/{x}", f"{name}/{x}".strip("/"), recursive)

        walk(f"{self.folder}/{group.strip('/')}".rstrip("/"), group.strip("/"), recursive)
        rows = [(n, m["nrow"], m["ncol"]) for n in sorted(found) if n.rsplit("/", 1)[-1].startswith(prefix) for m in [self._meta(n)]]
        return self.spark.createDataFrame(rows, "name string, nrow long, ncol long")

    def move(self, old: str, new: str, *, overwrite: bool = False) -> None:
        if self._at(old) == self._at(new):
            raise ValueError("the same path")
        self._meta(old)
        if self.exists(new):
            if not overwrite:
                raise FileExistsError(new)
            self.remove(new)
        self._fs.mkdirs(self._path(self._at(new)).getParent())
        self._fs.rename(self._path(self._at(old)), self._path(self._at(new)))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(self._at(path)), True)

    def copy_to(self, path: str, other: "Store", new: str | None = None, *, overwrite: bool = False) -> Matrix:
        return other.write(new or path, self.open(path), overwrite=overwrite, attributes=self.attributes(path))

    def attributes(self, path: str) -> dict:
        return self._meta(path)["attributes"]

    def set_attribute(self, path: str, name: str, value: str | int | float) -> None:
        meta = self._meta(path)
        meta["attributes"][name] = value
        self._write_meta(path, meta)

    def set_labels(self, path: str, rows: list[str] | None = None, cols: list[str] | None = None) -> Matrix:
        """Replace both sides' names."""
        labelled = self.open(path).with_labels(rows, cols)
        for side, labels in (("_rows", labelled.row_labels), ("_cols", labelled.col_labels)):
            self._fs.delete(self._path(self._at(path, side)), True)
            if labels is not None:
                labels.write.parquet(self._at(path, side))
        return self.open(path)
