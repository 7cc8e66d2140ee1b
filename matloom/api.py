"""Every operation under one roof, by the names that users of R know.

A ``Matrix`` handle takes the place of a file's dataset, a ``Store`` that of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.functions.options import available_ram_mb, can_allocate, cpu_cores, get_options, may_collect, memory_info, memory_thresholds, recommended_threads, set_options, system_info, total_ram_mb
from matloom.matrix import Matrix, chain
from matloom.operators.aggregates import col_maxs as colMaxs
from matloom.operators.aggregates import col_means as colMeans
from matloom.operators.aggregates import col_mins as colMins
from matloom.operators.aggregates import col_sds as colSds
from matloom.operators.aggregates import col_sums as colSums
from matloom.operators.aggregates import col_vars as colVars
from matloom.operators.aggregates import mean, sd, summary, var
from matloom.operators.aggregates import row_maxs as rowMaxs
from matloom.operators.aggregates import row_means as rowMeans
from matloom.operators.aggregates import row_mins as rowMins
from matloom.operators.aggregates import row_sds as rowSds
from matloom.operators.aggregates import row_sums as rowSums
from matloom.operators.aggregates import row_vars as rowVars
from matloom.operators.batch import apply_function, apply_to_groups, map_blocks
from matloom.operators.blocks import chol_blocks, inverse_blocks, inverse_general, solve_blocks, solve_general
from matloom.operators.correlation import cor, ranks
from matloom.operators.elementwise import diag, diag_op, diag_scale, diagonal_matrix, scalar_product, scale, set_diag, sweep, vector_op
from matloom.operators.factor import cca, chol, eigen, inverse, ols, ols_of, pca, power_iteration, pseudoinverse, pseudoinverse_product, qr, solve, svd
from matloom.operators.genotype import filter_low_coverage, filter_maf
from matloom.operators.genotype import impute as impute_snps
from matloom.operators.jacobi import eigen_blocks
from matloom.operators.krylov import eigs, truncated_svd
from matloom.operators.products import crossprod, matmul, multiply_sparse, tcrossprod, weighted_product
from matloom.operators.reflectors import reflectors
from matloom.operators.restructure import bind_list, cbind, fill_triangle, permute, rbind, reduce, split
from matloom.operators.subset import assign, assign_cells, subset
from matloom.sources.store import Store
from matloom.sources.text import read_many as import_multiple
from matloom.sources.text import read_text as import_text

prcomp, split_dataset, sort_dataset = pca, split, permute


def create_matrix(store: Store, path: str, nrow: int, ncol: int, data=0.0, *, dtype: str = "double", overwrite: bool = False, compression: str | None = None) -> Matrix:
    """A matrix filled with ``data``, recycled down its columns, in the store."""
    return store.write(path, Matrix.create(store.spark, nrow, ncol, data, dtype), overwrite=overwrite, compression=compression)


def import_into(store: Store, source: str, path: str, *, overwrite: bool = False, **options) -> Matrix:
    """A text file as a dataset of the store."""
    return store.write(path, import_text(store.spark, source, **options), overwrite=overwrite)


def save(frame: DataFrame, store: Store, path: str, *, overwrite: bool = True) -> Matrix:
    """A statistic ``j|i|k, v`` as a dataset of one column."""
    key, value = frame.columns
    n = frame.count()
    return store.write(path, Matrix.from_coo(frame.select(F.col(key).alias("i"), F.lit(0).alias("j"), F.col(value).alias("v")), n, 1), overwrite=overwrite)


def reduce_group(store: Store, group: str, op: str = "+", *, pad: bool = True, remove: bool = False) -> Matrix:
    """The sum (or difference, in the order of their names) of all datasets of a group."""
    names = [r["name"] for r in store.list(group, recursive=False).orderBy("name").collect()]
    if not names:
        raise FileNotFoundError(group)
    total = reduce([store.open(n) for n in names], op, pad=pad)
    total = store.write(f"{group}_reduced/total", total, overwrite=True)
    for n in names if remove else []:
        store.remove(n)
    return total


def spark_session(app: str = "matloom", **conf: str) -> SparkSession:
    """A session with adaptive execution; other settings by name, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "F")]
