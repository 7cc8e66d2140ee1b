"""Queries over the whole tables, one for each operator, each with the SQL that gives the same rows.

Matrices: ``li`` four measures of the line items (rows in no order); ``pt`` parts by key: size, retail price; ``em`` the
embeddings by id; ``sp`` quantities summed by supplier and line number; ``ge`` genotype codes made from part keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom import api
from matloom.exact_sql import inverted, rotated, two_sided, upper_factor
from matloom.matrix import Matrix
from matloom.operators import aggregates, batch, blocks, correlation, elementwise, factor, genotype, jacobi, krylov, products, reflectors, restructure, subset
from matloom.plans.durable import durable, shared_folder
from matloom.plans.index import with_position
from matloom.sources.store import Store
from matloom.sources.text import read_text, write_text
from matloom.streaming.colstats import running_col_stats, windowed_col_stats

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

LI = "li AS (SELECT CAST(l_quantity AS DOUBLE) AS c0, CAST(l_extendedprice AS DOUBLE) AS c1, l_discount + 0.0 AS c2, l_tax + 0.0 AS c3 FROM lineitem)"
LC = LI + ", lc AS (" + " UNION ALL ".join(f"SELECT {j} AS j, CAST(c{j} AS DOUBLE) AS v FROM li" for j in range(4)) + ")"
PT = "pt AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(p_size AS DOUBLE) AS c0, CAST(p_retailprice AS DOUBLE) AS c1 FROM part)"
PC = PT + ", pc AS (SELECT i, 0 AS j, c0 AS v FROM pt UNION ALL SELECT i, 1, c1 FROM pt)"
EM = "em AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), ec AS (SELECT i, CAST(k - 1 AS INTEGER) AS j, vec[k] AS v FROM em, range(1, 65) AS r(k))"
SP = "sp AS (SELECT dense_rank() OVER (ORDER BY l_suppkey) - 1 AS i, CAST(l_linenumber - 1 AS INTEGER) AS j, CAST(q AS DOUBLE) AS v FROM (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"
GE = "ge AS (SELECT i, CAST(j AS INTEGER) AS j, CAST(((p_partkey * 7 + j * 13 + (p_partkey // 3) * (j % 5)) % (2 + j % 4)) AS DOUBLE) AS v FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_partkey FROM part), range(20) AS r(j))"


# quantities by part and supplier: most cells are absent
PS = "ps AS (SELECT l_partkey AS i, CAST(l_suppkey AS INTEGER) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL), pn AS (SELECT max(l_partkey) + 1 AS n, max(l_suppkey) + 1 AS p FROM lineitem), pd AS (SELECT r.i AS i, CAST(c.j AS INTEGER) AS j, coalesce(ps.v, 0) AS v FROM (SELECT unnest(range((SELECT n FROM pn))) AS i) r CROSS JOIN (SELECT unnest(range((SELECT p FROM pn))) AS j) c LEFT JOIN ps ON ps.i = r.i AND ps.j = c.j)"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def li(spark: SparkSession, d: str) -> Matrix:
    t = _table(spark, d, "lineitem")
    return Matrix.from_columns(t.select(*[(F.col(c).cast("double") + 0.0).alias(c) for c in MEASURES]), MEASURES)


def pt(spark: SparkSession, d: str) -> Matrix:
    return Matrix.from_columns(_table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey")


def em(spark: SparkSession, d: str) -> Matrix:
    return Matrix.from_vectors(_table(spark, d, "embeddings"), "embedding", "vec_id")


def sp(spark: SparkSession, d: str) -> Matrix:
    sums = _table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    placed = with_position(sums.select("l_suppkey").distinct(), ["l_suppkey"])
    n = placed.count()
    return Matrix.from_coo(sums.join(placed, "l_suppkey").select("i", (F.col("l_linenumber") - 1).alias("j"), "v"), n, 7)


def ge(spark: SparkSession, d: str) -> Matrix:
    keys = with_position(_table(spark, d, "part").select("p_partkey"), ["p_partkey"])
    k, j = F.col("p_partkey"), F.col("j")
    cells = keys.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(19))))
    code = (k * 7 + j * 13 + F.floor(k / 3) * (j % 5)) % (2 + j % 4)
    return Matrix.from_coo(cells.select("i", "j", code.alias("v")), keys.count(), 20)


def ps(spark: SparkSession, d: str) -> Matrix:
    t = _table(spark, d, "lineitem")
    size = t.agg(F.max("l_partkey") + 1, F.max("l_suppkey") + 1).first()
    return Matrix.from_coo(t.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v")), *size)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c in columns})


def _cells(m: Matrix, digits: int = 6) -> DataFrame:
    return m.to_coo().df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.round(F.col("v") + 0.0, digits).alias("v"))


def _row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---- aggregates

_SQL_STAT = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "var": "var_samp(v)", "sd": "stddev_samp(v)"}
for _stat, _expr in _SQL_STAT.items():

    def _columns(spark, d, stat=_stat):
        return _rounded(aggregates.col_stats(li(spark, d), [stat]).select("j", F.col(stat).alias("v")), 4, "v")

    def _rows(spark, d, stat=_stat):
        return _rounded(aggregates.row_stats(em(spark, d), [stat]).select("i", F.col(stat).alias("v")), 6, "v")

    def _total(spark, d, stat=_stat):
        return _rounded(aggregates.total_stats(li(spark, d), [stat]).select(F.col(stat).alias("v")), 3, "v")

    for _name, _f, _q in (
        (f"col_{_stat}s", _columns, f"WITH {LC} SELECT j, round({_expr} + 0.0, 4) AS v FROM lc GROUP BY j"),
        (f"row_{_stat}s", _rows, f"WITH {EM} SELECT i, round({_expr} + 0.0, 6) AS v FROM ec GROUP BY i"),
        (f"total_{_stat}", _total, f"WITH {LC} SELECT round({_expr} + 0.0, 3) AS v FROM lc"),
    ):
        _queries[_name], _sql[_name] = _f, _q


@query(f"WITH {LC} SELECT j, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS var FROM lc GROUP BY j")
def entry_col_stats(spark, d):
    return _rounded(aggregates.col_stats(li(spark, d), ["mean", "var"]), 4, "mean", "var")


@query(f"WITH {PS} SELECT j, round(sum(v), 4) AS sum, round(avg(v), 4) AS mean, round(var_samp(v), 2) AS var, round(min(v), 4) AS min FROM pd GROUP BY j")
def col_stats_sparse(spark, d):
    return _rounded(_rounded(aggregates.col_stats(ps(spark, d), ["sum", "mean", "var", "min"]), 4, "sum", "mean", "min"), 2, "var")


@query(f"WITH {PS} SELECT i, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM (SELECT i, CASE WHEN v <> 7 THEN v END AS v FROM pd) GROUP BY i")
def row_stats_sparse_na_rm(spark, d):
    m = ps(spark, d).map_values(lambda v: F.when(v != 7, v).otherwise(F.lit(float("nan"))))
    return _rounded(aggregates.row_stats(m, ["mean", "max"], na_rm=True), 6, "mean", "max")


@query(f"WITH {EM} SELECT i, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM ec GROUP BY i")
def row_mean_sd(spark, d):
    return _rounded(aggregates.row_stats(em(spark, d), ["mean", "sd"]), 6, "mean", "sd")


@query(f"WITH {EM} SELECT j, round(avg(CASE WHEN (i * 7 + j) % 11 <> 0 THEN v END), 6) AS mean FROM ec GROUP BY j")
def col_means_na_rm(spark, d):
    return _rounded(aggregates.col_stats(_with_nan(em(spark, d)), ["mean"], na_rm=True), 6, "mean")


def _with_nan(m: Matrix) -> Matrix:
    cells = m.to_coo()
    return Matrix(cells.df.withColumn("v", F.when((F.col("i") * 7 + F.col("j")) % 11 != 0, F.col("v")).otherwise(F.lit(float("nan")))), *m.dim, "coo").to_rows()


# ---- element by element

for _name, _op in (("add", "+"), ("subtract", "-"), ("multiply", "*")):

    def _binary(spark, d, op=_op):
        a = pt(spark, d)
        return _cells(elementwise.binary(a, a.map_values(lambda x: x * 0.5 + 1.0), op), 4)

    _queries[f"elementwise_{_name}"] = _binary
    _sql[f"elementwise_{_name}"] = f"WITH {PC} SELECT i, j, round(v {_op} (v * 0.5 + 1.0), 4) AS v FROM pc"


@query(f"WITH {PC} SELECT i, j, CASE WHEN v % 5 = 0 THEN (CASE WHEN v - 5 = 0 THEN 'nan' WHEN v - 5 > 0 THEN 'inf' ELSE '-inf' END) ELSE CAST(CAST(floor((v - 5) / (v % 5) * 1000 + 0.5) AS BIGINT) AS VARCHAR) END AS v FROM pc")
def elementwise_divide(spark, d):
    a = pt(spark, d)
    m = elementwise.binary(a.map_values(lambda x: x - 5.0), a.map_values(lambda x: x % 5.0), "/").to_coo()
    v = F.col("v")
    told = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(F.floor(F.when(F.abs(v) < 1e15, v).otherwise(0.0) * 1000 + 0.5).cast("string"))
    return m.df.select("i", F.col("j").cast("int").alias("j"), told.alias("v"))


@query(f"WITH {EM}, s AS (SELECT j, avg(v) AS w FROM ec GROUP BY j) SELECT i, j, round(v - w + 0.0, 6) AS v FROM ec JOIN s USING (j)")
def sweep_columns(spark, d):
    m = em(spark, d)
    return _cells(elementwise.sweep(m, aggregates.col_means(m), 2, "-"))


@query(f"WITH {EM}, s AS (SELECT i, max(v) AS w FROM ec GROUP BY i) SELECT i, j, round(v / w, 6) AS v FROM ec JOIN s USING (i)")
def sweep_rows(spark, d):
    m = em(spark, d)
    return _cells(elementwise.sweep(m, aggregates.row_maxs(m), 1, "/"))


@query(f"WITH {PC} SELECT i, j, round(pow(v, j + 1), 2) AS v FROM pc")
def sweep_power(spark, d):
    m = pt(spark, d)
    return _cells(elementwise.sweep(m, spark.createDataFrame([(0, 1.0), (1, 2.0)], "k long, w double"), 2, "pow"), 2)


@query(f"WITH {EM}, s AS (SELECT j, avg(v) AS m, stddev_samp(v) AS s FROM ec GROUP BY j) SELECT i, j, round((v - m) / s + 0.0, 6) AS v FROM ec JOIN s USING (j)")
def scale_columns(spark, d):
    return _cells(elementwise.scale(em(spark, d)))


@query(f"WITH {EM}, s AS (SELECT j, sqrt(sum(v * v) / (count(*) - 1)) AS s FROM ec GROUP BY j) SELECT i, j, round(v / s + 0.0, 6) AS v FROM ec JOIN s USING (j)")
def scale_by_root_mean_square(spark, d):
    return _cells(elementwise.scale(em(spark, d), center=False))


@query(f"WITH {EM}, s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM ec GROUP BY i) SELECT i, j, round((v - m) / s + 0.0, 6) AS v FROM ec JOIN s USING (i)")
def scale_rows(spark, d):
    return _cells(elementwise.scale(em(spark, d), by_rows=True))


@query(f"WITH {EM}, s AS (SELECT j, avg(v) AS m, stddev_samp(v) * sqrt(count(*) - 1) AS s FROM ec GROUP BY j) SELECT i, j, round((v - m) / s + 0.0, 8) AS v FROM ec JOIN s USING (j)")
def scale_typified(spark, d):
    return _cells(elementwise.scale(em(spark, d), typify=True), 8)


@query(f"WITH {EM} SELECT i AS k, round(v + 0.0, 6) AS v FROM ec WHERE i = j")
def diagonal(spark, d):
    return _rounded(elementwise.diag(em(spark, d)), 6, "v")


@query(f"WITH {SP}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM sp a JOIN sp b USING (i) GROUP BY ALL) SELECT CAST(i AS BIGINT) AS k, round(v * 2 - v, 2) AS v FROM g WHERE i = j")
def diagonal_difference(spark, d):
    g = products.crossprod(sp(spark, d))
    return _rounded(elementwise.diag_op(elementwise.scalar_product(g, 2), g, "-"), 2, "v")


@query(f"WITH {SP}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM sp a JOIN sp b USING (i) GROUP BY ALL) SELECT CAST(i AS BIGINT) AS k, round(v / 4, 4) AS v FROM g WHERE i = j")
def diagonal_scaled(spark, d):
    return _rounded(elementwise.diag_scale(products.crossprod(sp(spark, d)), 4, "divide"), 4, "v")


@query(f"WITH {EM} SELECT i, j, round(CASE WHEN i = j THEN i * 1.5 ELSE v END + 0.0, 6) AS v FROM ec")
def set_diagonal(spark, d):
    m = em(spark, d)
    return _cells(elementwise.set_diag(m, [k * 1.5 for k in range(min(m.dim))]))


@query(f"WITH {LC} SELECT j, round(sum(v * 2.5), 2) AS v FROM lc GROUP BY j")
def scalar_product(spark, d):
    return _rounded(aggregates.col_sums(elementwise.scalar_product(li(spark, d), 2.5)), 2, "v")


@query(f"WITH {EM} SELECT i, j, round(v + j + 1, 6) AS v FROM ec")
def matrix_plus_vector(spark, d):
    m = em(spark, d)
    return _cells(m + Matrix.from_numpy(spark, np.arange(1.0, 65.0)[None]))


# ---- products


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS i, {k} AS j, round(sum(c{j} * c{k}), 1) AS v FROM li" for j in range(4) for k in range(4)))
def crossprod_wide(spark, d):
    return _cells(products.crossprod(li(spark, d)), 1)


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def crossprod_rows(spark, d):
    return _cells(products.crossprod(em(spark, d)), 5)


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j - 32 AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM ec a JOIN ec b USING (i) WHERE a.j < 32 AND b.j >= 32 GROUP BY a.j, b.j")
def crossprod_of_two(spark, d):
    m = em(spark, d)
    return _cells(products.crossprod(m[:, :32], m[:, 32:]), 5)


@query(f"WITH {EM} SELECT i, CAST(l AS INTEGER) AS j, round(sum(v * ((j * 3 + l) % 5)), 5) AS v FROM ec, range(3) AS r(l) GROUP BY i, l")
def matmul_small(spark, d):
    right = np.array([[(j * 3 + k) % 5 for k in range(3)] for j in range(64)], float)
    return _cells(em(spark, d) @ Matrix.from_numpy(spark, right), 5)


@query(f"WITH {SP} SELECT a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 2) AS v FROM sp a JOIN sp b USING (j) GROUP BY a.i, b.i")
def matmul_blocks(spark, d):
    m = sp(spark, d)
    return _cells(products.matmul(m, m.t(), strategy="block"), 2)


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def matmul_block_grid(spark, d):
    m = em(spark, d)
    return _cells(products.matmul(m, m, transpose_a=True, strategy="block", side=20), 5)


@query(f"WITH {EM} SELECT a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM ec a JOIN ec b USING (j) GROUP BY a.i, b.i")
def matmul_transposed_blocks(spark, d):
    m = em(spark, d)
    return _cells(products.matmul(m, m, transpose_b=True, strategy="block", side=24, rounded=True), 5)


@query(f"WITH {SP} SELECT a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 2) AS v FROM sp a JOIN sp b USING (j) GROUP BY a.i, b.i")
def tcrossprod(spark, d):
    return _cells(products.tcrossprod(sp(spark, d).to_rows()), 2)


@query(f"WITH {PS} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 2) AS v FROM ps a JOIN ps b USING (i) GROUP BY a.j, b.j")
def multiply_sparse(spark, d):
    m = ps(spark, d)
    return _cells(products.multiply_sparse(m.t(), m), 2)


@query(f"WITH {PS} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 2) AS v FROM ps a JOIN ps b USING (i) GROUP BY a.j, b.j")
def multiply_sparse_split(spark, d):
    # most parts have more pairs of suppliers than one task may join here
    m = ps(spark, d)
    return _cells(products.multiply_sparse(m.t(), m, strategy="cells", most=9), 2)


@query(f"WITH {PS} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 2) AS v FROM ps a JOIN ps b USING (i) GROUP BY a.j, b.j")
def multiply_sparse_tiles(spark, d):
    # tiles of 100 parts, cut at 5000 pairs of cells
    m = ps(spark, d)
    return _cells(products.multiply_sparse(m.t(), m, strategy="tiles", side=100, most=5000), 2)


@query(f"WITH {PS}, s AS (SELECT j, avg(v) AS m FROM pd GROUP BY j) SELECT i, j, round(v - m, 6) + 0.0 AS v FROM pd JOIN s USING (j)")
def sweep_sparse(spark, d):
    # rounded before the absent cells are filled: a value for each column instead of one for each cell
    m = ps(spark, d)
    return elementwise.sweep(m, aggregates.col_means(m), 2, "-", finish=lambda v: F.round(v + 0.0, 6)).df


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def matmul_split_inner(spark, d):
    m = em(spark, d)
    return _cells(products.matmul(m, m, transpose_a=True, strategy="block", side=32, splits=5), 5)


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def crossprod_tiles(spark, d):
    return _cells(products.crossprod(em(spark, d), tile=22), 5)


@query(f"WITH {EM}, {PT.replace('pt AS', 'p2 AS')} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum((a.i % 7) * a.v * b.v), 5) AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def weighted_crossprod(spark, d):
    m = em(spark, d)
    return _cells(products.weighted_product(m, m.df.select("i", (F.col("i") % 7).cast("double").alias("w")), "XtwX"), 5)


@query(f"WITH {SP} SELECT a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v * (j + 1)), 2) AS v FROM sp a JOIN sp b USING (j) GROUP BY a.i, b.i")
def weighted_tcrossprod(spark, d):
    return _cells(products.weighted_product(sp(spark, d).to_rows(), spark.createDataFrame([(k, k + 1.0) for k in range(7)], "k long, w double"), "XwXt"), 2)


@query(f"WITH {EM} SELECT i, j, round(v * (j + 1) + 0.0, 6) AS v FROM ec")
def columns_weighted(spark, d):
    return _cells(products.weighted_product(em(spark, d), spark.createDataFrame([(k, k + 1.0) for k in range(64)], "k long, w double"), "Xw"))


@query(f"WITH {EM} SELECT i, j, round(v * (i % 7) + 0.0, 6) AS v FROM ec")
def rows_weighted(spark, d):
    m = em(spark, d)
    return _cells(products.weighted_product(m, m.df.select("i", (F.col("i") % 7).cast("double").alias("w")), "wX"))


# ---- correlation

_PAIRS = "SELECT a.j AS j, b.j AS l, round({}, 6) + 0.0 AS r FROM {} a JOIN {} b USING (i){} GROUP BY a.j, b.j"


def _r(c: correlation.Correlation) -> DataFrame:
    return c.cells.select("j", "l", (F.round("r", 6) + 0.0).alias("r"))


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT {j} AS j, {k} AS l, round(corr(c{j}, c{k}), 6) + 0.0 AS r FROM li" for j in range(4) for k in range(4)))
def cor_pearson(spark, d):
    return _r(correlation.cor(li(spark, d)))


@query(f"WITH {EM} " + _PAIRS.format("corr(a.v, b.v)", "ec", "ec", ""))
def cor_many_columns(spark, d):
    return _r(correlation.cor(em(spark, d)))


@query(f"WITH {EM}, ok AS (SELECT * FROM ec WHERE (i * 7 + j) % 11 <> 0) " + _PAIRS.format("corr(a.v, b.v)", "ok", "ok", ""))
def cor_pairwise(spark, d):
    return _r(correlation.cor(_with_nan(em(spark, d)), use="pairwise.complete.obs"))


@query(f"WITH {PC}, rk AS (SELECT i, j, CAST(row_number() OVER (PARTITION BY j ORDER BY v, i) AS DOUBLE) AS v FROM pc) " + _PAIRS.format("corr(a.v, b.v)", "rk", "rk", ""))
def cor_spearman(spark, d):
    return _r(correlation.cor(pt(spark, d), method="spearman"))


@query(f"WITH {EM}, x AS (SELECT * FROM ec WHERE j < 32), y AS (SELECT i, j - 32 AS j, v FROM ec WHERE j >= 32) " + _PAIRS.format("corr(a.v, b.v)", "x", "y", ""))
def cor_cross(spark, d):
    m = em(spark, d)
    return _r(correlation.cor(m[:, :32], m[:, 32:]))


@query(f"WITH {EM} " + _PAIRS.format("corr(a.v, b.v)", "ec", "ec", ""))
def cor_tiles(spark, d):
    return _r(correlation.cor(em(spark, d), tile=22))


@query(f"WITH {EM}, ok AS (SELECT * FROM ec WHERE (i * 7 + j) % 11 <> 0) " + _PAIRS.format("corr(a.v, b.v)", "ok", "ok", ""))
def cor_pairwise_tiles(spark, d):
    return _r(correlation.cor(_with_nan(em(spark, d)), use="pairwise.complete.obs", tile=22))


@query(f"WITH {EM}, x AS (SELECT * FROM ec WHERE j < 32), y AS (SELECT i, j - 32 AS j, v FROM ec WHERE j >= 32) " + _PAIRS.format("corr(a.v, b.v)", "x", "y", ""))
def cor_cross_tiles(spark, d):
    m = em(spark, d)
    return _r(correlation.cor(m[:, :32], m[:, 32:], tile=12))


@query(f"WITH {PS}, rk AS (SELECT i, j, CAST(row_number() OVER (PARTITION BY j ORDER BY v, i) AS DOUBLE) AS v FROM pd WHERE j > 0 AND i > 0) " + _PAIRS.format("corr(a.v, b.v)", "rk", "rk", ""))
def cor_spearman_sparse(spark, d):
    # parts and suppliers count from 1: number 0 of both is left out, as it has no cell
    m = ps(spark, d)
    shown = Matrix(m.df.where("v <> 0").select((F.col("i") - 1).alias("i"), (F.col("j") - 1).cast("int").alias("j"), "v"), m.nrow - 1, m.ncol - 1, "coo")
    found = _r(correlation.cor(shown, method="spearman"))
    return found.withColumns({c: F.col(c) + 1 for c in ("j", "l")})


@query(f"WITH {SP}, t AS (SELECT j AS i, CAST(i AS INTEGER) AS j, v FROM sp) " + _PAIRS.format("corr(a.v, b.v)", "t", "t", ""))
def cor_of_rows(spark, d):
    return _r(correlation.cor(sp(spark, d), transpose_x=True))


@query(f"WITH {EM}, c AS (SELECT a.j AS j, b.j AS l, corr(a.v, b.v) AS r, count(*) AS n FROM ec a JOIN ec b USING (i) WHERE a.j <> b.j GROUP BY a.j, b.j), t AS (SELECT j, l, n, abs(r) * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM c) SELECT j, l, round(t, 4) AS t, round({two_sided('t', 'n')}, 6) + 0.0 AS p FROM t")
def cor_p_values(spark, d):
    t = F.abs("r") * F.sqrt(F.col("n") - 2) / F.sqrt(1 - F.col("r") * F.col("r"))
    return correlation.cor(em(spark, d)).cells.where("j <> l").select("j", "l", F.round(t, 4).alias("t"), (F.round("p", 6) + 0.0).alias("p"))


@query(f"WITH {SP}, a AS (SELECT i, j, v FROM sp), c AS (SELECT CAST(a.i AS INTEGER) AS j, CAST(b.i AS INTEGER) AS l, corr(a.v, b.v) AS r, count(*) AS n FROM a JOIN a b USING (j) WHERE a.i <> b.i GROUP BY a.i, b.i), t AS (SELECT j, l, n, abs(r) * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM c) SELECT j, l, round({two_sided('t', 'n')}, 5) + 0.0 AS p FROM t")
def cor_p_values_few(spark, d):
    # seven observations of each pair: Student's t with five degrees
    found = correlation.cor(sp(spark, d), transpose_x=True).cells.where("j <> l")
    return found.select(F.col("j").cast("int").alias("j"), F.col("l").cast("int").alias("l"), (F.round("p", 5) + 0.0).alias("p"))


# ---- binding, splitting, subsets


@query(f"WITH {PC} SELECT i, j, v FROM pc UNION ALL SELECT i, j + 2, v * 2 FROM pc")
def bind_columns(spark, d):
    m = pt(spark, d)
    return _cells(restructure.cbind(m, m.map_values(lambda x: x * 2)))


@query(f"WITH {PC} SELECT i, j, v FROM pc UNION ALL SELECT i + (SELECT count(*) FROM pt), j, v * 2 FROM pc")
def bind_rows(spark, d):
    m = pt(spark, d)
    return _cells(restructure.rbind(m, m.map_values(lambda x: x * 2)))


@query(f"WITH {PC}, z AS (SELECT ceil(count(*) / 3.0) AS z FROM pt) SELECT CAST(floor(i / z) AS INTEGER) AS block, CAST(i % z AS BIGINT) AS i, j, v FROM pc, z")
def split_rows(spark, d):
    return restructure.with_blocks(pt(spark, d), n_blocks=3).select("block", "i", F.col("j").cast("int").alias("j"), "v")


@query(f"WITH {EM} SELECT CAST(j // 10 AS INTEGER) AS block, count(*) AS n, round(sum(v), 5) AS total FROM ec GROUP BY j // 10")
def split_columns(spark, d):
    parts = restructure.split(em(spark, d), block_size=10, by_cols=True)
    rows = [p.to_coo().df.agg(F.lit(k).alias("block"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 5).alias("total")) for k, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH {PC} SELECT i, j, round(v + v * 2 + v * 3, 4) AS v FROM pc")
def reduce_sum(spark, d):
    m = pt(spark, d)
    return _cells(restructure.reduce([m, m.map_values(lambda x: x * 2), m.map_values(lambda x: x * 3)]), 4)


@query(f"WITH {PC} SELECT i, j, round(v - v * 0.5, 4) AS v FROM pc")
def reduce_difference(spark, d):
    m = pt(spark, d)
    return _cells(restructure.reduce([m, m.map_values(lambda x: x * 0.5)], "-"), 4)


@query(f"WITH {PC} SELECT (SELECT count(*) FROM pt) - 1 - i AS i, j, v FROM pc")
def permute_rows(spark, d):
    m = pt(spark, d)
    return _cells(restructure.permute(m, m.df.select((F.lit(m.nrow - 1) - F.col("i")).alias("pos"), F.col("i").alias("old"))))


@query(f"WITH {EM} SELECT i, 63 - j AS j, round(v + 0.0, 6) AS v FROM ec")
def permute_columns(spark, d):
    return _cells(restructure.permute(em(spark, d), list(range(63, -1, -1)), by_cols=True))


@query(f"WITH {EM} SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j")
def fill_triangle(spark, d):
    g = products.crossprod(em(spark, d))
    return _cells(restructure.fill_triangle(Matrix(g.df.where("i >= j"), *g.dim, "coo")), 5)


@query(f"WITH {EM} SELECT i - 10 AS i, j - 2 AS j, round(v + 0.0, 6) AS v FROM ec WHERE i >= 10 AND i < 50 AND j >= 2 AND j < 9")
def subset_range(spark, d):
    return _cells(em(spark, d)[10:50, 2:9])


@query(f"WITH {EM}, r(pos, i) AS (VALUES (0, 5), (1, 5), (2, 0), (3, 17)), c(q, j) AS (VALUES (0, 3), (1, 1)) SELECT CAST(pos AS BIGINT) AS i, q AS j, round(v + 0.0, 6) AS v FROM ec JOIN r USING (i) JOIN c USING (j)")
def subset_gather(spark, d):
    return _cells(em(spark, d)[[5, 5, 0, 17], [3, 1]])


@query(f"WITH {EM} SELECT i // 2 AS i, j, round(v + 0.0, 6) AS v FROM ec WHERE i % 2 = 0 AND j < 62")
def subset_logical(spark, d):
    return _cells(em(spark, d)[[True, False], ("not", [62, 63])])


@query(f"WITH {EM}, k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM em WHERE i NOT BETWEEN 20 AND 39 AND i % 10 <> 3) SELECT new AS i, j, round(v, 6) + 0.0 AS v FROM ec JOIN k USING (i)")
def subset_excluded(spark, d):
    m = em(spark, d)
    return _cells(m[("not", sorted({*range(20, 40), *range(3, m.nrow, 10)})), :])


@query(f"WITH {EM}, n AS (SELECT count(*) AS n FROM em) SELECT (n - 1 - i) // 3 AS i, j, round(v, 6) + 0.0 AS v FROM ec, n WHERE (n - 1 - i) % 3 = 0")
def subset_backwards(spark, d):
    return _cells(em(spark, d)[::-3, :])


@query(f"WITH {PC}, n AS (SELECT count(*) AS n FROM pt) SELECT i, j, CASE WHEN i % 4 = 1 AND j = 1 THEN -7.0 WHEN i % 100 = 0 THEN i * 2.0 + j WHEN i < 10 AND j = 1 THEN 999.0 ELSE v END AS v FROM pc")
def store_assigned(spark, d):
    m, store = pt(spark, d), Store(spark, _folder(spark))
    store.write("g/parts", m)
    store.assign("g/parts", slice(0, 10), [1], 999)
    store.assign_cells("g/parts", m.df.where("i % 100 = 0").select("i", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), (F.col("i") * 2 + j).alias("w")) for j in range(2)]))))
    store.compact("g/parts")
    # of two values for a cell the later one counts
    doubled = m.df.where("i % 4 = 1").select("i", F.lit(1).alias("j"), F.inline(F.array(*[F.struct(F.lit(a).alias("at"), F.lit(w).alias("w")) for a, w in ((2, -7.0), (1, 5.0))])))
    return _cells(store.assign_cells("g/parts", doubled))


@query(f"WITH {PC} SELECT i, j, CASE WHEN i < 10 AND j = 1 THEN 999.0 ELSE v END AS v FROM pc")
def assign_range(spark, d):
    return _cells(subset.assign(pt(spark, d), slice(0, 10), [1], 999))


@query(f"WITH {PC} SELECT i, j, CASE WHEN i % 100 = 0 AND j = 0 THEN -1.0 ELSE v END AS v FROM pc")
def assign_cells(spark, d):
    m = pt(spark, d)
    return _cells(subset.assign_cells(m, m.df.where("i % 100 = 0").select("i", F.lit(0).alias("j"), F.lit(-1.0).alias("w"))))


@query(f"WITH {PT} SELECT i AS idx, 'part ' || p AS name, c1 AS v FROM pt JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(p_partkey AS VARCHAR) AS p FROM part) USING (i)")
def labels(spark, d):
    placed = with_position(_table(spark, d, "part").select("p_partkey"), ["p_partkey"], "idx")
    m = pt(spark, d).with_labels(placed.select("idx", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name")), ["size", "price"])
    return m.row_labels.join(m.df, F.col("idx") == F.col("i")).select("idx", "name", F.col("c1").alias("v"))


@query(f"WITH {EM} SELECT CAST(max(i) + 1 AS BIGINT) AS nrow, CAST(max(j) + 1 AS BIGINT) AS ncol, CAST(count(*) AS BIGINT) AS length, CAST(count(*) * 8 AS DOUBLE) AS bytes FROM ec")
def dimensions(spark, d):
    m = em(spark, d)
    return _row(spark, nrow=m.nrow, ncol=m.ncol, length=len(m), bytes=float(m.object_size()))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_regionkey, count(*) OVER () AS m FROM nation), p AS (SELECT count(*) AS rows FROM part), c AS (SELECT unnest(range((SELECT rows FROM p))) AS i), g AS (SELECT i, j, (j * rows + i) % (SELECT any_value(m) FROM n) AS k FROM c, range(4) AS r(j), p) SELECT i, CAST(j AS INTEGER) AS j, CAST(n_regionkey AS DOUBLE) AS v FROM g JOIN n USING (k)")
def create_recycled(spark, d):
    # as many rows as there are parts, the nations' regions recycled down the columns
    regions = [r[0] for r in _table(spark, d, "nation").orderBy("n_nationkey").select("n_regionkey").collect()]
    return _cells(api.create_matrix(Store(spark, _folder(spark)), "made/regions", _table(spark, d, "part").count(), 4, regions))


@query(f"WITH {EM}, n AS (SELECT max(i) AS last FROM em) SELECT last - i AS i, j, round(v, 6) + 0.0 AS v FROM ec, n")
def rows_by_a_table(spark, d):
    m = em(spark, d)
    return _cells(subset.select_rows(m, m.df.select((m.nrow - 1 - F.col("i")).alias("pos"), "i")))


@query(f"WITH {PT} SELECT i AS k, round(c0 * c1, 4) AS v FROM pt")
def vectors_multiplied(spark, d):
    m = pt(spark, d).df
    return _rounded(elementwise.vector_op(m.select("i", "c0"), m.select("i", "c1"), "*"), 4, "v")


# ---- genotypes

_KEEP = "WITH " + GE + ", f AS (SELECT {axis}, {flag} AS gone FROM ge GROUP BY {axis}), k AS (SELECT {axis}, row_number() OVER (ORDER BY {axis}) - 1 AS new FROM f WHERE NOT gone) SELECT {i} AS i, CAST({j} AS INTEGER) AS j, v FROM ge JOIN k USING ({axis})"
_MAF = "least(f, 1 - f)"


@query(_KEEP.format(axis="j", flag="avg(CASE WHEN v = 3 THEN 1.0 ELSE 0 END) >= 0.24", i="i", j="new"))
def filter_low_coverage(spark, d):
    return _cells(genotype.filter_low_coverage(ge(spark, d), 0.24).matrix)


@query(_KEEP.format(axis="i", flag="least(avg(CASE WHEN v = 0 THEN 1.0 WHEN v = 1 THEN 0.5 ELSE 0 END), 1 - avg(CASE WHEN v = 0 THEN 1.0 WHEN v = 1 THEN 0.5 ELSE 0 END)) <= 0.4", i="new", j="j"))
def filter_maf(spark, d):
    return _cells(genotype.filter_maf(ge(spark, d), 0.4).matrix)


@query("SELECT * FROM (" + _KEEP.format(axis="i", flag="least(avg(CASE WHEN v = 0 THEN 1.0 WHEN v = 1 THEN 0.5 ELSE 0 END), 1 - avg(CASE WHEN v = 0 THEN 1.0 WHEN v = 1 THEN 0.5 ELSE 0 END)) <= 0.4", i="new", j="j") + ") WHERE v <> 0")
def filter_maf_sparse(spark, d):
    m = ge(spark, d)
    return _cells(genotype.filter_maf(Matrix(m.df.where("v <> 0"), *m.dim, "coo"), 0.4).matrix)


@query(f"WITH {GE}, c AS (SELECT j, count(*) FILTER (v = 0) AS n0, count(*) FILTER (v = 1) AS n1, count(*) FILTER (v = 2) AS n2 FROM ge GROUP BY j) SELECT i, j, CASE WHEN v = 3 AND n0 + n1 + n2 > 0 THEN (CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0.0 WHEN n1 >= n2 THEN 1.0 ELSE 2.0 END) ELSE v END AS v FROM ge JOIN c USING (j)")
def impute_mode(spark, d):
    return _cells(genotype.impute(ge(spark, d), strategy="mode"))


@query(f"WITH {GE} SELECT CAST(count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS changed FROM ge")
def impute_random(spark, d):
    m = ge(spark, d)
    new = genotype.impute(m, seed=5).df.withColumnRenamed("v", "w")
    return m.df.join(new, ["i", "j"]).agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("w") == 3, 1)).alias("missing"), F.count(F.when((F.col("v") != 3) & (F.col("v") != F.col("w")), 1)).alias("changed"))


@query(f"WITH {GE} SELECT CAST(j AS BIGINT) AS feature, v, count(*) AS n FROM ge GROUP BY j, v")
def code_counts(spark, d):
    return genotype.code_counts(ge(spark, d))


# ---- factorizations, by what is the same whatever the signs

_SCALED = EM + ", s AS (SELECT j, avg(v) AS m, stddev_samp(v) AS s FROM ec GROUP BY j), x AS (SELECT i, j, (v - m) / s AS v FROM ec JOIN s USING (j))"
_TYPIFIED = _SCALED.replace("(v - m) / s AS v", "(v - m) / (s * sqrt((SELECT count(*) - 1 FROM em))) AS v")
_GRAM = f"WITH RECURSIVE {EM}, g AS (SELECT a.j AS j, b.j AS l, sum(a.v * b.v) AS v FROM ec a JOIN ec b USING (i) GROUP BY a.j, b.j)"
_GRAM_OF = "WITH RECURSIVE {}, g AS (SELECT a.j AS j, b.j AS l, sum(a.v * b.v) AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j)"
_UPPER = _GRAM + ", " + upper_factor("u", "g", 64) + " SELECT CAST(j AS BIGINT) AS i, l AS j, round(v, 5) + 0.0 AS v FROM u"
_INVERSE = _GRAM + ", " + inverted("w", "g", 64) + " SELECT CAST(j AS BIGINT) AS i, l AS j, round(v, 6) + 0.0 AS v FROM w"


def _all_values(gram: str, expression: str, digits: int) -> str:
    """SQL: every eigenvalue of the Gram matrix, descending."""
    return f"{gram}, {rotated('e', 'g', 64)} SELECT k, round({expression}, {digits}) + 0.0 AS v FROM e"


def _numbered(spark: SparkSession, values: np.ndarray, digits: int) -> DataFrame:
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double"), digits, "v")


_OTHER_SIDE = "b AS (SELECT j, i % 3 AS c, sum(v) AS v FROM ec GROUP BY j, i % 3)"
_SOLVED = _GRAM + ", " + _OTHER_SIDE + ", " + inverted("w", "g", 64) + " SELECT CAST(w.j AS BIGINT) AS i, CAST(b.c AS INTEGER) AS j, round(sum(w.v * b.v), 5) + 0.0 AS v FROM w JOIN b ON b.j = w.l GROUP BY w.j, b.c"


def _thirds(m: Matrix) -> Matrix:
    """Column c: sums over the rows i with i % 3 = c."""
    sums = m.to_coo().df.groupBy(F.col("j").cast("long").alias("i"), (F.col("i") % 3).cast("int").alias("j")).agg(F.sum("v").alias("v"))
    return Matrix(sums, m.ncol, 3, "coo")


def _upper(spark: SparkSession, r: np.ndarray) -> DataFrame:
    return _cells(Matrix.from_numpy(spark, r), 5).where("i <= j")


_QR = _UPPER.replace("round(v, 5) + 0.0 AS v", "round(v, 5) + 0.0 AS v, CASE WHEN j = l THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q")


def _factors(spark: SparkSession, q: Matrix, r: np.ndarray) -> DataFrame:
    """The cells of R, and beside each that of t(Q) Q."""
    return _upper(spark, r).join(_cells(products.crossprod(q), 8).withColumnRenamed("v", "q"), ["i", "j"])


def _spectrum(k: int, squarings: int = 12) -> str:
    """SQL: the k largest eigenvalues of ``g`` (j, l, v), each by squaring the matrix over and over, then taken out of it."""
    steps = ["d0 AS MATERIALIZED (SELECT j, l, v FROM g)"]
    for at in range(k):
        steps.append(f"s{at}_0 AS MATERIALIZED (SELECT j, l, v / (SELECT max(abs(v)) FROM d{at}) AS v FROM d{at})")
        for t in range(squarings):
            square = f"(SELECT a.j AS j, b.l AS l, sum(a.v * b.v) AS v FROM s{at}_{t} a JOIN s{at}_{t} b ON a.l = b.j GROUP BY a.j, b.l)"
            steps.append(f"q{at}_{t} AS MATERIALIZED {square}, s{at}_{t + 1} AS MATERIALIZED (SELECT j, l, v / (SELECT max(abs(v)) FROM q{at}_{t}) AS v FROM q{at}_{t})")
        last = f"s{at}_{squarings}"
        steps.append(f"x{at} AS MATERIALIZED (SELECT j, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE l = (SELECT arg_max(l, v) FROM {last} WHERE j = l))")
        steps.append(f"e{at} AS MATERIALIZED (SELECT sum(a.v * g.v * b.v) AS v FROM g JOIN x{at} a ON a.j = g.j JOIN x{at} b ON b.j = g.l)")
        steps.append(f"d{at + 1} AS MATERIALIZED (SELECT d.j AS j, d.l AS l, d.v - (SELECT v FROM e{at}) * a.v * b.v AS v FROM d{at} d JOIN x{at} a ON a.j = d.j JOIN x{at} b ON b.j = d.l)")
    return ", ".join(steps)


@query(_QR)
def qr_householder(spark, d):
    return _factors(spark, *factor.qr(em(spark, d), thin=True, method="householder"))


@query(f"WITH {EM} SELECT i, j, round(v, 6) + 0.0 AS v FROM ec")
def qr_tall_product(spark, d):
    q, r = factor.qr(em(spark, d), thin=True, method="tsqr")
    return _cells(factor.project(q, r))


@query(f"WITH {EM} SELECT i, j, round(v, 6) + 0.0 AS v FROM ec")
def svd_product(spark, d):
    found = factor.svd(em(spark, d), center=False, scaled=False)
    return _cells(factor.project(found.u, np.diag(found.d) @ found.v.to_numpy().T))


@query(f"WITH {EM} SELECT i, j, round(v, 6) + 0.0 AS v FROM ec")
def q_applied_and_undone(spark, d):
    m = em(spark, d)
    q = reflectors.reflectors(m, height=64)
    return _cells(q.times(q.t_times(m)))


@query(f"WITH {EM}, x AS (SELECT i, j, v FROM ec UNION ALL SELECT i, 64 + j AS j, v * 2 AS v FROM ec WHERE j < 8) SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, round(sum(a.v * b.v), 5) + 0.0 AS v, CAST(64 AS BIGINT) AS rank FROM x a JOIN x b USING (i) GROUP BY a.j, b.j")
def qr_dependent_columns(spark, d):
    m = em(spark, d)
    both = restructure.cbind(m, elementwise.scalar_product(m[:, 0:8], 2.0))
    found = reflectors.reflectors(both, pivoted=True, height=80)
    r = np.zeros_like(found.r)
    r[:, found.pivot] = found.r
    return _cells(Matrix.from_numpy(spark, r.T @ r), 5).withColumn("rank", F.lit(found.rank).cast("long"))


@query(_QR)
def qr_tall(spark, d):
    return _factors(spark, *factor.qr(em(spark, d), thin=True, method="tsqr"))


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS i, {k} AS j, round(sum(c{j} * c{k}) / 1e6, 4) AS v FROM li" for j in range(4) for k in range(4)))
def r_factor_gram(spark, d):
    r = factor.r_factor(li(spark, d))
    return _cells(Matrix.from_numpy(spark, r.T @ r / 1e6), 4)


@query(_all_values(_GRAM_OF.format(_SCALED), "sqrt(v)", 5))
def svd_values(spark, d):
    return _numbered(spark, factor.svd(em(spark, d)).d, 5)


@query(_all_values(_GRAM_OF.format(_SCALED), "sqrt(v)", 5))
def svd_blocks(spark, d):
    return _numbered(spark, factor.svd(em(spark, d), method="blocks", k=2, q=2).d, 5)


@query(_all_values(_GRAM, "sqrt(v)", 5))
def svd_raw(spark, d):
    return _numbered(spark, factor.svd(em(spark, d), center=False, scaled=False).d, 5)


@query(_GRAM + ", " + _spectrum(3, 16) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, i, round(sum(ec.v * x.v) * (SELECT sign(arg_max(v, abs(v))) FROM x{k}) / (SELECT sqrt(v) FROM e{k}), 6) + 0.0 AS v FROM ec JOIN x{k} x USING (j) GROUP BY i" for k in range(3)))
def svd_vectors(spark, d):
    # left vectors of the three largest values; signs make the largest entry of a right vector positive
    cells = factor.svd(em(spark, d), 3, 3, center=False, scaled=False).u.to_coo().df
    return cells.select(F.col("j").cast("int").alias("k"), "i", (F.round("v", 6) + 0.0).alias("v"))


@query(_all_values(_GRAM_OF.format(_TYPIFIED), "v", 6))
def pca_eigenvalues(spark, d):
    return _numbered(spark, factor.pca(em(spark, d), scaled=True).eigenvalues, 6)


@query(f"WITH {EM}, s AS (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM ec GROUP BY j) SELECT i, round(sqrt(sum(pow((v - m) / s, 2))), 5) AS v FROM ec JOIN s USING (j) GROUP BY i")
def pca_distances(spark, d):
    return _rounded(factor.pca(em(spark, d), scaled=True).ind_dist, 5, "v")


@query(_GRAM_OF.format(_TYPIFIED) + ", " + _spectrum(3, 16) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, i, round(100 * pow(sum(x.v * w.v), 2) / (SELECT v FROM e{k}), 5) + 0.0 AS contribution, round(100 * (SELECT v FROM e{k}) / 64, 5) AS share FROM x JOIN x{k} w USING (j) GROUP BY i" for k in range(3)))
def pca_individuals(spark, d):
    p = factor.pca(em(spark, d), scaled=True, rank=3)
    share = F.element_at(F.array(*map(F.lit, map(float, p.variance))), F.col("j").cast("int") + 1)
    return p.ind_contrib.to_coo().df.select(F.col("j").cast("int").alias("k"), "i", (F.round("v", 5) + 0.0).alias("contribution"), F.round(share, 5).alias("share"))


@query(_all_values(_GRAM, "v", 5))
def eigen_values(spark, d):
    return _numbered(spark, factor.eigen(products.crossprod(em(spark, d))).values, 5)


@query(_GRAM + " SELECT CAST(j AS BIGINT) AS i, l AS j, round(v, 5) + 0.0 AS v FROM g")
def eigen_in_blocks(spark, d):
    # V diag(values) t(V) is the matrix again
    found = jacobi.eigen_blocks(products.crossprod(em(spark, d)), side=16)
    v = found.vectors.to_rows()
    scaled = elementwise.sweep(v, spark.createDataFrame(list(enumerate(map(float, found.values))), "k long, w double"), 2, "*")
    return _cells(products.tcrossprod(scaled, v), 5)


@query(f"WITH {SP}, g AS (SELECT a.j AS j, b.j AS l, sum(a.v * b.v) AS v FROM sp a JOIN sp b USING (i) GROUP BY ALL), {_spectrum(1)} SELECT CAST(j AS INTEGER) AS j, round(abs(v), 4) AS v, (SELECT round(v, 1) FROM e0) AS value FROM x0")
def eigen_power(spark, d):
    value, vector = factor.power_iteration(products.crossprod(sp(spark, d)), tol=1e-14, max_iter=60)
    return spark.createDataFrame([(j, round(abs(float(v)), 4), round(value, 1)) for j, v in enumerate(vector)], "j int, v double, value double")


@query(_UPPER)
def chol_product(spark, d):
    return _upper(spark, factor.chol(products.crossprod(em(spark, d))))


@query(_INVERSE)
def inverse_product(spark, d):
    return _cells(Matrix.from_numpy(spark, factor.inverse(products.crossprod(em(spark, d)))), 6)


@query(_GRAM + " SELECT CAST(j AS BIGINT) AS i, l AS j, round(v, 5) AS v FROM g")
def chol_blocks_product(spark, d):
    u = blocks.chol_blocks(products.crossprod(em(spark, d)), side=20)
    return _cells(products.crossprod(u.to_rows()), 5)


@query(_INVERSE)
def inverse_blocks_product(spark, d):
    return _cells(blocks.inverse_blocks(products.crossprod(em(spark, d)), side=20), 6)


@query(_SOLVED)
def solve_blocks_identity(spark, d):
    m = em(spark, d)
    return _cells(blocks.solve_blocks(products.crossprod(m), _thirds(m), side=20), 5)


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(64) AS a(i), range(64) AS b(j)")
def pseudoinverse_product(spark, d):
    m = em(spark, d)
    return _cells(factor.pseudoinverse_product(m, m), 6)


@query("SELECT round(regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 3) AS intercept, round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 4) AS slope FROM lineitem")
def least_squares(spark, d):
    b = factor.ols_of(Matrix.from_columns(_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))[:, 0]
    return _rounded(_rounded(_row(spark, intercept=float(b[0]), slope=float(b[1])), 3, "intercept"), 4, "slope")


@query(_SOLVED)
def linear_solve(spark, d):
    m = em(spark, d)
    return _cells(Matrix.from_numpy(spark, factor.solve(products.crossprod(m), _thirds(m))), 5)


# X: the first 32 columns, Y: the others. Whitened by the factors of their own Gram matrices, all of them have the eigenvalues 1 + r and 1 - r.
@query(_GRAM_OF.format(_SCALED) + ", h AS (SELECT j, l, CASE WHEN (j < 32) = (l < 32) THEN v ELSE 0.0 END AS v FROM g), " + upper_factor("u", "h", 64) + ", uf AS (SELECT a.j AS j, b.j AS l, coalesce(u.v, 0.0) AS v FROM (SELECT DISTINCT j FROM g) a CROSS JOIN (SELECT DISTINCT j FROM g) b LEFT JOIN u ON u.j = a.j AND u.l = b.j), " + inverted("w", "uf", 64) + ", gw AS (SELECT g.j AS j, w.l AS l, sum(g.v * w.v) AS v FROM g JOIN w ON w.j = g.l GROUP BY ALL), z AS (SELECT w.l AS j, gw.l AS l, sum(w.v * gw.v) AS v FROM w JOIN gw ON gw.j = w.j GROUP BY ALL), " + rotated("e", "z", 64) + " SELECT k, round(v - 1, 6) + 0.0 AS v FROM e WHERE k < 32")
def canonical_correlation(spark, d):
    m = em(spark, d)
    return _numbered(spark, factor.cca(m[:, :32], m[:, 32:]), 6)


# ---- solvers and spectra of matrices that nobody collects

def _residual(a: Matrix, b: Matrix) -> DataFrame:
    """A X for the solution X of A X = B: all of B again."""
    return _cells(products.matmul(a.to_rows(), blocks.solve_general(a, b, side=20)), 4)


@query(f"WITH {EM}, {_OTHER_SIDE} SELECT CAST(j AS BIGINT) AS i, CAST(c AS INTEGER) AS j, round(v, 4) + 0.0 AS v FROM b")
def solve_nonsymmetric(spark, d):
    m = em(spark, d)
    g = products.crossprod(m).df.withColumn("v", F.col("v") * (1 + (F.col("i") * 3 + F.col("j") * 5) % 7))
    return _residual(Matrix(g, m.ncol, m.ncol, "coo"), _thirds(m))


@query(f"WITH {EM}, {_OTHER_SIDE} SELECT CAST(j AS BIGINT) AS i, CAST(c AS INTEGER) AS j, round(v, 4) + 0.0 AS v FROM b")
def solve_indefinite(spark, d):
    m = em(spark, d)
    signs = m.df.select("i", F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0).alias("w"))
    return _residual(products.weighted_product(m, signs, "XtwX"), _thirds(m))


TRI = "tri AS (SELECT i, CAST(i AS INTEGER) AS j, 4.0 + c0 % 3 AS v FROM pt UNION ALL SELECT i, CAST(i + 1 AS INTEGER), 1.0 FROM pt WHERE i + 1 < (SELECT count(*) FROM pt) UNION ALL SELECT i + 1, CAST(i AS INTEGER), 1.0 FROM pt WHERE i + 1 < (SELECT count(*) FROM pt))"


@query(f"WITH {PT}, {TRI} SELECT i, j, CAST(v AS DOUBLE) AS v FROM tri")
def chol_blocks_sparse(spark, d):
    m = pt(spark, d)
    near = lambda i, j: m.df.where(f"i + 1 < {m.nrow}").select(i.alias("i"), j.cast("int").alias("j"), F.lit(1.0).alias("v"))
    i = F.col("i")
    cells = m.df.select("i", i.cast("int").alias("j"), (4 + F.col("c0") % 3).alias("v")).unionByName(near(i, i + 1)).unionByName(near(i + 1, i))
    u = blocks.chol_blocks(Matrix(cells, m.nrow, m.nrow, "coo"))
    return _cells(products.crossprod(u)).where("v <> 0")


@query(_GRAM + ", " + _spectrum(3) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(v, 4) AS v FROM e{k}" for k in range(3)))
def eigen_krylov(spark, d):
    values = krylov.eigs(products.crossprod(em(spark, d)), 3, "LA", symmetric=True).values
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double"), 4, "v")


@query(_GRAM + ", " + _spectrum(3) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(sqrt(v), 5) AS v FROM e{k}" for k in range(3)))
def svd_truncated(spark, d):
    values = krylov.truncated_svd(em(spark, d), 3).d
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double"), 5, "v")


@query(_GRAM + " SELECT CAST(j AS BIGINT) AS i, l AS j, round(v, 5) + 0.0 AS v FROM g")
def eigen_vectors(spark, d):
    e = factor.eigen(products.crossprod(em(spark, d)))
    return _cells(Matrix.from_numpy(spark, (e.vectors * e.values) @ e.vectors.T), 5)


# ---- many matrices, files, streams


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    t = with_position(_table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label", "vec_id"], "at")
    first = t.groupBy("label").agg(F.min("at").alias("first"))
    t = t.join(first, "label").select(F.col("label").cast("string").alias("dataset"), F.lit(0).alias("side"), (F.col("at") - F.col("first")).alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return t


@query("WITH x AS (SELECT label, vec_id, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k)) SELECT CAST(a.label AS VARCHAR) AS dataset, 'CrossProd_' || CAST(a.label AS VARCHAR) AS result, CAST(a.j AS BIGINT) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM x a JOIN x b USING (vec_id) GROUP BY a.label, a.j, b.j")
def batch_crossprod(spark, d):
    return _rounded(batch.apply_to_groups(_by_label(spark, d), "CrossProd"), 5, "v")


@query("WITH x AS (SELECT label, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k)), s AS (SELECT CAST(label AS VARCHAR) AS dataset, j, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY label, j) SELECT dataset, 'sdmean_' || dataset || '.mean' AS result, CAST(0 AS BIGINT) AS i, CAST(j AS INTEGER) AS j, round(m, 6) AS v FROM s UNION ALL SELECT dataset, 'sdmean_' || dataset || '.sd', 0, CAST(j AS INTEGER), round(s, 6) FROM s")
def batch_mean_sd(spark, d):
    return _rounded(batch.apply_to_groups(_by_label(spark, d), "sdmean"), 6, "v")


@query("WITH x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k)) SELECT CAST(label AS VARCHAR) AS dataset, 'normalize_' || CAST(label AS VARCHAR) AS result, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CAST(j AS INTEGER) AS j, round((v - avg(v) OVER (PARTITION BY label, j)) / stddev_samp(v) OVER (PARTITION BY label, j), 5) + 0.0 AS v FROM x")
def batch_normalize(spark, d):
    return _rounded(batch.apply_to_groups(_by_label(spark, d), "normalize"), 5, "v")


@query("WITH x AS (SELECT label, vec_id, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k)) SELECT CAST(a.label AS VARCHAR) AS dataset, 'tCrossProd_' || CAST(a.label AS VARCHAR) AS result, a.i AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM x a JOIN x b USING (label, j) GROUP BY a.label, a.i, b.i")
def batch_tcrossprod(spark, d):
    return _rounded(batch.apply_to_groups(_by_label(spark, d), "tCrossProd", rounded=True), 5, "v")


_LABELLED = "x AS (SELECT CAST(label AS VARCHAR) AS dataset, vec_id, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k)), gram AS (SELECT a.dataset, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (dataset, vec_id) GROUP BY ALL)"


def _told(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("dataset", F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.round(F.col("v") + 0.0, digits).alias("v"))


def _side(df: DataFrame, side: int) -> DataFrame:
    return df.select("dataset", F.lit(side).alias("side"), F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), "v")


def _gram_plus_one(spark: SparkSession, d: str) -> DataFrame:
    g = batch.apply_to_groups(_by_label(spark, d), "CrossProd")
    return _side(g, 0).withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


_PLUS_ONE = "SELECT dataset, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, round(v + CASE WHEN i = j THEN 1 ELSE 0 END, 5) + 0.0 AS v FROM gram"


@query(f"WITH {_LABELLED} SELECT dataset, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, round(v, 5) + 0.0 AS v FROM gram")
def batch_qr(spark, d):
    found = batch.apply_to_groups(_by_label(spark, d), "QR").where("result like '%.R'")
    return _told(batch.apply_to_groups(_side(found, 0), "CrossProd"))


@query(f"WITH {_LABELLED} SELECT dataset, i, CAST(j AS INTEGER) AS j, round(v, 5) + 0.0 AS v FROM x")
def batch_qr_product(spark, d):
    found = durable(batch.apply_to_groups(_by_label(spark, d), "QR"), "qr")
    parts = [_side(found.where(f"result like '%.{name}'"), side) for side, name in enumerate("QR")]
    return _told(batch.apply_to_groups(parts[0].unionByName(parts[1]), "blockmult"))


@query(f"WITH {_LABELLED} SELECT a.dataset, CAST(a.j AS BIGINT) AS i, CAST(63 - b.j AS INTEGER) AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM x a JOIN x b USING (dataset, vec_id) GROUP BY ALL")
def batch_crossprod_of_two(spark, d):
    cells = _by_label(spark, d)
    return _told(batch.apply_to_groups(_side(cells, 0).unionByName(_side(cells.withColumn("j", 63 - F.col("j")), 1)), "CrossProd_double"))


@query(f"WITH {_LABELLED} {_PLUS_ONE}")
def batch_chol(spark, d):
    return _told(batch.apply_to_groups(_side(batch.apply_to_groups(_gram_plus_one(spark, d), "descChol"), 0), "CrossProd"))


@query(f"WITH {_LABELLED} SELECT a.dataset, CAST(a.j AS BIGINT) AS i, CAST(c AS INTEGER) AS j, round(sum(v * ((j * 3 + c) % 5)), 5) + 0.0 AS v FROM x a, range(3) AS r(c) GROUP BY ALL")
def batch_solve(spark, d):
    # (G + 1) X = t(A) W, and (G + 1) X again
    cells, g = _by_label(spark, d), durable(_gram_plus_one(spark, d), "gram")
    right = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).groupBy("dataset", F.col("j").cast("long").alias("i"), F.col("c").alias("j")).agg(F.sum(F.col("v") * ((F.col("j") * 3 + F.col("c")) % 5)).alias("v"))
    x = batch.apply_to_groups(g.unionByName(_side(right, 1)), "solve")
    return _told(batch.apply_to_groups(g.unionByName(_side(x, 1)), "blockmult"))


@query(f"WITH {_LABELLED} {_PLUS_ONE}")
def batch_inverse(spark, d):
    # the inverse of the inverse
    inverse = batch.apply_to_groups(_gram_plus_one(spark, d), "invChol")
    return _told(batch.apply_to_groups(_side(inverse, 0), "invChol"))


@query(f"WITH {PC} SELECT i, j, v FROM pc")
def store_round_trip(spark, d):
    store = Store(spark, _folder(spark))
    store.write("parts/raw", pt(spark, d), attributes={"source": "part"})
    store.move("parts/raw", "parts/moved")
    return _cells(store.open("parts/moved"))


@query("SELECT 'a/parts' AS name, count(*) AS nrow, CAST(2 AS BIGINT) AS ncol FROM part UNION ALL SELECT 'a/vectors', count(*), CAST(max(len(embedding)) AS BIGINT) FROM embeddings UNION ALL SELECT 'b/c/suppliers', count(DISTINCT l_suppkey), CAST(7 AS BIGINT) FROM lineitem")
def store_list(spark, d):
    store = Store(spark, _folder(spark))
    for name, m in (("a/parts", pt), ("a/vectors", em), ("b/c/suppliers", sp), ("b/gone", pt)):
        store.write(name, m(spark, d))
    store.remove("b/gone")
    return store.list()


@query(f"WITH {EM} SELECT j, count(*) * 2 AS n, round(2 * sum(v), 5) + 0.0 AS v FROM ec GROUP BY j")
def store_append(spark, d):
    store, m = Store(spark, _folder(spark)), em(spark, d)
    store.write("vectors/twice", m)
    found = store.append("vectors/twice", m)
    return aggregates.col_sums(found).select("j", F.lit(found.nrow).cast("long").alias("n"), (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {PC} SELECT i, j, v, 'part' AS source, CASE j WHEN 0 THEN 'size' ELSE 'price' END AS name FROM pc")
def store_copy(spark, d):
    store, other = Store(spark, _folder(spark)), Store(spark, _folder(spark))
    store.write("parts/raw", pt(spark, d).with_labels(cols=["size", "price"]))
    store.set_attribute("parts/raw", "source", "part")
    copied = store.copy_to("parts/raw", other, "copied/raw")
    cells = _cells(copied).withColumn("source", F.lit(other.attributes("copied/raw")["source"]))
    return cells.join(F.broadcast(copied.col_labels.withColumnRenamed("idx", "j")), "j")


@query(f"WITH {PC} SELECT i, j, round(6 * v, 6) AS v FROM pc")
def store_reduce_group(spark, d):
    store, m = Store(spark, _folder(spark)), pt(spark, d)
    for k in (1, 2, 3):
        store.write(f"parts/times {k}", elementwise.scalar_product(m, k))
    return _cells(api.reduce_group(store, "parts"))


@query(f"WITH {PC} SELECT i, j, v FROM pc")
def store_import(spark, d):
    folder = _folder(spark)
    write_text(pt(spark, d), f"{folder}/parts.csv", files=3)
    return _cells(api.import_into(Store(spark, _folder(spark)), f"{folder}/parts.csv", "text/parts"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/matloom/{uuid.uuid4().hex}"


@query(f"WITH {PC} SELECT i, j, v FROM pc")
def text_import(spark, d):
    path = f"{_folder(spark)}/parts.csv"
    write_text(pt(spark, d), path, files=7)
    return _cells(read_text(spark, path))


@query(f"WITH {LC} SELECT j, count(v) AS n, round(sum(v), 2) AS sum, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd FROM lc GROUP BY j")
def stream_col_stats(spark, d):
    schema = _table(spark, d, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem*.parquet").parquet(d)
    name = "col_stats_" + d.replace("/", "_").replace(".", "_")
    running_col_stats(stream, MEASURES).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return _rounded(_rounded(spark.table(name), 2, "sum"), 4, "mean", "sd").withColumn("n", F.col("n").cast("long"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, 0 AS j, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_windows(spark, d):
    stream = spark.readStream.schema(_table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    name = "windows_" + uuid.uuid4().hex
    windowed_col_stats(stream, ["value"], "ts", "1 day", "7 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.table(name).select(F.unix_timestamp("window.start").alias("day"), "j", F.col("n").cast("long").alias("n"), "mean"), 6, "mean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
