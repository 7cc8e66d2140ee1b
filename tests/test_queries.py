"""Every query of the matrix engine against its SQL in DuckDB."""

import duckdb
import pytest

from matloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert plain(ours).equals(plain(theirs))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 4 and "col_sums" in __spark_entry__.queries() and "col_sums" in __spark_entry__.oracle_sql()


def test_measures_reach_the_scan_alone(spark):
    plan = queries.queries()["col_sums"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == set(queries.MEASURES)
