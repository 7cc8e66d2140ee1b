"""The pipeline against its decisions made one by one."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from matloom.llm import quality, toxicity
from tests_llm_brute import brute, check_packed, ids

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """Rows of each stage, run one after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = [docs.collect()]
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        stages.append(docs.collect())
    return stages


def test_stages_keep_the_columns(spark, staged):
    columns = set(spark.read.parquet(f"{DATA}/documents.parquet").columns)
    assert all(set(rows[0].asDict()) == columns for rows in staged)
    assert [len(r) for r in staged] == sorted((len(r) for r in staged), reverse=True)


def test_toxic_and_poor_documents_go(spark, staged):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before, after, then = staged[:3]
    frame = spark.createDataFrame(before, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    net = toxicity.fit(frame, labels)
    scores = toxicity.score_texts(net, [r["text"] or "" for r in before]) if net else [0.0] * len(before)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, scores) if s < 0.7}
    model = quality.fit(spark.createDataFrame(after, frame.schema), labels)
    scores = quality.score_texts(model, [r["text"] or "" for r in after])
    assert {r["doc_id"] for r in then} == {r["doc_id"] for r, s in zip(after, scores) if s >= 0.3}


def test_one_of_each_group_stays(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged[2]]
    wanted = {d for d, _, c in brute(rows, 5, 80) if c == d}
    assert {r["doc_id"] for r in staged[3]} == wanted


def test_run_packs_what_is_left(spark, staged):
    rows = cp.run(spark, DATA).collect()
    check_packed(rows, [(r["doc_id"], ids(r["text"]) + [1]) for r in staged[3]], 2048)
    assert Counter(r["doc_id"] for r in rows).keys() == {r["doc_id"] for r in staged[3]}


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in __spark_entry__.queries()}


def folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_clashing_names(spark, odd, tmp_path):
    """Nulls, repeated rows, empty and long texts; without labels of both kinds nothing is toxic or poor."""
    where = folder(spark, tmp_path, odd, [(1, None, 0), (2, None, None), (None, 1, 1)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == odd.columns
    rows = cp.run(spark, where).collect()
    assert sorted({r["doc_id"] for r in rows}, key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None], key=str)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check_packed(rows, [(d, ids(t) + [1]) for d, t in texts.items() if d != 2], 2048)


def test_empty_table(spark, none, tmp_path):
    assert cp.run(spark, folder(spark, tmp_path, none, [(1, 1, 0)])).collect() == []
