"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import fold


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm import toxicity

    documents = _documents(spark, sf_dir)
    net = toxicity.fit(documents, _labels(spark, sf_dir))
    return _decided(toxicity.with_toxicity(documents.select("doc_id", "text"), net), 3, 1, 0.7)


def _decided(scored: DataFrame, folds: int, held: int, least: float) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.ngram_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir), words=4, percent=85)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.token_store import store_and_read

    return store_and_read(_documents(spark, sf_dir), ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.bpe import encode_and_decode

    return encode_and_decode(_documents(spark, sf_dir), keep=False)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.media import media_features, stored, with_media

    found = media_features(stored(with_media(_documents(spark, sf_dir))))
    return found.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm import quality

    documents = _documents(spark, sf_dir)
    model = quality.fit(documents, _labels(spark, sf_dir))
    return _decided(quality.with_quality(documents.select("doc_id", "text"), model), 5, 0, 0.3)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.licenses import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.fingerprint import compare_with_edits

    return compare_with_edits(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.vector_codes import vector_codes

    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.prefix_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matloom.llm.secrets import scan_secrets

    return scan_secrets(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_toxicity, op3_ngram_join, op4_token_store, op5_bpe, op6_media, op7_token_counts, op8_quality, op9_licenses, op10_fingerprints, op11_vector_codes, op12_prefix_trie, op13_secrets)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from matloom.llm import licenses, ngram_join, prefix_trie, secrets, vector_codes

    return {
        "op3_ngram_join": ngram_join.oracle(words=4, percent=85), "op9_licenses": licenses.oracle(), "op11_vector_codes": vector_codes.oracle(),
        "op12_prefix_trie": prefix_trie.oracle(), "op13_secrets": secrets.oracle(),
    }
