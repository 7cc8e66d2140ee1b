"""Token counts: distinct pieces are counted once and summed by document, ids are never kept.

Method: a task cuts its texts where the pre-tokenizer always cuts as well, whatever stands around, so a piece is a run of one
or more whole pre-tokens, mostly a word with its blank. It numbers the distinct pieces, and the library counts the tokens of
each one once; a worker keeps counts while its cache lasts, so a piece is counted again by other workers or after the cache
has started anew, never for another document alone. A document's numbers become its frequencies, one row for each distinct
piece that it has; these are joined to the counts by number, multiplied and summed. Both sides of the join are columns of
numbers in the task: a shuffle of all documents' pieces would move more than the texts.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows with a null or repeated id are counted like
others, one row out for each row in; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import texts_for_python
from matloom.llm.token_cache import default_path, id_counts


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``df``."""
    path = tokenizer or default_path("byte_bpe_50k.json")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "n_tokens": pd.Series(list(id_counts(path, frame["text"].tolist())), dtype="int64")})

    texts = texts_for_python(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = texts.select("doc_id", "n_bytes", "text").mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
