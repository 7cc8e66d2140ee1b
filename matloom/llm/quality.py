"""Quality: votes of the nearest labelled neighbours in a latent-semantic space.

Terms of a text: its words, their shapes (letters, capitals and digits as runs, signs as they are), neighbouring shapes,
and how much of it repeats (words, lines) in steps of a tenth. Hashed counts, weighted by logarithm and inverse document
frequency, are projected by a truncated singular value decomposition of the labelled rows. The labelled vectors, at
most ``sample`` (4000 by default) of ``rank`` numbers each, are broadcast; every document meets all of them in blocks of
exact cosine products, and its ``neighbours`` nearest vote with their label, weighted by similarity.

Defined cases: a null or empty text has no terms, all similarities are 0 and its score is the labels' mean; without
labelled rows every score is 1; rows with null or repeated ids are scored like others (of labelled ones with equal ids and
labels the least counts are learned); an empty table gives an empty result; labels, language, source and id are never
inputs; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from matloom.llm.common import bounded_sample, fold, own_cache, texts_for_python, unused

TERMS = 4096
BLOCK = 256
_KEPT = 150_000
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"))


def _shape(token: str) -> str:
    def letters(m: re.Match) -> str:
        run = m.group()
        return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() and run[1:].islower() else "A" if run.isupper() else "x"

    return _RUNS[1][0].sub("0", _RUNS[0][0].sub(letters, token))


class _Terms(dict):
    """(term of the word, term of its shape, number of its shape) of distinct tokens."""

    def __missing__(self, token: str) -> tuple[int, int, int]:
        if len(self) > _KEPT:
            self.clear()
        shape = _shape(token)
        number = crc32(shape.encode("utf-8", "surrogatepass"))
        word = crc32(b"w" + token.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")) % (TERMS // 2)
        self[token] = value = (word, TERMS // 2 + number % (TERMS // 4), number)
        return value


_terms = _Terms()


def term_counts(text: str) -> np.ndarray:
    """Counts of the hashed terms of a text."""
    own_cache("terms", _terms.clear)
    tokens = text.split()
    if not tokens:
        return np.zeros(TERMS, np.float32)
    found = np.array([_terms[t] for t in tokens], np.int64)
    pairs = (found[:-1, 2] * 31 + found[1:, 2] * 1009) % (TERMS // 4 - 32) + 3 * TERMS // 4
    counts = np.bincount(np.concatenate([found[:, 0], found[:, 1], pairs]), minlength=TERMS).astype(np.float32)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    novel = len(set(tokens)) / len(tokens) ** 0.9
    counts[TERMS - 32 + min(9, int(10 * repeated))] += len(tokens)
    counts[TERMS - 20 + min(9, int(10 * novel))] += len(tokens)
    return counts


@dataclass
class Neighbours:
    weights: np.ndarray  # of terms
    project: np.ndarray  # terms x rank
    vectors: np.ndarray  # of labelled rows, of length 1
    labels: np.ndarray
    count: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        scaled = np.log1p(counts) * self.weights
        scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
        found = scaled @ self.project
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        likeness = vectors @ self.vectors.T
        count = min(self.count, likeness.shape[1])
        nearest = np.argpartition(-likeness, count - 1, axis=1)[:, :count]
        weight = np.maximum(np.take_along_axis(likeness, nearest, 1), 0).astype(float) ** 4
        total = weight.sum(1)
        voted = (weight * self.labels[nearest]).sum(1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-12, voted, self.labels.mean()), 0, 1)


def decompose(matrix: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    rank = max(1, min(rank, *matrix.shape))
    basis = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(matrix.shape[1], rank + 8))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


def train(counts: np.ndarray, labels: np.ndarray, *, rank: int = 48, neighbours: int = 15) -> Neighbours | None:
    if not len(labels):
        return None
    seen = (counts > 0).sum(0)
    weights = (np.log((1 + len(counts)) / (1 + seen)) + 0.3).astype(np.float32)
    scaled = np.log1p(counts) * weights
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    model = Neighbours(weights, decompose(scaled, rank), np.zeros((0, rank), np.float32), np.asarray(labels, float), neighbours)
    model.vectors = model.embed(counts)
    return model


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"].tolist():
            counts = term_counts(text)
            at = np.flatnonzero(counts)
            rows.append((at.astype(np.int32).tobytes(), counts[at].tobytes()))
        yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "at": [r[0] for r in rows], "counts": [r[1] for r in rows]})


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, sample: int = 4000, rank: int = 48, neighbours: int = 15) -> Neighbours | None:
    """The labelled vectors, from at most ``sample`` labelled rows outside the held-out fold."""
    usable = labels.where((fold("doc_id", folds) != held) & F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null").distinct()
    picked = bounded_sample(usable, sample, "id")
    texts = texts_for_python(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    counted = texts.select("id", "label", "text").mapInPandas(_counted, "id long, label int, at binary, counts binary").groupBy("id", "label").agg(F.min(F.struct("at", "counts")).alias("k"))
    rows = sorted(counted.select("id", "label", "k.*").collect(), key=lambda r: (r["id"], r["label"]))
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    return train(counts, np.array([r["label"] for r in rows]), rank=rank, neighbours=neighbours)


def score_texts(model: Neighbours, texts: list[str]) -> np.ndarray:
    found = [model.vote(model.embed(np.stack([term_counts(t) for t in texts[at : at + BLOCK]]))) for at in range(0, len(texts), BLOCK)]
    return np.round(np.concatenate(found), 5) if found else np.zeros(0)


def with_quality(df: DataFrame, model: Neighbours | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score of each row's text in ``score_col`` (which replaces a column of that name)."""
    df = texts_for_python(df).drop(score_col)
    if model is None:
        return df.withColumn(score_col, F.lit(1.0))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by `sample`, `rank` and the number of terms

    scored = unused(df, "_scored")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{score_col: score_texts(shared.value, frame[scored].tolist())}).drop(columns=scored)

    schema = StructType([*df.schema.fields]).add(score_col, DoubleType())
    return df.withColumn(scored, F.coalesce(F.col(text_col), F.lit(""))).mapInPandas(score, schema)
