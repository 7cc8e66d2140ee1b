"""Token ids in files: each document's ids are one zstandard frame, all under a shared trained dictionary.

Format: a Parquet table of blocks; its files, and the blocks in a file, are in ascending id order. A block has its first
and last id (Parquet's statistics of these let a reader skip files), the hash of its dictionary, the bytes of an id
(2, or 4 if the vocabulary is larger), the frames one after the other (``payload``) and the offset index (``doc_ids,
offsets, counts``), so that a short document is read by decompressing its frame alone. Ids are serialized as
little-endian integers. The dictionary is a table of its own, one row, found by its hash. Everything is written and read
by Spark; Spark's range partitioner deals the texts by id and, among equal or missing ones, by their hash.

The dictionary is trained on at most ``sample`` documents (1000 by default), of each of them on at most ``SPREAD`` blocks
of ``BLOCK_IDS`` ids, spread evenly over the whole document: documented bounds. With too few documents there is none, and
its hash is ``-``.

Defined cases: a null or empty text has only the end id; rows with equal ids are kept, one after the other; rows
without an id come last; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import bounded_sample, shared_folder, texts_for_python
from matloom.llm.token_cache import default_path, id_bytes

BLOCKS = "part int, block int, first_id long, last_id long, start long, n_tokens long, width int, dictionary string, doc_ids array<long>, offsets array<long>, counts array<long>, payload binary"
#: A block is closed when its frames reach so many bytes.
BLOCK_BYTES = 1 << 20
#: What the dictionary sees of a document: so many blocks of so many ids.
SPREAD, BLOCK_IDS = 4, 4096


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A zstandard dictionary, or no bytes if there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest() if data else "-"


def _zdict(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 if all of the vocabulary's ids and the end id fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max([end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()]) < 1 << 16 else 4


def spread_blocks(ids: np.ndarray, size: int = BLOCK_IDS, most: int = SPREAD) -> list[np.ndarray]:
    """The whole array if it has at most ``most`` blocks of ``size``, else so many, evenly spread from end to end."""
    if len(ids) <= size * most:
        return [ids]
    return [ids[at : at + size] for at in np.linspace(0, len(ids) - size, most).astype(int)]


def write_store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = 0, sample: int = 1000) -> None:
    """Encode every text and write the store to the folder ``path``."""
    spark, tokenizer = df.sparkSession, tokenizer or default_path("byte_bpe_50k.json")
    texts = texts_for_python(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width = id_width(tokenizer, end_id)
    end, kind = np.array([end_id], "<u4").tobytes(), f"<u{width}"

    def serialized(values: list[str]) -> Iterator[np.ndarray]:
        for ids in id_bytes(tokenizer, values):
            yield np.frombuffer(ids + end, "<u4").astype(kind)

    def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"block": [x.tobytes() for ids in serialized(frame["text"].tolist()) for x in spread_blocks(ids)]})

    chosen = F.broadcast(bounded_sample(texts.select("doc_id").where("doc_id is not null").distinct(), sample, "doc_id"))
    picked = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("text").mapInPandas(blocks_of, "block binary")
    data = train_dictionary(sorted(bytes(r["block"]) for r in picked.collect()))  # at most `sample` times SPREAD blocks
    spark.createDataFrame([(dictionary_hash(data), data)], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    name = dictionary_hash(data)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False, write_dict_id=False, **_zdict(data))
        part, block, start, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pd.DataFrame:
            ids, counts, frames_ = (list(x) for x in zip(*rows))
            there = [x for x in ids if x is not None]
            one = {"part": part, "block": block, "first_id": min(there, default=None), "last_id": max(there, default=None), "start": start, "n_tokens": sum(counts), "width": width, "dictionary": name, "doc_ids": there, "offsets": [0, *np.cumsum(list(map(len, frames_))).tolist()], "counts": counts, "payload": b"".join(frames_)}
            found = pd.DataFrame({k: [v] for k, v in one.items()})
            return found.astype({"first_id": "Int64", "last_id": "Int64"})

        for frame in frames:
            own = [None if x is pd.NA else x for x in frame["doc_id"].astype("Int64").tolist()]
            for doc_id, ids in zip(own, serialized(frame["text"].tolist())):
                if size >= BLOCK_BYTES:
                    yield close()
                    block, start, rows, size = block + 1, start + sum(r[1] for r in rows), [], 0
                rows.append((doc_id, len(ids), packer.compress(ids.tobytes())))
                size += len(rows[-1][2])
        if rows:
            yield close()

    tied = texts.withColumn("tie", F.xxhash64("text"))
    order = (F.asc_nulls_last("doc_id"), F.asc("tie"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    dealt.mapInPandas(build, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r["hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one row


def read_store(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of each document, decompressed from the files.

    ``ids`` are the bytes of little-endian unsigned 32-bit integers."""
    data = _dictionaries(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    bases, base = {}, 0
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row for each file
        bases[part], base = base, base + n

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpackers = {k: zstandard.ZstdDecompressor(**_zdict(v)) for k, v in data.items()}
        for frame in frames:
            for r in frame.itertuples(index=False):
                starts = bases[r.part] + r.start + np.concatenate([[0], np.cumsum(r.counts)])[:-1]
                out, view, crcs, counts = [], memoryview(r.payload), [], []
                for a, b in zip(r.offsets[:-1], r.offsets[1:]):
                    found = np.frombuffer(unpackers[r.dictionary].decompress(view[int(a) : int(b)]), f"<u{r.width}").astype("<u4").tobytes()
                    crcs.append(zlib.crc32(found))
                    counts.append(len(found) // 4)
                    if ids:
                        out.append(found)
                names = pd.array([*map(int, r.doc_ids), *[None] * (len(counts) - len(r.doc_ids))], "Int64")  # missing ids are the last
                yield pd.DataFrame({"doc_id": names, "start": starts, "n_tokens": counts, "ids_crc32": crcs} | ({"ids": out} if ids else {}))

    return blocks.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """One document's ids: files and row groups whose range of ids can't have it are skipped by their statistics, and
    only its own frame is decompressed."""
    wanted = F.lit(doc_id).cast("long")
    there = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= wanted) & (F.col("last_id") >= wanted) & F.array_contains("doc_ids", wanted))
    row = there.orderBy("part", "block").limit(1).select("dictionary", "width", F.array_position("doc_ids", wanted).alias("k"), "offsets", "payload").first()
    if row is None:
        return None
    k = row["k"] - 1
    frame = bytes(row["payload"])[row["offsets"][k] : row["offsets"][k + 1]]
    return np.frombuffer(zstandard.ZstdDecompressor(**_zdict(_dictionaries(spark, path)[row["dictionary"]])).decompress(frame), f"<u{row['width']}").astype(np.uint32)


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True, **options) -> DataFrame:
    """Write the store to a new folder in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/matloom/store-{uuid.uuid4().hex}"
    write_store(df, path, id_col, text_col, **options)
    return read_store(df.sparkSession, path, ids=ids)
