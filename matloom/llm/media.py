"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, difference hashes.

Method: P5/P6 (binary Netpbm, 8 bits) and uncompressed 24-bit BMP are decoded to arrays of height x width x channels;
an integral image gives every output cell of a resized tile as an exact mean over its (fractional) area; tiles are
NPY bytes; the difference hash compares neighbouring cells of a 9 x 8 grey tile.

A text as media: its UTF-8 bytes, blanks appended up to a positive multiple of 192, are the samples of a P6 image 64
pixels wide. ``stored`` writes a table of media to files; everything after that works on the bytes read back alone.

Defined cases: a null or empty text is one row of blanks; bytes that are no image of these kinds give nulls in all
decoded columns; repeated rows and null ids are kept; an empty table gives an empty result; columns that have the name
of a decoded one are replaced.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import durable, texts_for_python

ROW = 192


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three."""
    height, width, channels = pixels.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + pixels.astype(np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("neither P5 nor P6")
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if most != 255:
        raise ValueError("samples of 8 bits only")
    channels = 1 if data[:2] == b"P5" else 3
    return np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed, 24 bits, bottom row first."""
    height, width, channels = pixels.shape
    if channels == 1:
        pixels = np.repeat(pixels, 3, 2)
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    start = struct.unpack_from("<I", data, 10)[0]
    width, height, planes, bits, compression = struct.unpack_from("<iiHHI", data, 18)
    if bits != 24 or compression or planes != 1 or width <= 0:
        raise ValueError("uncompressed images of 24 bits only")
    stride = -(-width * 3 // 4) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * 3]
    return (rows[::-1] if height > 0 else rows).reshape(abs(height), width, 3)[:, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of the output's cells, from the integral image, in float64."""
    rows, columns, _ = pixels.shape
    integral = np.zeros((rows + 1, columns + 1, pixels.shape[2]))
    np.cumsum(pixels, 0, out=integral[1:, 1:], dtype=float)
    np.cumsum(integral[1:, 1:], 1, out=integral[1:, 1:])

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    corners = at(np.linspace(0, columns, width + 1), 1, at(np.linspace(0, rows, height + 1), 0, integral))
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (rows / height * columns / width)


def npy_tile(pixels: np.ndarray, height: int, width: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, height, width)), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: whether a grey cell of the 9 x 8 tile is darker than the next one to its right."""
    grey = np.rint(area_resize(pixels, 8, 9).mean(2) * 4096)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, form: str = "netpbm") -> DataFrame:
    """``doc_id, n_bytes, media``: each text stored as an image (``netpbm`` or ``bmp``)."""
    encode = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [x.encode() for x in frame["text"].tolist()]
            media = [encode(np.frombuffer(payload_of(x), np.uint8).reshape(-1, ROW // 3, 3)) for x in texts]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_bytes": list(map(len, texts)), "media": media})

    return texts_for_python(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(store, "doc_id long, n_bytes long, media binary")


def stored(media: DataFrame) -> DataFrame:
    """``media`` written as a table of its own in the shared folder and read back."""
    return durable(media, "media")


def media_features(df: DataFrame, media_col: str = "media", *, tile: tuple[int, int] = (16, 16)) -> DataFrame:
    """``df`` (but its media column) with what reading the media gives: sizes, hashes, and the NPY ``tile``."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "height", "width", "channels", "feature", "tile"]
    df = texts_for_python(df).drop(*[c for c in df.columns if c.lower() in names])
    others = [f for f in df.schema.fields if f.name != media_col]

    def read(data: bytes | None) -> tuple:
        try:
            pixels = decode(bytes(data))
        except (TypeError, ValueError, struct.error):
            return (None,) * len(names)
        samples = pixels.tobytes()
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), *pixels.shape, difference_hash(pixels), npy_tile(pixels, *tile))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns=[media_col])
            found = list(zip(*map(read, frame[media_col].tolist()))) or [[]] * len(names)
            for name, values in zip(names, found):
                out[name] = pd.Series(list(values), index=frame.index, dtype="object" if name in ("payload_sha256", "media_sha256", "feature", "tile") else "Int64")
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return df.mapInPandas(features, kept + (", " if kept else "") + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, channels int, feature string, tile binary")
