import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from matloom.llm import media

pixels = arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3])))


@given(pixels)
@settings(max_examples=60, deadline=None)
def test_round_trips(a):
    assert (media.decode(media.encode_netpbm(a)) == a).all()
    assert (media.decode(media.encode_bmp(a)) == (a if a.shape[2] == 3 else np.repeat(a, 3, 2))).all()


@given(pixels, st.integers(1, 6), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_area_means(a, height, width):
    fine = np.repeat(np.repeat(a.astype(float), height, 0), width, 1)
    expected = fine.reshape(height, a.shape[0], width, a.shape[1], -1).mean((1, 3))
    np.testing.assert_allclose(media.area_resize(a, height, width), expected, atol=1e-8)


def test_header_with_comments():
    assert media.decode(b"P5\n# made by hand\n2 1\n255\n\x01\x02").ravel().tolist() == [1, 2]
    for wrong in (b"P3\n1 1\n255\n0", b"P5\n1 1\n65535\n\0\0", b"", b"BM", b"P6\n9 9\n255\nshort"):
        with pytest.raises(Exception):
            media.decode(wrong)


def test_texts(odd, none):
    for form in ("netpbm", "bmp"):
        rows = media.media_features(media.stored(media.with_media(odd, form=form))).collect()
        assert len(rows) == odd.count()
        for r in rows:
            text = next((x["text"] or "").encode() for x in odd.collect() if x["doc_id"] == r["doc_id"])
            payload = media.payload_of(text)
            assert len(payload) % 192 == 0 and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["n_bytes"] == len(text)
            assert np.load(io.BytesIO(bytes(r["tile"]))).shape == (16, 16, 3)
    assert media.media_features(media.with_media(none)).count() == 0


def test_what_is_no_image(spark):
    df = spark.createDataFrame([(1, b"no image"), (2, None), (3, media.encode_netpbm(np.zeros((2, 2, 1), np.uint8)))], "width2 long, media binary")
    rows = {r["width2"]: r for r in media.media_features(df).collect()}
    assert rows[1]["payload_bytes"] is None and rows[2]["feature"] is None and rows[3]["payload_bytes"] == 4


def test_columns_of_the_same_name_are_replaced(spark):
    df = spark.createDataFrame([("x", 5, media.encode_netpbm(np.zeros((2, 3, 1), np.uint8)))], "Feature string, height long, media binary")
    row = media.media_features(df).first()
    assert row["height"] == 2 and row["width"] == 3 and len(row["feature"]) == 16
