"""Token counts, token store, packing and byte-pair encoding against the tokenizers library."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matloom.llm import packing, token_cache, token_store
from matloom.llm.bpe import PairIndexCoder, decode_ids, encode_and_decode
from matloom.llm.token_counts import count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
byte_level, word_level = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
texts = st.lists(st.text(st.sampled_from(list("abcABC 0'.,s\n\t é́中\U0001f600\x1c\x85 <|>")) | st.characters(codec="utf-8"), max_size=40), max_size=6)


def ids(text, library=byte_level):
    return library.encode(text or "", add_special_tokens=False).ids


@given(texts)
@settings(max_examples=150, deadline=None)
def test_cached_pieces_are_the_librarys(some):
    assert [np.frombuffer(b, "<u4").tolist() for b in token_cache.id_bytes(BYTES, some)] == [ids(t) for t in some]


@given(texts)
@settings(max_examples=150, deadline=None)
def test_pair_index_is_the_librarys(some):
    some = some + ["aaaaaaa abababab mississippi", "<|endoftext|>x<|startoftext|>"]
    coder = PairIndexCoder.of(WORDS)
    for text, got in zip(some, coder.encode(some)):
        expected = ids(text, word_level)
        assert np.frombuffer(got, "<u4").tolist() == expected
        assert coder.decode(np.frombuffer(got, "<u4")) == word_level.decode(expected, skip_special_tokens=False)


def test_pair_index_with_a_byte_level_file():
    coder = PairIndexCoder.of(BYTES)
    for piece in ("hello", "zzzzzzzz", "unbelievable"):
        coder.learn({piece})
        assert np.frombuffer(coder.pieces[piece], "<u4").tolist() == ids(piece)
    assert coder.decode(np.array(ids("hello there"), np.uint32)) == "hello there"


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_cache, "KEPT", 3)
    monkeypatch.setattr(token_cache, "GROUP_CHARS", 1)
    some = ["a b c d e f", "g h, i", "a b", "", "c\n\nd"]
    assert list(token_cache.id_counts(BYTES, some)) == [len(ids(t)) for t in some]
    assert [np.frombuffer(b, "<u4").tolist() for b in token_cache.id_bytes(BYTES, some)] == [ids(t) for t in some]


def test_texts_with_blank_lines_share_their_pieces():
    index = token_cache.PretokenIndex(BYTES, False)
    list(index.numbered(["the same words, again.\n\nthe same  words", "the same words; again.\n\nthe same  words\n"]))
    assert b" words" in index.numbers and b"," in index.numbers and len(index.numbers) < 14
    assert sum(map(len, index.numbers)) < 80


def test_special_strings_that_hold_a_border_are_kept_whole(tmp_path):
    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 60000, "content": "end.of", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    some = ["the end.of it, the end. of it", "end.of", "no such thing."]
    library = Tokenizer.from_file(str(path))
    assert [np.frombuffer(b, "<u4").tolist() for b in token_cache.id_bytes(str(path), some)] == [ids(t, library) for t in some]


def test_wide_spaces_stay_within_a_piece():
    some = ["a\u3000 b", "a\u2003\u2028 b\u00a0c \u1680d", "\u0085 x", "é \u00e9 ́ y", "a \u205f", "\u3000", "x\u00a0"]
    assert [np.frombuffer(b, "<u4").tolist() for b in token_cache.id_bytes(BYTES, some)] == [ids(t) for t in some]


def test_a_tokenizer_of_another_kind_gets_whole_texts(odd):
    some = [r["text"] or "" for r in odd.collect()]
    assert list(token_cache.id_counts(WORDS, some)) == [len(ids(t, word_level)) for t in some]


def test_counts(odd, none):
    rows = count_tokens(odd, limit=5).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for r in odd.collect():
        assert by[r["doc_id"]]["n_tokens"] == len(ids(r["text"])) and by[r["doc_id"]]["n_bytes"] == len((r["text"] or "").encode())
        assert by[r["doc_id"]]["over_limit"] == (len(ids(r["text"])) > 5)
    assert count_tokens(none).count() == 0


def test_encode_and_decode(odd, none):
    got = {r["doc_id"]: r for r in encode_and_decode(odd).collect()}
    for r in odd.collect():
        expected = ids(r["text"], word_level)
        text = word_level.decode(expected, skip_special_tokens=False)
        row = got[r["doc_id"]]
        assert row["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest() and row["decoded"] == text and row["n_tokens"] == len(expected)
    decoded = {r["doc_id"]: r["decoded"] for r in decode_ids(encode_and_decode(odd)).collect()}
    assert decoded == {k: v["decoded"] for k, v in got.items()}
    assert encode_and_decode(none).count() == 0


def test_store(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd, path)
    rows = token_store.read_store(spark, path).collect()
    assert len(rows) == odd.count()
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == [*sorted(x for x in order if x is not None), None]
    wanted = Counter((r["doc_id"], zlib.crc32(np.array(ids(r["text"]) + [0], "<u4").tobytes())) for r in odd.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == wanted
    assert token_store.read_document(spark, path, 1).tolist() == ids(odd.where("doc_id = 1").first()["text"]) + [0]
    assert token_store.read_document(spark, path, 999) is None
    assert token_store.store_and_read(none).count() == 0


def test_store_uses_its_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(k, f"the same words come again and again in number {k} of these texts, and again") for k in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(df, path)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert row["hash"] == token_store.dictionary_hash(bytes(row["data"])) != "-"
    held = spark.read.parquet(f"{path}/blocks").selectExpr("sum(length(payload))").first()[0]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(np.array(ids(r["text"]) + [0], "<u2").tobytes())) for r in df.collect())
    assert held < 0.8 * alone
    assert {r["n_tokens"] for r in token_store.read_store(spark, path).collect()} == {len(ids(r["text"])) + 1 for r in df.collect()}


def test_store_is_in_order_and_indexed(spark, tmp_path):
    df = spark.createDataFrame([(k * 7 % 4001, f"text number {k}") for k in range(4001)] + [(10**15, "far"), (None, "none"), (None, None)], "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/store"
    token_store.write_store(df, path)
    files = spark.read.parquet(f"{path}/blocks").selectExpr("_metadata.file_name f", "part", "block", "first_id", "last_id", "width").orderBy("f", "block").collect()
    assert len({r["f"] for r in files}) > 2 and {r["width"] for r in files} == {2}
    bounds = [x for r in files for x in (r["first_id"], r["last_id"]) if x is not None]
    assert bounds == sorted(bounds) and [r["part"] for r in files] == sorted(r["part"] for r in files)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = spark.read.parquet(f"{path}/blocks").where("first_id <= 5 and last_id >= 5")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(first_id,5)" in plan and "GreaterThanOrEqual(last_id,5)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert token_store.read_document(spark, path, 10**15).tolist() == ids("far") + [0]
    rows = token_store.read_store(spark, path, ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [*range(4001), 10**15, None, None]


def test_wide_ids(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(df, path, end_id=70000)
    assert token_store.read_document(spark, path, 2).tolist() == ids("three") + [70000]
    assert [len(b) for b in token_store.spread_blocks(np.arange(100_000))] == [4096] * 4
    assert token_store.spread_blocks(np.arange(100_000))[-1][-1] == 99_999


def check_packed(rows, expected, window):
    """Pieces cover each document's ids once, and sequences have no gaps."""
    seen = Counter()
    for r in rows:
        seen[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    wanted = Counter()
    for doc_id, own in expected:
        for at in range(0, len(own), window):
            part = own[at : at + window]
            wanted[doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(own)] += 1
    assert seen == wanted
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= window
    return held


@pytest.mark.parametrize("window", [16, 61, 64, 2048])
def test_packing(odd, window):
    rows = packing.pack(odd, window=window).collect()
    check_packed(rows, [(r["doc_id"], ids(r["text"]) + [1]) for r in odd.collect()], window)


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


@given(st.dictionaries(st.integers(1, 128), st.integers(1, 60), max_size=40))
@settings(max_examples=80, deadline=None)
def test_plans_hold_every_piece_once(histogram):
    patterns = packing.plan_patterns(histogram, 128)
    held = Counter()
    for slots, times in patterns:
        assert sum(m * u for m, u in slots) <= 128 and times > 0
        for m, u in slots:
            held[m] += u * times
    assert held == Counter(histogram)
    total, sequences = sum(m * n for m, n in histogram.items()), sum(t for _, t in patterns)
    assert sequences <= 2 * -(-total // 128) + 1


def test_least_squares_finds_exact_repeats():
    a = np.array([[1.0, 0, 2], [1, 1, 0], [0, 1, 1]])
    slots = np.array([[-1, 0, 1], [-1, 1, 2], [0, 0, 2]])
    x = packing.nonnegative_least_squares(slots, a @ [3.0, 0, 5])
    np.testing.assert_allclose(x, [3, 0, 5], atol=1e-8)
    assert (packing.nonnegative_least_squares(slots, np.array([-1.0, -2, -3])) == 0).all()


def test_many_equal_lengths_pack_tightly():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 2047, 20000).tolist())
    patterns = packing.plan_patterns(histogram, 2048)
    total, sequences = sum(m * n for m, n in histogram.items()), sum(t for _, t in patterns)
    assert sequences * 2048 < 1.02 * total
    odd_window = packing.plan_patterns(Counter(rng.integers(1, 2044, 20000).tolist()), 2045)
    assert sum(len(slots) > 1 for slots, _ in odd_window) > len(odd_window) / 2
    assert sum(t for _, t in odd_window) * 2045 < 1.02 * sum(m * u * t for slots, t in odd_window for m, u in slots)


def test_kept_bytes_are_bounded(monkeypatch):
    from matloom.llm import bpe
    from matloom.llm.token_cache import default_path

    monkeypatch.setattr(bpe, "KEPT_BYTES", 200_000)
    coder = bpe.PairIndexCoder(default_path("word_bpe_49k.json"))
    texts = [f"{'x' * 9000}{k} and word {k}" for k in range(30)]
    whole = [ids for t in texts for ids in coder.encode([t])]  # a group of texts is learnt at once
    assert coder.held <= 200_000 + 16 * 10_000 and sum(map(len, coder.pieces)) < 40_000
    monkeypatch.setattr(bpe, "KEPT_BYTES", 1 << 40)
    assert whole == list(bpe.PairIndexCoder(default_path("word_bpe_49k.json")).encode(texts))
