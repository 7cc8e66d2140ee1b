"""Byte-pair encoding and decoding by an index of pair occurrences.

Method: a task collects the distinct words of its texts and keeps, for each mergeable pair of neighbouring symbols,
the list of all its positions in all of them. Ranks with occurrences are taken in ascending order from a heap; a rank
is applied at all its positions at once, from left to right, and only the lists of the pairs beside them change. A
merge's symbol is made by no other merge, so pairs with it have higher ranks and each rank is taken once (checked when
the vocabulary is loaded; other vocabularies are refused). Ids of words are kept by the worker for its later tasks.

Words: white space always separates them, so a text is cut at spaces and line ends; the file's own normalizer and
pre-tokenizer are applied to each distinct piece. Strings of special tokens are found first, as the library does.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows with null or repeated ids are
encoded like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import own_cache, texts_for_python
from matloom.llm.token_cache import GROUP_CHARS, default_path

#: Distinct pieces of text whose ids a worker keeps, and bytes of them and of their words; beyond either it starts anew.
KEPT, KEPT_BYTES = 600_000, 400_000_000
#: What an entry takes besides its text, and a character in all (as a piece, as a word, as ids of both).
_ENTRY_BYTES, _CHAR_BYTES = 300, 16
#: Pieces of plain Latin letters, digits and signs alone: composed already, with the same classes in every library.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
_coders: dict[str, "PairIndexCoder"] = {}
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian integers of 32 bits")


def _size(pieces: list[str]) -> int:
    return _ENTRY_BYTES * len(pieces) + _CHAR_BYTES * sum(map(len, pieces))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, others for letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = byte_letters()


class PairIndexCoder:
    """Encodes and decodes as the tokenizers library does with the file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.decoder = library.normalizer, library.pre_tokenizer, library.decoder
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("added tokens or a model of this kind are not supported")
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: list[int] = []
        maker: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if made in maker or max(maker.get(left, -1), maker.get(right, -1)) >= rank:
                raise ValueError("a symbol is made twice or used before it is made")
            maker[made] = self.rank[left, right] = rank
            self.left.append(left)
            self.right.append(right)
            self.made.append(made)
        self.plain = self._plain_pattern(spec)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _plain_pattern(spec: dict):
        """The file's own pattern if it composes and lower-cases texts, joins white space and matches words bytewise."""
        import regex

        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]:
            split, letters = cuts
            if split["behavior"] == "Removed" and split["invert"] and not letters["add_prefix_space"] and not letters["use_regex"]:
                return regex.compile(split["pattern"]["Regex"])
        return None

    @classmethod
    def of(cls, path: str) -> "PairIndexCoder":
        if path not in _coders:
            _coders[path] = cls(path)
        own_cache(f"bpe {path}", _coders[path].clear)
        return _coders[path]

    def clear(self) -> None:
        self.pieces.clear()
        self.words.clear()
        self.held = 0

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by one pair index over all of them."""
        vocab, rank, suffix = self.vocab, self.rank, self.suffix
        symbols: list[int] = []
        starts: list[int] = []
        for word in words:
            starts.append(len(symbols))
            if word:
                symbols += [vocab.get(c, -1) for c in word[:-1]]
                symbols.append(vocab.get(word[-1] + suffix, -1))
            symbols.append(-1)  # no pair goes beyond a word
        size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        places: dict[int, list[int]] = {}
        get = rank.get
        for at, found in enumerate(map(get, zip(symbols, symbols[1:]))):
            if found is not None:
                if found in places:
                    places[found].append(at)
                else:
                    places[found] = [at]
        active = list(places)
        heapq.heapify(active)
        while active:
            now = heapq.heappop(active)
            a, b, made = self.left[now], self.right[now], self.made[now]
            where = places.pop(now)
            where.sort()
            for at in where:
                if symbols[at] != a:
                    continue
                gone = after[at]
                if symbols[gone] != b:
                    continue
                symbols[at] = made
                symbols[gone] = -2
                beyond = after[gone]
                after[at] = beyond
                before[beyond] = at
                found = get((made, symbols[beyond]))
                if found is not None:
                    if found in places:
                        places[found].append(at)
                    else:
                        places[found] = [at]
                        heapq.heappush(active, found)
                ahead = before[at]
                if ahead >= 0:
                    found = get((symbols[ahead], made))
                    if found is not None:
                        if found in places:
                            places[found].append(ahead)
                        else:
                            places[found] = [ahead]
                            heapq.heappush(active, found)
        ends = [s - 1 for s in starts[1:]] + [size - 1]
        return [[x for x in symbols[s:e] if x >= 0] for s, e in zip(starts, ends)]

    def _split(self, piece: str) -> list[str | int]:
        """Pre-tokens (in the byte alphabet) and ids of special tokens."""
        if self.plain is not None and _PLAIN.fullmatch(piece) and not (self.cut and self.cut.search(piece)):
            words = self.plain.findall(piece.lower())
            return [w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in words]
        found: list[str | int] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                text = self.normalizer.normalize_str(part) if self.normalizer else part
                found += [t for t, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        return found

    def learn(self, pieces: set[str]) -> None:
        """Make ``self.pieces`` hold the ids of all of ``pieces``, as bytes."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > KEPT or self.held + _size(new) > KEPT_BYTES:
            self.clear()
            new = list(pieces)
        self.held += _size(new)
        split = [self._split(p) for p in new]
        unknown = list({w for s in split for w in s if w.__class__ is str and w not in self.words})
        self.words.update(zip(unknown, [array("I", ids).tobytes() for ids in self.merge(unknown)]))
        for piece, parts in zip(new, split):
            told = [self.words[part] if part.__class__ is str else array("I", [part]).tobytes() for part in parts]
            self.pieces[piece] = told[0] if len(told) == 1 else b"".join(told)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text its ids as bytes."""
        at = 0
        while at < len(texts):
            group, chars, distinct = [], 0, set()
            while at < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[at])
                group.append(texts[at].replace("\n", " ").split(" "))
                distinct.update(group[-1])
                at += 1
            self.learn(distinct)
            for split in group:
                yield b"".join(map(self.pieces.__getitem__, split))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; ids that the vocabulary doesn't have are passed over."""
        tokens = [t for t in map(self.tokens.get, ids.tolist()) if t is not None]
        return self.decoder.decode(tokens) if self.decoder else " ".join(tokens)


def encode_and_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``keep``, ``ids`` (bytes) and ``decoded`` of every row."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PairIndexCoder.of(path)
        for frame in frames:
            rows = []
            for ids in coder.encode(frame["text"].tolist()):
                text = coder.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *((ids, text) if keep else ())))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").values)
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    return texts_for_python(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(code, schema)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, decoded`` of ids held as bytes of little-endian unsigned 32-bit integers; null: no ids."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PairIndexCoder.of(path)
        for frame in frames:
            texts = [coder.decode(np.frombuffer(bytes(x or b""), "<u4")) for x in frame["ids"].tolist()]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "decoded": texts})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(decode, "doc_id long, decoded string")
