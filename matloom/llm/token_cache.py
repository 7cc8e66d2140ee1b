"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once for a worker.

Texts are cut, as one array of bytes, where the byte-level pre-tokenizer always cuts as well, whatever stands around:
before a single blank or line end between two characters that aren't white space, and before one of ``,.;:!?)`` after a
Latin letter. Ids of a text are therefore those of its pieces one after the other. Runs of white space stay within a
piece. Tokenizers of another kind get whole texts.

New pieces that begin with a blank go to the library many at a time, as one text; a token whose string begins with the
blank's letter begins a piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from matloom.llm.common import own_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts are taken in groups of about so many characters, which bounds the lists of pieces in memory.
GROUP_CHARS = 1_000_000
#: Distinct pieces, and bytes of them, that a worker keeps; beyond it starts anew.
KEPT, KEPT_BYTES = 800_000, 32_000_000
#: New pieces that the library gets as one text.
JOINED = 500
#: White space beyond ASCII, as the first three bytes of its UTF-8 (two and a zero).
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in range(128, 1 << 14) if chr(c).isspace()])
_STOPPED = re.compile(r"[A-Za-z][,.;:!?)]")
_SOLID = np.array([33 <= b <= 126 or b >= 128 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_BREAK = np.isin(np.arange(256), [10, 32])
_STOP = np.isin(np.arange(256), list(b",.;:!?)"))
_indexes: dict[tuple[str, bool], "PretokenIndex"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _solid(data: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes belong to neither white space nor a control character."""
    solid = _SOLID[data]
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    at = at[at + 1 < len(data)]
    if len(at):
        lead, second = data[at].astype(np.int64), data[at + 1].astype(np.int64)
        third = np.where(lead == 0xC2, 0, data[np.minimum(at + 2, len(data) - 1)])
        wide = np.isin(lead << 16 | second << 8 | third, _WIDE_SPACES)
        at, lead = at[wide], lead[wide]
        solid[at] = solid[at + 1] = solid[at[lead != 0xC2] + 2] = False
    return solid


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes before which the pre-tokenizer always cuts."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    solid = _solid(data)
    blank = _BREAK[data[1:-1]] & solid[:-2] & solid[2:]
    stop = _STOP[data[1:-1]] & _LETTER[data[:-2]]
    return np.flatnonzero(blank | stop) + 1


class _Numbers(dict):
    """Numbers of distinct pieces; those that are new are listed."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class PretokenIndex:
    """The number of tokens of each distinct piece and, if ``keep_ids``, its ids."""

    def __init__(self, path: str, keep_ids: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.cuttable = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        self.cuttable = self.cuttable and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"] or len(t["content"].split()) != 1 or t["content"] != t["content"].strip() or _STOPPED.search(t["content"]) for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the letter that stands for a blank
        self.keep_ids = keep_ids
        self.clear()

    @classmethod
    def of(cls, path: str, keep_ids: bool) -> "PretokenIndex":
        """The worker's own index, kept from task to task."""
        if (path, keep_ids) not in _indexes:
            _indexes[path, keep_ids] = cls(path, keep_ids)
        index = _indexes[path, keep_ids]
        own_cache(f"tokens {path} {keep_ids}", index.clear)
        return index

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.held = 0
        #: by number: how many tokens a piece has, and where its ids begin
        self.counts = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = self.used_ids = 0

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens of each piece, where its ids begin, and all ids."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum([0, *map(len, pieces)])[:-1]
        counts, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        found: list[np.ndarray] = []
        have = 0
        words = np.zeros(len(pieces), bool)  # one blank, then nothing but solid characters
        if self.cuttable:
            words = (data[begins] == 32) & (np.add.reduceat(~_solid(data), begins) == 1) & (np.diff(np.append(begins, len(data))) > 1)
        rest, simple = [np.flatnonzero(~words)], np.flatnonzero(words)
        for at in range(0, len(simple), JOINED):
            own = simple[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([pieces[k] for k in own.tolist()]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.leads[ids])
            if len(first) != len(own) or first[0] != 0:
                rest.append(own)
                continue
            counts[own], starts[own] = np.diff(np.append(first, len(ids))), have + first
            found.append(ids)
            have += len(ids)
        left = np.concatenate(rest).tolist()
        for at in range(0, len(left), JOINED):  # what the library makes of them is large
            own = left[at : at + JOINED]
            for k, encoded in zip(own, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in own], add_special_tokens=False)):
                ids = np.array(encoded.ids, np.uint32)
                counts[k], starts[k] = len(ids), have
                found.append(ids)
                have += len(ids)
        return counts, starts, np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        counts, starts, ids = self._encoded(new)
        self.held += sum(map(len, new))
        upto = self.used + len(new)
        if upto > len(self.counts):
            self.counts = np.concatenate([self.counts[: self.used], np.zeros(upto, np.int32)])
            self.starts = np.concatenate([self.starts[: self.used], np.zeros(upto, np.int64)])
        self.counts[self.used : upto] = counts
        if self.keep_ids:
            self.starts[self.used : upto] = self.used_ids + starts
            if self.used_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used_ids], np.zeros(self.used_ids + len(ids), np.uint32)])
            self.ids[self.used_ids : self.used_ids + len(ids)] = ids
            self.used_ids += len(ids)
        self.used = upto

    def numbered(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each group of texts: the numbers of their pieces, in order, and where each text's pieces begin (with
        their end)."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[at])
                group.append(texts[at])
                at += 1
            coded = pa.array(group, pa.large_string())
            bounds = np.frombuffer(coded.buffers()[1], np.int64, len(group) + 1)
            data = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[: bounds[-1]]
            edges = np.sort(np.concatenate([bounds, safe_cuts(data)]), kind="stable") if self.cuttable else bounds  # merges two sorted runs
            edges = np.concatenate([edges[:1], edges[1:][edges[1:] > edges[:-1]]])
            if len(self.numbers) > KEPT or self.held > KEPT_BYTES:
                self.clear()
            if len(edges) > 1:
                pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
                distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
                own = np.fromiter(map(self.numbers.__getitem__, distinct), np.int32, len(distinct))
                self._learn()
                numbers = own[pieces.indices.to_numpy()]
            else:
                numbers = np.zeros(0, np.int32)
            yield numbers, np.searchsorted(edges, bounds)


def id_bytes(path: str, texts: list[str]) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    index = PretokenIndex.of(path, True)
    for numbers, bounds in index.numbered(texts):
        counts = index.counts[numbers].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(index.starts[numbers] - ends[:-1], counts)
        places += np.arange(ends[-1])
        ids = index.ids[places].astype("<u4")
        for start, end in zip(ends[bounds[:-1]], ends[bounds[1:]]):
            yield ids[start:end].tobytes()


def id_counts(path: str, texts: list[str]) -> Iterator[int]:
    """Each text's number of tokens: how often it has each distinct piece, joined to the pieces' counts, summed."""
    index = PretokenIndex.of(path, False)
    for numbers, bounds in index.numbered(texts):
        size = max(1, index.used)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        pairs, often = np.unique(owner * size + numbers, return_counts=True)
        document, piece = np.divmod(pairs, size)
        totals = np.bincount(document, often * index.counts[piece], len(bounds) - 1)
        yield from totals.astype(np.int64).tolist()
