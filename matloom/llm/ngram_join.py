"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the components these links form.

Method
1. Each text becomes its set of word shingles (64-bit hashes, distinct, sorted). Documents with equal sets are one
   class; all later work is on classes.
2. Tiles. Two sets x and y link only if their sizes are near and their symmetric difference is at most
   d = |x| + |y| - 2 ceil(p(|x| + |y|) / (100 + p)). Sizes are banded (ratio 1.5). In a band the shingles are dealt by hash
   into K = d + 1 + s parts, d the band's largest and s a third of it, so linked sets have s + 1 equal parts at least. A
   tile is (band, part, hash of the part's shingles); a set enters the tiles of its own band and of the next one if a
   larger partner can be there. A set leaves out its s least parts, by number of shingles and then by hash: empty ones
   and those of one shingle, which would meet by chance. Of s + 1 equal parts the greatest has s lesser ones on both
   sides, so neither set leaves it out and no link is lost. Only tiles with two classes or more go on.
3. A tile's leader is its class that shares most tiles with others. Tiles of one leader become one group where that
   means fewer pairs (a family of near copies shares hundreds of tiles). Each class meets its leaders first; components
   of the verified links are its label.
4. In groups that still have several labels, each class proposes its nearest few of another label; the links found are
   contracted into the labels, and classes that had more to propose than they were allowed do so again, sixteen times
   as many. When none had more, every pair has been ruled out, verified or joined by other links. So what is listed
   grows with a group's size, not with its square, and no link is lost.
5. A pair is bounded by bitmaps before it is listed. A bit is the parity of the shingles that hash to it, so each bit in
   which two signatures differ shows a shingle that one set lacks: the count bounds the overlap from above. A signature
   has two bits or more for each shingle; a wider one is folded to meet a narrower one. Large groups are dealt into
   blocks, and pairs of blocks.
6. Listed pairs are intersected exactly, as sorted arrays.
7. Components by propagating the least label along links with pointer jumping, as joins; no links reach the driver.

Defined cases: a null or empty text, or one of white space only, has no shingles, links with nothing and is its own
component; a text with fewer words than a shingle has one, its whole sequence; repeated doc_ids keep their rows; a null
doc_id takes part in links, but doesn't name a component unless all its documents lack an id; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import Tables, batches_of, own_cache, texts_for_python, unused

#: Bits of the narrowest signature.
LEAST_BITS = 512
#: Rows, and bytes of signatures, of a group that are compared in one task; larger groups are dealt into pairs of blocks.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
#: Members of a group of pairs that are intersected in one task.
PART = 512
#: Rows of small tables that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Partners of another label that a class proposes in the first round, and how many times more in the next one.
PROPOSED, MORE = 4, 16
#: Bytes of arrays that a task holds before it sends them.
SENT_BYTES = 1 << 24
_WORDS_KEPT = 400_000
GROUP_WORDS = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing function."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Words(dict):
    """64-bit hashes of words (as signed numbers), each computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


_words = _Words()


def _rolled(hashes: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all runs of ``span`` words."""
    rolled = np.full(len(hashes) - span + 1, span, np.uint64)
    for k in range(span):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - span + 1 + k])
    return rolled


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``n`` words (A-Z lower-cased, cut at ASCII white
    space). Texts are taken in groups of about ``GROUP_WORDS`` words."""
    own_cache("shingles", _words.clear)
    at = 0
    while at < len(texts):
        group, held = [], 0
        while at < len(texts) and held < GROUP_WORDS:
            text = texts[at]
            group.append(text.encode("utf-8", "surrogatepass").lower().split() if text else [])
            held += len(group[-1])
            at += 1
        hashes = np.array([_words[w] for words in group for w in words], np.int64).view(np.uint64)
        whole = _rolled(hashes, n) if held >= n else hashes
        start = 0
        for words in group:
            size = len(words)
            if size >= n:
                yield _distinct(whole[start : start + size - n + 1])
            elif size:
                yield _rolled(hashes[start : start + size], size)
            else:
                yield np.zeros(0, np.uint64)
            start += size


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """64-bit names of sets that aren't empty."""
    if not sets:
        return []
    lengths = np.array([len(s) for s in sets])
    hashed = mixed(np.concatenate(sets) ^ np.uint64(0xD6E8FEB86659FD93))
    totals = np.add.reduceat(hashed, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mixed(totals ^ lengths.astype(np.uint64)).view(np.int64).tolist()


def most_apart(sizes: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets with so many elements together, or fewer."""
    s = np.arange(max(0, sizes - 400), sizes + 1)
    return int((s - 2 * -(-percent * s // (100 + percent))).max())


@cache
def band_start(band: int) -> int:
    return -(-(3**band) // 2**band)


def band_of(size: int) -> int:
    band = max(0, int(np.log(size) / np.log(1.5)) - 1)
    while band_start(band + 1) <= size:
        band += 1
    return band


@cache
def parts_of(band: int, percent: int) -> tuple[int, int]:
    """How many parts the shingles of a band's sets are dealt into, and the spare ones of these; 0 if distinct sets
    can't link there."""
    apart = most_apart(2 * (band_start(band + 1) - 1), percent)
    spare = 1 + apart // 3
    return (apart + 1 + spare, spare) if apart > 0 else (0, 0)


def tile_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set."""
    found = []
    size = len(shingles)
    for band in range(band_of(size), band_of(max(size, size * 100 // percent)) + 1):
        parts, spare = parts_of(band, percent)
        if parts:
            dealt = mixed(shingles + np.uint64((band + 1) * 0xA0761D6478BD642F % (1 << 64)))
            sums = np.zeros(parts, np.uint64)
            part = ((dealt >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
            np.add.at(sums, part, mixed(dealt))
            keys = mixed(sums ^ mixed(np.arange(parts, dtype=np.uint64) * np.uint64(4096) + np.uint64(band)))
            found.append(keys[np.lexsort((keys, np.bincount(part, minlength=parts)))[spare:]])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of hash buckets, a power of two of them, as 64-bit words."""
    width = max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    bucket = (mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A signature as it would be with so many words."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def stacked(signatures: list[bytes], words: int | None = None) -> np.ndarray:
    """Signatures one below the other, folded to the narrowest."""
    lengths = set(map(len, signatures))
    words = words or min(lengths) // 8
    if lengths == {8 * words}:
        return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, words)
    return np.stack([folded(np.frombuffer(x, np.uint64), words) for x in signatures])


def within_bound(differing: np.ndarray, sizes_a, sizes_b, percent: int) -> np.ndarray:
    """Whether so many differing bits leave an overlap that may suffice."""
    most = np.minimum((sizes_a + sizes_b - differing) // 2, np.minimum(sizes_a, sizes_b))
    return 100 * most >= percent * (sizes_a + sizes_b - most)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on sorted arrays."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def described(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, row, n_shingles, set, bits, tiles`` (the last three null without shingles) of rows ``doc_id, row, text``.
    A task gives the tiles of a set once."""

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            sets = list(shingle_sets(frame["text"].tolist(), n))
            keys = iter(set_keys([s for s in sets if len(s)]))
            names = [next(keys) if len(s) else None for s in sets]
            tiles = []
            for name, shingles in zip(names, sets):
                tiles.append(None if name is None or name in seen else tile_keys(shingles, percent).view(np.int64))
                seen.add(name)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "row": frame["row"], "n_shingles": [len(s) for s in sets], "set": pd.array(names, "Int64"), "bits": [signature(s).tobytes() if len(s) else None for s in sets], "tiles": tiles})

    return texts.mapInPandas(describe, "doc_id long, row long, n_shingles long, set long, bits binary, tiles array<long>")


def shared_tiles(tiles: DataFrame, partitions: int) -> DataFrame:
    """The distinct rows of tiles that have two sets or more. A task passes over its sorted rows and holds one row."""

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_tile, last_set, told = None, None, False
        for frame in frames:
            tile, name = frame["tile"].to_numpy(), frame["set"].to_numpy()
            if last_tile is not None:
                tile, name = np.append(last_tile, tile), np.append(last_set, name)
            fresh = np.ones(len(tile), bool)
            fresh[1:] = (tile[1:] != tile[:-1]) | (name[1:] != name[:-1])
            tile, name = tile[fresh], name[fresh]
            same = tile[1:] == tile[:-1]
            keep = np.zeros(len(tile), bool)
            keep[1:] |= same
            keep[:-1] |= same
            last = keep[-1]
            if last_tile is not None and told:
                keep[0] = False
                last = last or (len(tile) == 1)
            last_tile, last_set, told = tile[-1], name[-1], bool(last)
            if keep.any():
                yield pd.DataFrame({"tile": tile[keep], "set": name[keep]})

    return tiles.repartition(partitions, "tile").sortWithinPartitions("tile", "set").mapInPandas(shared, "tile long, set long")


def bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of the ``a, b`` pairs that their signatures don't rule out."""

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                words = np.minimum(frame["bits_a"].str.len(), frame["bits_b"].str.len()).to_numpy() // 8
                differing = np.zeros(len(frame), np.int64)
                for own in np.unique(words):
                    at = np.flatnonzero(words == own)
                    sides = [stacked(frame[side].iloc[at].tolist(), int(own)) for side in ("bits_a", "bits_b")]
                    differing[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(1)
                sizes = [frame[side].to_numpy(np.int64) for side in ("size_a", "size_b")]
                yield frame.loc[within_bound(differing, *sizes, percent), ["a", "b"]]

    of = lambda side: known.select(F.col("set").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").mapInPandas(test, "a long, b long")


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def verified(pairs: DataFrame, texts: DataFrame, known: DataFrame, n: int, percent: int, tables: Tables) -> DataFrame:
    """Those of the written, distinct ``a, b`` pairs that link, by exact intersection of sorted arrays; written.

    Pairs are grouped by a, large groups in salted parts. Where a text stands it is turned into its array and sent to
    the groups that need it: each pair moves b's array, and each part of a group a's. A task holds one array while those
    of a part pass by.
    """
    partitions = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts")).where("parts > 1")
    large = tables.write(large, "large")
    dealt = pairs.join(small(large), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    followers = dealt.select(F.col("b").alias("set"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).cast("long").alias("parts"))
    leaders = dealt.select(F.col("a").alias("set"), "a", F.lit(0).cast("long").alias("part"), "parts").distinct()
    wanted = tables.write(followers.union(leaders).join(known.select("set", "row"), "set"), "wanted")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, held = [], 0
            places = frame.groupby("set", sort=False).indices
            groups, part, parts = frame["a"].tolist(), frame["part"].tolist(), frame["parts"].tolist()
            first = frame["text"].to_numpy()
            for (name, rows), shingles in zip(places.items(), shingle_sets([first[r[0]] for r in places.values()], n)):
                if not len(shingles) or set_keys([shingles]) != [name]:
                    continue  # another text with the same row number
                data = shingles.tobytes()
                for k in rows:
                    for own in range(parts[k]) if groups[k] == name else (part[k],):
                        out.append((groups[k], own, int(groups[k] != name), name, data))
                        held += len(data)
                        if held >= SENT_BYTES:
                            yield pd.DataFrame(out, columns=["a", "part", "follows", "b", "shingles"])
                            out, held = [], 0
            yield pd.DataFrame(out, columns=["a", "part", "follows", "b", "shingles"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, first = None, None
        for frame in frames:
            found = []
            for a, part, follows, b, data in frame.itertuples(index=False):
                array = np.frombuffer(data, np.uint64)
                if not follows:
                    group, first = (a, part), array
                elif (a, part) == group and linked(first, array, percent):
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"])

    sent = texts.select("row", "text").join(small(wanted), "row").select("text", "set", "a", "part", "parts").mapInPandas(send, "a long, part long, follows int, b long, shingles binary")
    links = sent.repartition(partitions, "a", "part").sortWithinPartitions("a", "part", "follows").mapInPandas(compare, "a long, b long").distinct()
    links = tables.write(links, "links")
    tables.delete("wanted", "large")
    return links


def nearest(i: np.ndarray, j: np.ndarray, differing: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places (i, j): the pairs (nearer, own) in which one of the ``most`` nearest of ``own`` stands, each
    pair once; and the places that have more."""
    own, other, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([differing, differing])
    order = np.lexsort((other, apart, own))
    own, other = own[order], other[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    sizes = np.diff(np.append(start, len(own)))
    rank = np.arange(len(own)) - np.repeat(start, sizes)
    near, by = other[rank < most], own[rank < most]
    width = max(1, int(max(i.max(initial=0), j.max(initial=0))) + 1)
    _, first = np.unique(np.minimum(near, by) * width + np.maximum(near, by), return_index=True)
    return near[first], by[first], own[start[sizes > most]]


def proposals(members: DataFrame, percent: int, most: int, partitions: int) -> DataFrame:
    """``a, b``: of each class b its ``most`` nearest classes a in a pair of blocks that have another label and that
    their signatures don't rule out; with a null a, the classes b that have more.

    ``members``: leader, grp, block_a, block_b, block, set, label, size, bits. A task holds one pair of blocks at a time.
    """

    def compare(block: np.ndarray, name: np.ndarray, label: np.ndarray, size: np.ndarray, signatures: list[bytes]) -> tuple[list, np.ndarray]:
        bits = stacked(signatures)
        across = block.min() < block.max()
        step = max(1, (1 << 20) // len(name))
        found = []
        for at in range(0, len(name), step):
            own = slice(at, at + step)
            open_ = (label[own, None] != label[None, at:]) & (percent * np.maximum(size[own, None], size[None, at:]) <= 100 * np.minimum(size[own, None], size[None, at:]))
            if across:
                open_ &= block[own, None] != block[None, at:]
            i, j = np.nonzero(open_)
            i, j = i + at, j + at
            i, j = i[i < j], j[i < j]
            differing = np.zeros(len(i), np.int64)
            few = max(1, (1 << 18) // bits.shape[1])
            for part in range(0, len(i), few):
                some = slice(part, part + few)
                differing[some] = np.bitwise_count(bits[i[some]] ^ bits[j[some]]).sum(1)
            near = within_bound(differing, size[i], size[j], percent)
            found.append(np.stack([i[near], j[near], differing[near]]))
        if not any(f.shape[1] for f in found):
            return [], name[:0]
        a, b, beyond = nearest(*np.concatenate(found, 1), most)
        return [*name[a].tolist(), *[None] * len(beyond)], np.concatenate([name[b], name[beyond]])

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = ["block", "set", "label", "size"]
        held: tuple | None = None  # the group at the end of the last frame, which may go on
        for frame in frames:
            if not len(frame):
                continue
            key = frame[list(keys)].to_numpy(np.int64)
            rest, bits = frame[values].to_numpy(np.int64), frame["bits"].to_numpy()
            if held is not None:
                key, rest, bits = (np.concatenate(x) for x in zip(held, (key, rest, bits)))
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            held = key[starts[-1] :], rest[starts[-1] :], bits[starts[-1] :]
            near, own = [], []
            for at, upto in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if upto - at > 1:
                    a, b = compare(*rest[at:upto].T, bits[at:upto].tolist())
                    near += a
                    own.append(b)
            if near:
                yield pd.DataFrame({"a": pd.array(near, "Int64"), "b": np.concatenate(own)})
        if held is not None and len(held[0]) > 1:
            a, b = compare(*held[1].T, held[2].tolist())
            yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": b})

    keys = ("leader", "grp", "block_a", "block_b")
    return members.repartition(partitions, *keys).sortWithinPartitions(*keys, "set").mapInPandas(stream, "a long, b long").distinct()


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``set, root`` for each set that has links: the least name that it reaches."""
    tables = tables or Tables(links.sparkSession, "components")
    both = tables.write(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "both")
    labels = tables.write(both.groupBy(F.col("a").alias("set")).agg(F.min("b").alias("low")).select("set", F.least("set", "low").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(F.min("root").alias("near"))
        lowered = labels.join(seen, "set").select("set", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("set").alias("root"), F.col("root").alias("further"))
        lowered = lowered.join(jump, "root", "left").select("set", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        lowered = tables.write(lowered, f"roots-{turn}")
        tables.delete(f"roots-{turn - 1}")
        if lowered.where("old <> root").isEmpty():
            tables.delete("both")
            return lowered.select("set", "root")
        labels = lowered.select("set", "root")


def grouped(tiles: DataFrame, tables: Tables) -> DataFrame:
    """``leader, grp, set``: the distinct classes of each group, the leader's own row included; written."""
    degrees = tiles.groupBy("set").agg(F.count(F.lit(1)).alias("degree"))
    order = F.shiftleft("degree", 32) + F.xxhash64("set").bitwiseAND(F.lit((1 << 32) - 1))
    led = tiles.join(degrees, "set").groupBy("tile").agg(F.max_by("set", order).alias("leader"), F.count(F.lit(1)).alias("n"))
    led = tables.write(led, "leaders")
    whole = tables.write(tiles.join(led, "tile").select("leader", "set").distinct(), "whole")
    alone = led.groupBy("leader").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    pairs = whole.groupBy("leader").agg(F.count(F.lit(1)).cast("double").alias("classes")).join(alone, "leader")
    apart = tables.write(pairs.where("classes * classes > pairs").select("leader"), "apart")  # their tiles stay groups of their own
    one = whole.join(small(apart), "leader", "left_anti").select("leader", F.col("leader").alias("grp"), "set")
    several = tiles.join(led.join(small(apart), "leader", "left_semi"), "tile").select("leader", F.col("tile").alias("grp"), "set")
    found = tables.write(one.union(several), "groups")
    tables.delete("leaders", "whole", "apart")
    return found


def classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_shingles, set`` of each row, and ``set, root`` of each class that has links. ``row`` names the id
    and the text."""
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("percent must be from 1 to 100, words at least 1")
    spark = df.sparkSession
    tables = Tables(spark, "ngrams")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc_id = F.col(id_col).cast("long")
    texts = texts_for_python(df).select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    found = tables.write(described(texts, words, percent), "described")
    one = found.where("set is not null").groupBy("set").agg(F.min(F.struct("row", "n_shingles", "bits")).alias("k"))
    known = tables.write(one.select("set", "k.row", F.col("k.n_shingles").alias("size"), "k.bits"), "known")
    sets = tables.write(found.select("doc_id", "row", "n_shingles", "set"), "sets")
    with batches_of(spark, 20_000):
        tiles = tables.write(shared_tiles(found.where("tiles is not null").select(F.explode("tiles").alias("tile"), "set"), partitions), "tiles")
    tables.delete("described")
    texts = texts.where("text is not null")
    members = grouped(tiles, tables)
    tables.delete("tiles")

    met = members.where("set <> leader").select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct()
    with batches_of(spark, 2000):
        tested = tables.write(bounded(met, known, percent), "met")
    links = verified(tested, texts, known, words, percent, tables)
    labels = components(links, tables)
    most, again = PROPOSED, None
    others = members.where("set <> leader")  # leaders have met all of their groups
    while True:
        own = others if again is None else others.join(small(again), "set", "left_semi")
        own = own.join(known.select("set", "size"), "set").join(labels, "set", "left").select("leader", "grp", "set", "size", F.coalesce("root", "set").alias("label"))
        several = own.groupBy("leader", "grp").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.lit(LEAST_BITS // 8), F.col("size") / 2)).alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high"))
        several = several.where("low < high").select("leader", "grp", F.ceil(F.greatest(F.col("rows") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
        open_ = own.join(several, ["leader", "grp"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
        with batches_of(spark, 4000):
            found = tables.write(proposals(open_.join(known.select("set", "bits"), "set"), percent, most, partitions), f"proposed-{most}")
        new = found.where("a is not null")
        if again is not None:
            new = new.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        new = tables.write(new, f"new-{most}")
        if new.isEmpty():
            return sets, labels
        fresh = verified(new, texts, known, words, percent, tables)
        labels = contracted(labels, fresh, tables)
        again = tables.write(found.where("a is null").select(F.col("b").alias("set")).distinct(), f"again-{most}")
        if again.isEmpty():
            return sets, labels
        tested, most = tested.union(new), most * MORE


def contracted(labels: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """``labels`` after further links: components of the labels that they connect."""
    root_of = lambda end: labels.select(F.col("set").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    roots = components(ends.where("a <> b").distinct(), tables).select(F.col("set").alias("old"), F.col("root").alias("new"))
    moved = labels.join(roots, F.col("root") == F.col("old"), "left").select("set", F.coalesce("new", "root").alias("root"))
    alone = roots.join(labels.select(F.col("set").alias("old")), "old", "left_anti").select(F.col("old").alias("set"), F.col("new").alias("root"))
    return tables.write(moved.union(alone), "labels")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the least doc_id that links reach, its own included.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``words``-word shingles.
    """
    sets, roots = classes(df, id_col, text_col, words, percent)
    named = sets.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("own"))
    least = named.join(roots, "set").groupBy("root").agg(F.min("own").alias("least"))
    of_set = named.join(roots, "set", "left").join(least, "root", "left").select("set", F.coalesce("least", "own").alias("component_id"))
    return sets.join(of_set, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the one with the least id (rows without an id come after all others), of several texts
    under it the one with the lowest hash. Of rows that repeat that id and that text one stays. Rows without words stay,
    all of them. All columns are kept."""
    sets, roots = classes(df, id_col, text_col, words, percent)
    rooted = sets.where("set is not null").join(roots, "set", "left").select("row", "doc_id", F.coalesce("root", "set").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    stay = best.select("best.row")
    tables = Tables(df.sparkSession, "copies")
    gone = tables.write(rooted.select("row").distinct().join(stay, "row", "left_anti"), "gone")
    repeated = tables.write(rooted.groupBy("row").count().where("count > 1").join(stay, "row", "left_semi").select("row"), "repeated")
    row = unused(df, "_row")
    kept = df.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))).join(small(gone.withColumnRenamed("row", row)), row, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated.withColumnRenamed("row", row))
        kept = kept.join(again, row, "left_anti").unionByName(kept.join(again, row, "left_semi").dropDuplicates([row]))
    return kept.select(df.columns)


def oracle(words: int = 4, percent: int = 85) -> str:
    """SQL for DuckDB: all pairs that share a shingle, and what they reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
