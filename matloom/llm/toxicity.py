"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Inputs of a word: a hashed word embedding and the mean of its hashed character n-gram embeddings (with marks for its
beginning and end); all are learned with the network, nothing else is. A text is read in windows of 24 words that
overlap by half; all windows are scored and the highest one, calibrated, is the text's score.

Training takes at most ``sample`` labelled rows (2400 by default, half of them of each label if there are so many),
those with the lowest hashes of their ids, and of each at most ``spread`` windows (96 by default), evenly spread over the
whole text: documented bounds. Labels are given by text and not by window: a first pass takes all windows under their
text's label, which clean words survive because they stand under both; then, turn by turn, the windows that the model
finds most toxic stand for a text, of clean ones also some at random.

Defined cases: a null text or one without words is one window without words and gets the network's score of it;
without labelled rows of both labels every score is 0; rows with null or repeated ids are scored like others (of
labelled ones with equal ids and labels the least windows are learned); an empty table gives an empty result; labels,
language, source and id are never inputs; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import bounded_sample, fold, own_cache, texts_for_python, unused

WINDOW, STEP = 24, 12
HIDDEN = 8
BUCKETS, WIDTH = 1 << 16, 8
GRAMS = (3, 4, 5, 6)
#: Words that are held at a time when texts are scored.
GROUP_WORDS = 100_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Vocabulary:
    """Numbers of distinct words, from 1 (0: no word), and their hashed features."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def number(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int32)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words: bucket of the word; buckets of its n-grams, one word after the other; where each begins."""
        coded = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in self.ids]
        lengths = np.array([len(c) for c in coded], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64) + np.uint64(1)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # bytes to the word's end
        rolled, hashes, owners = np.zeros(len(data), np.uint64), [], []
        owner = np.repeat(np.arange(len(coded)), lengths)
        for n in range(1, max(GRAMS) + 1):
            size = len(data) - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint64(0x100000001B3) + data[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            if n in GRAMS:
                inside = left[:size] >= n
                hashes.append(_bucket(rolled[inside] + np.uint64(n)))
                owners.append(owner[:size][inside].astype(np.int32))
        whole = np.add.reduceat(data * _powers(lengths), starts) if len(data) else np.zeros(0, np.uint64)
        grams = np.concatenate(hashes) if hashes else np.zeros(0, np.int32)
        of = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(coded))
        return _bucket(whole), grams[order], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _powers(lengths: np.ndarray) -> np.ndarray:
    place = np.arange(lengths.sum()) - np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64), lengths)
    table = np.cumprod(np.concatenate([[1], np.full(int(lengths.max(initial=1)), 0x5851F42D4C957F2D, np.uint64)]).astype(np.uint64))
    return table[place]


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def segment_mean(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of consecutive rows; zero where there are none."""
    if not len(values):
        return np.zeros((len(starts) - 1, *values.shape[1:]), np.float32)
    counts = np.diff(starts)
    sums = np.add.reduceat(np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)]), starts[:-1])
    sums[counts == 0] = 0
    return sums / np.maximum(counts, 1).reshape(-1, *[1] * (values.ndim - 1))


def spread_windows(words: list[str], most: int) -> list[list[str]]:
    """All overlapping windows of a text, or ``most`` of them from end to end."""
    last = max(0, len(words) - WINDOW)
    starts = [*range(0, last, STEP), last]
    if len(starts) > most:
        starts = [starts[k] for k in np.linspace(0, len(starts) - 1, most).astype(int)]
    return [words[at : at + WINDOW] for at in starts]


def windows_of(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows (0: no word) and the document of each; a document has at least one."""
    padded, starts, owner, at = [], [], [], 0
    pad = np.zeros(WINDOW, np.int32)
    for k, ids in enumerate(documents):
        last = max(0, len(ids) - WINDOW)
        own = list(range(0, last, STEP)) + [last]
        starts += [at + s for s in own]
        owner += [k] * len(own)
        padded += [ids, pad]
        at += len(ids) + WINDOW
    return np.concatenate(padded)[np.array(starts)[:, None] + np.arange(WINDOW)], np.array(owner)


INPUTS = 2 * WIDTH


@dataclass
class Network:
    word: np.ndarray
    gram: np.ndarray
    #: by direction: input and state weights of the gates z, r, n, and biases
    wx: list[np.ndarray] = field(default_factory=list)
    wh: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    attend: np.ndarray | None = None
    out: np.ndarray | None = None
    base: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        net = cls(normal(BUCKETS, WIDTH, s=0.05), normal(BUCKETS, WIDTH, s=0.05))
        for _ in range(2):
            net.wx.append(normal(INPUTS, 3 * HIDDEN, s=0.3))
            net.wh.append(normal(HIDDEN, 3 * HIDDEN, s=0.3))
            net.bias.append(np.zeros(3 * HIDDEN, np.float32))
        net.attend, net.out, net.base = normal(2 * HIDDEN, s=0.3), normal(2 * HIDDEN, s=0.3), np.zeros(1, np.float32)
        return net

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """One row for each word; row 0, of no word, is zero."""
        bucket, grams, starts = features
        table = np.zeros((len(bucket) + 1, INPUTS), np.float32)
        table[1:, :WIDTH] = self.word[bucket]
        for at in range(0, len(bucket), 20_000):  # bounds what is gathered of the n-grams at a time
            own = starts[at : at + 20_001]
            part = grams[own[0] : own[-1]]
            rows = slice(at + 1, at + len(own))
            table[rows, WIDTH:] = segment_mean(self.gram[part], own - own[0])
        return table

    def logits(self, table: np.ndarray, windows: np.ndarray, block: int = 4096) -> np.ndarray:
        """Of each window, by ``table`` of its words' inputs."""
        scale = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)
        gates = [(table @ w + b) * scale for w, b in zip(self.wx, self.bias)]
        states = [w * scale for w in self.wh]
        heads = [np.stack([v[k * HIDDEN : (k + 1) * HIDDEN] for v in (self.attend, self.out)], 1) for k in range(2)]
        found = np.empty(len(windows), np.float32)
        for at in range(0, len(windows), block):
            part = np.ascontiguousarray(windows[at : at + block].T)
            size = part.shape[1]
            told = np.zeros((WINDOW, size, 2), np.float32)
            for k, order in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
                h = np.zeros((size, HIDDEN), np.float32)
                for t in order:
                    given = gates[k][part[t]]
                    kept = h @ states[k]
                    zr = given[:, : 2 * HIDDEN]
                    zr += kept[:, : 2 * HIDDEN]
                    np.tanh(zr, out=zr)
                    zr *= 0.5
                    zr += 0.5
                    new = kept[:, 2 * HIDDEN :]
                    new *= zr[:, HIDDEN:]
                    new += given[:, 2 * HIDDEN :]
                    np.tanh(new, out=new)
                    h -= new
                    h *= zr[:, :HIDDEN]
                    h += new
                    told[t] += h @ heads[k]
            found[at : at + size] = _pooled(told, part)[0] + self.base[0]
        return found


def _pooled(told: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention over the words of each window (over all places if it has none); also the weights."""
    score = np.where((part > 0) | (part == 0).all(0), told[..., 0], np.float32(-1e9))
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    return (weight * told[..., 1]).sum(0), weight


def _step(net: Network, vocabulary_features, windows: np.ndarray, labels: np.ndarray, memory: dict, rate: float) -> float:
    """One gradient step (Adagrad) on a batch of windows; returns the loss."""
    bucket, grams, starts = vocabulary_features
    used, local = np.unique(windows, return_inverse=True)
    local = local.reshape(windows.shape)
    words = used[used > 0] - 1
    counts = (starts[words + 1] - starts[words]).astype(np.int64)
    own_starts = np.concatenate([[0], np.cumsum(counts)])
    own_grams = grams[np.repeat(starts[words] - own_starts[:-1], counts) + np.arange(own_starts[-1])]
    table = net.inputs((bucket[words], own_grams, own_starts))
    if used[0] != 0:
        local = local + 1
    part, size = local.T, len(windows)
    runs, told = [], np.zeros((WINDOW, size, 2), np.float32)
    heads = [np.stack([v[k * HIDDEN : (k + 1) * HIDDEN] for v in (net.attend, net.out)], 1) for k in range(2)]
    for k, order in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
        h, kept = np.zeros((size, HIDDEN), np.float32), []
        gates = table @ net.wx[k] + net.bias[k]
        for t in order:
            given, carried = gates[part[t]], h @ net.wh[k]
            zr = 0.5 * np.tanh(0.5 * (given[:, : 2 * HIDDEN] + carried[:, : 2 * HIDDEN])) + 0.5
            z, r, u = zr[:, :HIDDEN], zr[:, HIDDEN:], carried[:, 2 * HIDDEN :]
            new = np.tanh(given[:, 2 * HIDDEN :] + r * u)
            kept.append((t, h, z, r, u, new))
            h = (1 - z) * new + z * h
            told[t] += h @ heads[k]
            kept[-1] += (h,)
        runs.append(kept)
    pooled, weight = _pooled(told, part)
    chance = 1 / (1 + np.exp(-(pooled + net.base[0])))
    loss = float(-np.mean(np.log(np.where(labels > 0, chance, 1 - chance) + 1e-7)))
    slope = ((chance - labels) / size).astype(np.float32)
    d_told = np.stack([weight * (told[..., 1] - pooled) * slope, weight * slope], 2)
    d_attend, d_out, d_table = np.zeros_like(net.attend), np.zeros_like(net.out), np.zeros_like(table)
    changes = [(net.base, np.array([slope.sum()], np.float32), "base")]
    for k, kept in enumerate(runs):
        d_wx, d_wh, d_gates = np.zeros_like(net.wx[k]), np.zeros_like(net.wh[k]), np.zeros((len(table), 3 * HIDDEN), np.float32)
        d_h = np.zeros((size, HIDDEN), np.float32)
        for t, h, z, r, u, new, after in reversed(kept):
            d_h = d_h + d_told[t] @ heads[k].T
            both = after.T @ d_told[t]
            d_attend[k * HIDDEN : (k + 1) * HIDDEN] += both[:, 0]
            d_out[k * HIDDEN : (k + 1) * HIDDEN] += both[:, 1]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_carried = np.concatenate([d_z, d_r, d_new * r], 1)
            np.add.at(d_gates, part[t], np.concatenate([d_z, d_r, d_new], 1))
            d_wh += h.T @ d_carried
            d_h = d_h * z + d_carried @ net.wh[k].T
        d_wx += table.T @ d_gates
        d_table += d_gates @ net.wx[k].T
        changes += [(net.wx[k], d_wx, f"wx{k}"), (net.wh[k], d_wh, f"wh{k}"), (net.bias[k], d_gates.sum(0), f"b{k}")]
    changes += [(net.attend, d_attend, "attend"), (net.out, d_out, "out")]
    for value, gradient, name in changes:
        past = memory.setdefault(name, np.full_like(value, 1e-4))
        past += gradient * gradient
        value -= rate * gradient / np.sqrt(past)
    d_word, d_gram = np.zeros_like(net.word), np.zeros_like(net.gram)
    np.add.at(d_word, bucket[words], d_table[1:, :WIDTH])
    np.add.at(d_gram, own_grams, np.repeat(d_table[1:, WIDTH:] / np.maximum(counts, 1)[:, None], counts, 0))
    for value, gradient, rows, name in ((net.word, d_word, np.unique(bucket[words]), "word"), (net.gram, d_gram, np.unique(own_grams), "gram")):
        past = memory.setdefault(name, np.full_like(value, 1e-4))
        past[rows] += gradient[rows] ** 2
        value[rows] -= rate * gradient[rows] / np.sqrt(past[rows])
    return loss


def train(documents: list[list[list[str]]], labels: np.ndarray, *, turns: int = 4, first: int = 60_000, seed: int = 7) -> Network | None:
    """A network from labelled documents, each a list of windows; None without both labels. ``first`` bounds the windows
    of the first pass; with more, a random choice of them."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    windows = np.zeros((sum(map(len, documents)), WINDOW), np.int32)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    for k, words in enumerate(w for d in documents for w in d):
        windows[k, : len(words)] = vocabulary.number(words)
    features = vocabulary.features()
    net, memory = Network.fresh(seed), {}

    def learn(chosen: np.ndarray, target: np.ndarray, rate: float) -> None:
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            _step(net, features, windows[chosen[part]], target[part], memory, rate)

    every = rng.permutation(len(windows))[:first]
    for _ in range(max(1, min(6, first // len(every)))):
        learn(every, labels[owner[every]], 0.05)
    start = np.searchsorted(owner, np.arange(len(documents)))
    upto = np.append(start[1:], len(owner))
    for turn in range(turns):
        score = net.logits(net.inputs(features), windows)
        chosen, target = [], []
        for k, label in enumerate(labels):
            own = np.arange(start[k], upto[k])
            picks = own[np.argsort(-score[own], kind="stable")[: 1 if label else 2]]
            if not label:
                picks = np.union1d(picks, rng.choice(own, min(2, len(own)), replace=False))
            chosen += picks.tolist()
            target += [label] * len(picks)
        chosen, target = np.array(chosen), np.array(target, np.float32)
        weight = max(1, round((target == 0).sum() / max(1, (target == 1).sum()) / 2))
        chosen = np.concatenate([chosen, np.repeat(chosen[target == 1], weight - 1)])
        target = np.concatenate([target, np.ones(len(chosen) - len(target), np.float32)])
        for _ in range(max(2, min(12, 24000 // max(1, len(chosen))))):
            learn(chosen, target, 0.06 if turn < 2 else 0.03)
    best = np.maximum.reduceat(net.logits(net.inputs(features), windows), start)
    a, b = 1.0, 0.0
    for _ in range(400):  # calibrates the highest window's logit
        chance = 1 / (1 + np.exp(-np.clip(a * best + b, -30, 30)))
        error = (chance - labels) / len(labels)
        a, b = a - 0.5 * float((error * best).sum() + 1e-4 * a), b - 0.5 * float(error.sum())
    net.scale = (max(a, 0.05), b)
    return net


def score_texts(net: Network, texts: list[str]) -> np.ndarray:
    """The score of each text, from all of its windows, to five places (sums of single precision vary beyond)."""
    own_cache("windows", lambda: None)
    scores, group, held = [], [], 0

    def close() -> None:
        vocabulary = Vocabulary()
        documents = [vocabulary.number(words) for words in group]
        windows, owner = windows_of(documents)
        found = net.logits(net.inputs(vocabulary.features()), windows)
        best = np.maximum.reduceat(found, np.searchsorted(owner, np.arange(len(documents))))
        a, b = net.scale
        scores.append(np.round(1 / (1 + np.exp(-np.clip(a * best.astype(float) + b, -40, 40))), 5))

    for text in texts:
        group.append(words_of(text))
        held += len(group[-1])
        if held >= GROUP_WORDS:
            close()
            group, held = [], 0
    if group:
        close()
    return np.concatenate(scores) if scores else np.zeros(0)


def labelled_sample(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int, spread: int) -> tuple[list[list[list[str]]], np.ndarray]:
    """Windows and labels of at most ``sample`` labelled rows whose fold isn't held out, half of them of each label at
    most. Texts are cut where they stand: at most ``spread`` windows of each reach the driver."""
    usable = labels.where((fold("doc_id", folds) != held) & F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null").distinct()
    picked = bounded_sample(usable.where("label = 1"), sample // 2, "id").union(bounded_sample(usable.where("label = 0"), sample - sample // 2, "id"))
    texts = texts_for_python(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "windows": [[" ".join(w) for w in spread_windows(words_of(t), spread)] for t in frame["text"]]})

    found = texts.select("id", "label", "text").mapInPandas(cut, "id long, label int, windows array<string>").groupBy("id", "label").agg(F.min("windows").alias("windows"))
    rows = sorted(found.collect(), key=lambda r: (r["id"], r["label"]))
    return [[w.split() for w in r["windows"]] for r in rows], np.array([r["label"] for r in rows], np.float32)


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, sample: int = 2400, spread: int = 96) -> Network | None:
    """Train on labelled rows outside the held-out fold."""
    return train(*labelled_sample(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held=held, sample=sample, spread=spread))


def with_toxicity(df: DataFrame, net: Network | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score of each row's text in ``score_col`` (which replaces a column of that name)."""
    df = texts_for_python(df).drop(score_col)
    if net is None:
        return df.withColumn(score_col, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input
    scored = unused(df, "_scored")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{score_col: score_texts(shared.value, frame[scored].tolist())}).drop(columns=scored)

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*df.schema.fields]).add(score_col, DoubleType())
    return df.withColumn(scored, F.coalesce(F.col(text_col), F.lit(""))).mapInPandas(score, schema)
