"""Toxicity and quality: gradients, held-out accuracy, odd rows."""

import duckdb
import numpy as np
import pytest

from matloom.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"


def area(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    words = [f"word{k}" for k in range(30)]
    vocabulary = toxicity.Vocabulary()
    vocabulary.number(words)
    features = vocabulary.features()
    net = toxicity.Network.fresh()
    for name in ("word", "gram", "attend", "out", "base"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.wx, net.wh, net.bias = ([w.astype(np.float64) for w in side] for side in (net.wx, net.wh, net.bias))
    windows = rng.integers(0, 31, (7, toxicity.WINDOW)).astype(np.int32)
    windows[2, 5:] = 0
    labels = (np.arange(7) % 2).astype(np.float32)

    def loss():
        return toxicity._step(net, features, windows, labels, {}, 0.0)

    for value in (net.wx[0], net.wh[1], net.attend, net.out, net.base):
        at = tuple(rng.integers(0, s) for s in value.shape)
        before, memory = value[at], {}
        value[at] = before + 1e-3
        above = loss()
        value[at] = before - 1e-3
        below = loss()
        value[at] = before
        toxicity._step(net, features, windows, labels, memory, 0.0)
        key = next(k for k, v in memory.items() if v.shape == value.shape and {id(net.wx[0]): "wx0", id(net.wh[1]): "wh1", id(net.attend): "attend", id(net.out): "out", id(net.base): "base"}[id(value)] == k)
        size = np.sqrt(max(memory[key][at] - 1e-4, 0))
        assert abs(abs(above - below) / 2e-3 - size) < 2e-3 + 0.02 * size


def plain_score(net, text):
    """A text's score, word by word and gate by gate."""
    words, sigmoid, n = toxicity.words_of(text), lambda x: 1 / (1 + np.exp(-x)), toxicity.HIDDEN
    inputs = []
    for word in words:
        alone = toxicity.Vocabulary()
        alone.number([word])
        bucket, grams, _ = alone.features()
        inputs.append(np.concatenate([net.word[bucket[0]], net.gram[grams].mean(0) if len(grams) else np.zeros(toxicity.WIDTH)]).astype(float))
    last, best = max(0, len(words) - toxicity.WINDOW), -np.inf
    for start in [*range(0, last, toxicity.STEP), last]:
        window = inputs[start : start + toxicity.WINDOW]
        window += [np.zeros(toxicity.INPUTS)] * (toxicity.WINDOW - len(window))
        states = [[None] * toxicity.WINDOW, [None] * toxicity.WINDOW]
        for side, order in enumerate((range(toxicity.WINDOW), reversed(range(toxicity.WINDOW)))):
            h = np.zeros(n)
            for t in order:
                x, carried = window[t] @ net.wx[side] + net.bias[side], h @ net.wh[side]
                z, r = sigmoid(x[:n] + carried[:n]), sigmoid(x[n : 2 * n] + carried[n : 2 * n])
                new = np.tanh(x[2 * n :] + r * carried[2 * n :])
                h = (1 - z) * new + z * h
                states[side][t] = h
        both = [np.concatenate([a, b]) for a, b in zip(*states)]
        seen = both[: len(words) - start] if words else both
        weights = np.exp([s @ net.attend for s in seen])
        best = max(best, float(weights / weights.sum() @ [s @ net.out for s in seen] + net.base[0]))
    a, b = net.scale
    return 1 / (1 + np.exp(-(a * best + b)))


def test_scores_are_those_of_a_plain_loop(spark, odd):
    net = toxicity.Network.fresh(3)
    net.base[0], net.scale = 0.3, (1.7, -0.2)
    net.bias = [np.linspace(-1, 1, 3 * toxicity.HIDDEN).astype(np.float32) * (k + 1) for k in range(2)]
    net.word *= 30
    texts = ["", "one", "You, awful CLOWN!", "é \U0001f600 " * 9, " ".join(f"word{k % 13} x{k}" for k in range(60)), " ".join(f"a{k}" for k in range(toxicity.WINDOW))]
    wanted = [plain_score(net, t) for t in texts]
    np.testing.assert_allclose(toxicity.score_texts(net, texts), wanted, atol=2e-5)
    assert max(wanted) - min(wanted) > 0.05
    got = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).orderBy("doc_id").collect()
    np.testing.assert_allclose([r["score"] for r in got], wanted, atol=2e-5)


def test_windows_cover_every_word():
    documents = [np.arange(1, n + 1, dtype=np.int32) for n in (0, 1, 23, 24, 25, 36, 37, 100)]
    windows, owner = toxicity.windows_of(documents)
    for k, d in enumerate(documents):
        assert set(windows[owner == k].ravel()) - {0} == set(d.tolist())
        assert (owner == k).sum() >= 1


def test_features_do_not_depend_on_other_words():
    one, many = toxicity.Vocabulary(), toxicity.Vocabulary()
    one.number(["clown"])
    many.number(["a", "clown", "é", "x" * 50])
    bucket, grams, starts = many.features()
    own = one.features()
    assert own[0][0] == bucket[1] and sorted(own[1]) == sorted(grams[starts[1] : starts[2]])


def labelled(column, folds, held):
    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(d.text, '') AS text, l.{column} AS y FROM '{DATA}/documents.parquet' d JOIN '{DATA}/labels.parquet' l USING (doc_id)").df()
    import zlib

    out = np.array([zlib.crc32(str(i).encode()) % folds == held for i in rows["doc_id"]])
    return rows[~out], rows[out]


def test_toxicity_on_held_out_rows():
    train, held = labelled("toxic", 3, 1)
    net = toxicity.train([toxicity.spread_windows(toxicity.words_of(t), 96) for t in train["text"]], train["y"].to_numpy())
    assert area(held["y"].to_numpy(), toxicity.score_texts(net, held["text"].tolist())) >= 0.9
    bare = toxicity.Network.fresh()  # without what the network has learned nothing is left
    assert area(held["y"].to_numpy(), toxicity.score_texts(bare, held["text"].tolist())) < 0.7


def test_spread_windows():
    words = [str(k) for k in range(1000)]
    every = toxicity.spread_windows(words, 10_000)
    assert {w for x in every for w in x} == set(words) and max(map(len, every)) == toxicity.WINDOW
    some = toxicity.spread_windows(words, 7)
    assert len(some) == 7 and some[0] == every[0] and some[-1] == every[-1] and toxicity.spread_windows([], 5) == [[]]


def test_quality_on_held_out_rows():
    train, held = labelled("quality", 5, 0)
    model = quality.train(np.stack([quality.term_counts(t) for t in train["text"]]), train["y"].to_numpy())
    assert area(held["y"].to_numpy(), quality.score_texts(model, held["text"].tolist())) > 0.95


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, (k or 0) % 2, (k or 0) % 2) for k in [*range(12), None]], "doc_id long, toxic int, quality int")


def test_odd_rows(odd, none, labels):
    for module, add in ((toxicity, toxicity.with_toxicity), (quality, quality.with_quality)):
        model = module.fit(odd, labels)
        got = add(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        same = [r["score"] for r in got if r["doc_id"] == 6]
        assert abs(same[0] - same[1]) <= 1e-5  # sums of single precision depend on the block
        assert add(none, model).count() == 0
        assert module.fit(none, labels) is None and module.fit(odd, labels.limit(0)) is None
        assert add(odd, None).select("score").distinct().count() == 1
        assert add(odd, model, score_col="mine").columns == [*odd.columns, "mine"]


def test_scores_of_a_text_do_not_depend_on_its_neighbours(odd, labels):
    net = toxicity.fit(odd, labels)
    texts = [r["text"] or "" for r in odd.collect()]
    together = toxicity.score_texts(net, texts)
    np.testing.assert_allclose(together, [toxicity.score_texts(net, [t])[0] for t in texts], atol=1e-5)
    model = quality.fit(odd, labels)
    np.testing.assert_allclose(quality.score_texts(model, texts), [quality.score_texts(model, [t])[0] for t in texts], atol=1e-4)


def test_held_out_rows_are_not_learned(spark, odd, labels):
    import zlib

    options = dict(id_col="doc_id", text_col="text", label_col="toxic", folds=3, held=1, spread=1000)
    found, _ = toxicity.labelled_sample(odd, labels, sample=100, **options)
    allowed = [toxicity.spread_windows(toxicity.words_of(r["text"] or ""), 1000) for r in odd.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    assert found and all(windows in allowed for windows in found)
    few, y = toxicity.labelled_sample(odd, labels, sample=2, **options)
    assert len(few) <= 2 and len(y) == len(few)


def test_clashing_names_and_repeated_labelled_ids(spark, labels):
    rows = [(k % 12, f"text {k % 5} of some words", "kept", "also", 1.5) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _scored string, label double")
    for module, add in ((toxicity, toxicity.with_toxicity), (quality, quality.with_quality)):
        got = add(df, module.fit(df, labels)).collect()
        assert len(got) == 30 and {(r["_text"], r["_scored"], r["label"]) for r in got} == {("kept", "also", 1.5)}
        again = add(df, module.fit(df.orderBy(df.text.desc()), labels)).collect()
        assert {(r["doc_id"], r["text"]): r["score"] for r in got} == {(r["doc_id"], r["text"]): r["score"] for r in again}


def test_quality_is_the_vote_of_all_pairs():
    train, held = labelled("quality", 5, 0)
    counts = np.stack([quality.term_counts(t) for t in train["text"]])
    model = quality.train(counts, train["y"].to_numpy())
    own, other = model.embed(counts), model.embed(np.stack([quality.term_counts(t) for t in held["text"]]))
    expected = []
    for v in other:  # one document against all labelled ones
        near = sorted(((float(v @ w), int(y)) for w, y in zip(own, train["y"])), reverse=True)[: model.count]
        weights = [max(s, 0) ** 4 for s, _ in near]
        expected.append(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights))
    got = quality.score_texts(model, held["text"].tolist())
    assert np.mean(np.abs(got - expected) < 1e-3) > 0.98  # ties at the last place


def test_votes():
    model = quality.Neighbours(np.ones(2, np.float32), np.eye(2, dtype=np.float32), np.array([[1, 0], [0, 1]], np.float32), np.array([1.0, 0.0]), 2)
    got = model.vote(np.array([[1, 0], [0.6, 0.8], [0, 0]], np.float32))
    assert got[0] == 1 and abs(got[1] - 0.6**4 / (0.6**4 + 0.8**4)) < 1e-6 and got[2] == 0.5
