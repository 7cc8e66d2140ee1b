"""Components of linked documents against all pairs compared one by one."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matloom.llm import ngram_join as nj


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, n, percent):
    """(doc_id, number of shingles, component) by comparing all sets."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                group[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted(((d, len(s), least.get(root(k), d) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def ours(df, **options):
    return sorted((tuple(r) for r in nj.jaccard_components(df, **options).collect()), key=str)


def corpus(seed=0):
    """Families of texts at all distances from their first one, copies, and texts of their own."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 4000)
    rows = []
    for size in (3, 4, 5, 8, 12, 20, 45, 110, 300, 700):
        base = [word() for _ in range(size)]
        for k in range(14):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, size // 25)))):
                own[int(rng.integers(0, len(own)))] = word()
            if k % 5 == 4:
                own += [word() for _ in range(size // 12)]
            rows.append(" ".join(own))
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(90)] + passage) for _ in range(25)] + rows[:30]
    return [(int(k), t) for k, t in zip(rng.permutation(len(rows)) + 5, rows)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_all_links_are_found(spark, monkeypatch, n, percent):
    monkeypatch.setattr(nj, "BLOCK", 6)
    rows = corpus(percent)
    expected = brute(rows, n, percent)
    assert any(c != d for d, _, c in expected)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), words=n, percent=percent) == expected


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert ours(odd, words=4, percent=85) == brute(rows, 4, 85)
    assert nj.jaccard_components(none).count() == 0
    kept = nj.one_of_each(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d in [1, 3, 4, 5, 6, None, 7, 8, 9])
    assert set(kept.columns) == set(odd.columns)
    with pytest.raises(ValueError):
        nj.jaccard_components(odd, percent=0)


@given(st.integers(2, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(85,), (80,)]))
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_tile(common, a, b, percent):
    percent = percent[0]
    rng = np.random.default_rng(common * 1000 + a * 60 + b)
    every = np.unique(rng.integers(0, 1 << 63, common + a + b).astype(np.uint64))
    rng.shuffle(every)
    x, y = np.sort(every[: common + a]), np.sort(np.concatenate([every[:common], every[common + a :]]))
    near = nj.linked(x, y, percent)
    assert near == (100 * common >= percent * (common + a + b))
    if near and len(set(nj.set_keys([x, y]))) == 2:
        assert set(nj.tile_keys(x, percent).tolist()) & set(nj.tile_keys(y, percent).tolist())
    if near:
        bits = nj.stacked([nj.signature(x).tobytes(), nj.signature(y).tobytes()])
        differing = np.bitwise_count(bits[0] ^ bits[1]).sum()
        assert differing <= a + b and nj.within_bound(differing, len(x), len(y), percent)


def test_folding_is_a_narrower_signature():
    every = np.arange(1, 900, dtype=np.uint64)
    wide, few = nj.signature(every), nj.signature(every[:300])
    assert len(wide) > len(few)
    joined = nj.folded(wide, 8) ^ nj.folded(nj.signature(every[300:]), 8) ^ nj.folded(few, 8)
    assert not joined.any()


def test_largest_difference():
    for percent in (80, 85):
        for s in range(2, 300):
            best = max(x + y - 2 * i for x in range(1, s) for y in [s - x] if x <= y for i in range(x + 1) if 100 * i >= percent * (x + y - i)) if any(100 * min(x, s - x) >= percent * max(x, s - x) for x in range(1, s)) else 0
            assert best <= max(0, nj.most_apart(s, percent))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["set"]: r["root"] for r in nj.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_a_family_lists_few_pairs(spark, monkeypatch):
    """Copies that are near the threshold of each other: pairs grow with the family, not with its square."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 9000, 240)]
    rows = []
    for k in range(260):
        own = list(base)
        for at in rng.integers(0, len(base), int(rng.integers(1, 9))):
            own[int(at)] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(own)))
    listed = []
    real = nj.verified

    def counted(pairs, *rest):
        listed.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(nj, "verified", counted)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85) == brute(rows, 4, 85)
    assert 260 <= sum(listed) < 12 * 260


def test_rounds_until_nothing_is_left(spark, monkeypatch):
    monkeypatch.setattr(nj, "PROPOSED", 1)
    monkeypatch.setattr(nj, "MORE", 2)
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = corpus(11)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85) == brute(rows, 4, 85)


def test_nearest_partners():
    i, j, apart = np.array([0, 0, 0, 1, 2]), np.array([1, 2, 3, 2, 3]), np.array([5, 1, 3, 2, 9])
    near, own, beyond = nj.nearest(i, j, apart, 1)
    assert {frozenset(p) for p in zip(near.tolist(), own.tolist())} == {frozenset((0, 2)), frozenset((1, 2)), frozenset((0, 3))}
    assert beyond.tolist() == [0, 1, 2, 3]
    near, own, beyond = nj.nearest(i, j, apart, 3)
    assert len(near) == 5 and not len(beyond)


def test_one_id_on_many_texts_and_one_text_on_many_rows(spark):
    rows = [(7, f"these are {k % 3} words of a text that is number {k}") for k in range(60)] + [(None, "the same text without an id, again and again")] * 60 + [(k, "x y z w v u t s r q") for k in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, words=4, percent=85) == brute(rows, 4, 85)
    kept = nj.one_of_each(df, words=4, percent=85).collect()
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] != 7), key=str) == [100, None]
