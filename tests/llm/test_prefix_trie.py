"""The trie against its SQL, brute force on odd tables, and runs cut short."""

import hashlib
import zlib

import duckdb
import pytest

from matloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, len long, d long"


def brute(rows):
    """Nodes of conversations given as (conv_id, turn, role, text), by lists alone."""
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(key))
        out[(min(members), len(key))] = (
            min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), sum(not any(len(o) > len(k) and o[: len(k)] == k for o in nodes) for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def nodes(df):
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in df.collect()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = prefix_trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = nodes(got)
    assert len(found) == got.count() and found == brute(rows)


def table():
    """Shared beginnings, equal conversations, ones that end within another, and one without turns of its own left."""
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 8, 100, 101, 103, 250, 251, -7]:
        rows += [(c, t, "user" if t % 2 == 0 else None, f"turn {t} of {c // 100 if c % 3 else c} \U0001f600") for t in range(c % 9)]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(6)]
    return rows


def test_against_brute_force(spark):
    check(spark, table())


def test_odd_rows(spark):
    check(spark, [(None, 0, "user", "nobody's"), (400, None, None, None), (400, 3, "user", ""), (400, 3, "user", ""), (401, 0, "a", "b"), (499, 0, "ab", ""), (499, 1, None, "x" * 100_000), (301, 1, "a", "b")])


def test_empty(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    monkeypatch.setattr(prefix_trie, "PACKED", 60)
    rows = table() + [(c, t, "user", f"long {t if t < 30 else (t, c)}") for c in (600, 601, 602) for t in range(37)]
    check(spark, rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/sf{sf}/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    got = prefix_trie.conversation_trie(spark.read.parquet(path))
    cast = con.sql(f"SELECT {', '.join(got.columns)} FROM ({prefix_trie.oracle()})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cast, key=str)
