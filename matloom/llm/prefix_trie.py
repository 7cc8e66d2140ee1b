"""Prefix trie of conversations: how many turns would be shared if every common beginning were kept once.

Patricia construction. Conversations are first rebuilt (a beginning of another one, then their own turns). Every prefix
gets two 64-bit hashes, running exclusive-ors of hashes of (place, role, text), and texts go no further. Equal
conversations become one class, the least id its representative. Then

1. *sort*: rows (depth, prefix, next turn) of representatives lie in sorted ranges; where neighbours agree in the prefix but
   not in the next turn there is a branch. Points are branches, ends of conversations (leaves are among them) and the root;
2. *aggregate on points alone*: members, smallest member and depth by prefix; an edge is the compressed run of turns from a
   point up to the point above, owned by its smallest member. Along a representative's points, suffix sums of its own
   edges' savings give each point's share of what lies below; leaves and children are counted alike;
3. *expand*: an edge's unary nodes are depths between its ends, their savings the point's plus a suffix sum of the
   edge's code points.

No step waits for another depth: rounds don't grow with the tree. Conversations of any length are cut into runs of
``RUN`` turns whose sums are carried over; one that is a third of the table shares no task's window. Members of an end are
packed into strings by sorted ranges before a task streams them into SHA-256, so a large group is never held.

Defined cases: rows without a conv_id belong to no conversation; turns of equal number follow by a hash of role and text, repeated
rows stay repeated; null or empty roles and texts are empty; an empty table has no nodes, not even a root; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.llm.common import Tables
from matloom.plans.index import with_position

RUN = 1 << 16
#: Bytes of joined ids in one row of members.
PACKED = 1 << 16
#: Rebuilding: conversations share the beginning of the first one of their hundred, at most five turns of it.
HUNDRED, MOST = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred: crc32 of its decimal id, modulo 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST).cast("int")


def hashed_turns(df: DataFrame, tables: Tables, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c, pos, t1, t2, chars``: the turns of each conversation in order, texts as two hashes and a length."""
    said = [F.coalesce(F.col(k), F.lit("")) for k in (role, text)]
    rows = df.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), F.xxhash64(*said).alias("t1"), F.xxhash64(F.lit(1), *reversed(said)).alias("t2"), F.length(said[1]).cast("long").alias("chars"))
    rows = rows.where("c is not null").withColumn("row", F.monotonically_increasing_id())  # so that equal rows may lie in several ranges
    placed = tables.write(with_position(rows, ["c", "turn", "t1", "t2", "row"], "at").drop("turn", "row"), "placed")
    firsts = placed.groupBy("c").agg(F.min("at").alias("first"))
    return placed.join(firsts, "c").select("c", (F.col("at") - F.col("first")).alias("pos"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns ``c, len, pos, t1, t2, chars``, and ``c, len`` of all of them."""
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": shared_turns(F.col("c")), "base": F.col("c") - F.col("c") % HUNDRED})
    bases = sizes.where("c = base").select("base", F.col("n").alias("there"))
    known = sizes.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    known = known.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    begins = turns.where((F.col("c") % HUNDRED == 0) & (F.col("pos") < MOST - 1)).withColumnRenamed("c", "base")
    taken = known.where("k > 0").join(begins, "base").where("pos < k").select("c", "len", "pos", "t1", "t2", "chars")
    own = turns.join(known, "c").where("pos >= h").select("c", "len", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t1", "t2", "chars")
    return taken.unionByName(own), known.select("c", "len")


def prefixes(turns: DataFrame, tables: Tables) -> DataFrame:
    """``c, len, d, a, b, pa, pb, cum, chars``: hashes of the first d turns and of the ones before, code points so far."""
    zobrist = turns.select("c", "len", "pos", "chars", F.xxhash64("pos", "t1", "t2").alias("z1"), F.xxhash64(F.lit(2), "t2", "pos", "t1").alias("z2")).withColumn("run", F.shiftright("pos", RUN.bit_length() - 1))
    so_far = Window.partitionBy("c", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"a": F.bit_xor("z1").over(so_far), "b": F.bit_xor("z2").over(so_far), "cum": F.sum("chars").over(so_far)}
    found = tables.write(zobrist.withColumns(sums), "runs")
    totals = found.where(F.col("len") > RUN).groupBy("c", "run").agg(F.bit_xor("z1").alias("a"), F.bit_xor("z2").alias("b"), F.sum("chars").alias("cum"))
    above = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for RUN turns
    carried = totals.select("c", "run", F.bit_xor("a").over(above).alias("a0"), F.bit_xor("b").over(above).alias("b0"), F.sum("cum").over(above).alias("cum0")).where("run > 0")
    if not carried.isEmpty():
        found = found.join(carried, ["c", "run"], "left").na.fill(0, ["a0", "b0", "cum0"])
        found = found.withColumns({"a": F.col("a").bitwiseXOR(F.col("a0")), "b": F.col("b").bitwiseXOR(F.col("b0")), "cum": F.col("cum") + F.col("cum0")})
    return found.select("c", "len", (F.col("pos") + 1).alias("d"), "a", "b", F.col("a").bitwiseXOR(F.col("z1")).alias("pa"), F.col("b").bitwiseXOR(F.col("z2")).alias("pb"), "cum", "chars")


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of rows begin that agree in all columns; the number of rows at the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.append(np.flatnonzero(new), n)


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in names]


def classes(ends: DataFrame) -> DataFrame:
    """``len, a, b, c, m, ends``: of equal conversations the least id, their number, and SHA-256 of their ids in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = PACKED // 20
        for batch in batches:
            if not batch.num_rows:
                continue
            n, a, b, c = _numpy(batch, "len", "a", "b", "c")
            ids, out = list(map(str, c.tolist())), []
            at = _runs([n, a, b])
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                out += [(low_, min(low_ + most, high)) for low_ in range(low, high, most)]
            lows, highs = np.array(out).T
            yield pa.record_batch([pa.array(x) for x in (n[lows], a[lows], b[lows], c[lows], highs - lows)] + [pa.array([",".join(ids[x:y]) for x, y in out])], names=["len", "a", "b", "c", "m", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, least, members, found = None, None, None, 0, []
        for batch in batches:
            for *here, c, m, ids in zip(*(batch.column(k).to_pylist() for k in ("len", "a", "b", "c", "m", "ids"))):
                if here != key:
                    if key is not None:
                        found.append((*key, least, members, state.hexdigest()))
                    key, state, least, members = here, hashlib.sha256(ids.encode()), c, m
                else:
                    state.update(b"," + ids.encode())
                    members += m
            if found:
                yield told(found)
                found = []
        if key is not None:
            yield told([(*key, least, members, state.hexdigest())])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in zip(*rows)], names=["len", "a", "b", "c", "m", "ends"])

    key = ["len", "a", "b"]
    packed = ends.repartitionByRange(*key, "c").sortWithinPartitions(*key, "c").mapInArrow(pack, "len long, a long, b long, c long, m long, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "c").mapInArrow(digest, "len long, a long, b long, c long, m long, ends string")


def branches(paths: DataFrame) -> DataFrame:
    """``d, a, b`` of the prefixes that are followed by more than one turn."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, pa_, pb, a, b = _numpy(batch, "d", "pa", "pb", "a", "b")
            at = _runs([d, pa_, pb])
            low, high = at[:-1], at[1:] - 1
            told = (a[low] != a[high]) | (b[low] != b[high])
            told[[0, -1]] = True  # these may go on in other batches and ranges
            low, high = low[told], high[told]
            yield pa.record_batch([pa.array(x) for x in (d[low] - 1, pa_[low], pb[low], a[low], b[low], a[high], b[high])], names=["d", "a", "b", "a1", "b1", "a2", "b2"])

    key = ["d", "pa", "pb", "a", "b"]
    # the representative is the last key, so that many with one beginning lie in several ranges
    met = paths.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key).mapInArrow(neighbours, "d long, a long, b long, a1 long, b1 long, a2 long, b2 long")
    ends = met.groupBy("d", "a", "b").agg(F.min(F.struct("a1", "b1")).alias("low"), F.max(F.struct("a2", "b2")).alias("high"))
    return ends.where("low <> high").select("d", "a", "b")


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    tables = Tables(df.sparkSession, "trie")
    turns = tables.write(hashed_turns(df, tables, **columns), "turns")
    tables.delete("placed")
    whole, known = rebuilt(turns)
    every = tables.write(prefixes(whole, tables), "prefixes")
    zero = F.lit(0).cast("long")
    ends = every.where("d = len").select("len", "a", "b", "c").unionByName(known.where("len = 0").select("len", zero.alias("a"), zero.alias("b"), "c"))
    of = tables.write(classes(ends), "classes")
    paths = tables.write(every.drop("len").join(of.select("c", "m", "len"), "c"), "paths")
    tables.delete("turns", "runs", "prefixes")

    # points, and the representatives' ways through them
    key = ["d", "a", "b"]
    # tables of their own, so that Spark may split a join's heavy prefixes
    points = tables.write(branches(paths).where("d > 0").unionByName(of.where("len > 0").select(F.col("len").alias("d"), "a", "b")).distinct(), "points")
    kept = ["c", "len", "m", "cum", *key]
    ways = tables.write(paths.join(points, key).select(kept), "ways")
    sums = tables.write(ways.groupBy(key).agg(F.sum("m").alias("n"), F.min("c").alias("owner"), F.max("len").alias("deepest")), "sums")
    top = of.agg(F.sum("m").alias("n"), F.min("c").alias("owner"), F.max("len").alias("deepest"))  # one row
    from_root = of.select("c", "len", "m", zero.alias("cum"), zero.alias("d"), zero.alias("a"), zero.alias("b")).crossJoin(F.broadcast(top))
    met = ways.join(sums, key).select(*kept, "n", "owner", "deepest").unionByName(from_root)

    down = Window.partitionBy("c").orderBy("d")
    own = F.col("owner") == F.col("c")
    met = met.withColumns({"d1": F.lag("d").over(down), "parent": F.lag("owner").over(down), "cum1": F.lag("cum").over(down), "owned_next": F.lead(own.cast("long"), 1, 0).over(down)})
    saving = F.when(own, (F.col("n") - 1) * (F.col("cum") - F.coalesce("cum1", "cum"))).otherwise(F.lit(0))
    leaf = (F.col("d") == F.col("len")) & (F.col("deepest") == F.col("d"))
    met = met.withColumns({"saving": saving, "leaf": leaf.cast("long")})
    met = met.withColumns({"below": F.coalesce(F.sum("saving").over(down.rowsBetween(1, Window.unboundedFollowing)), zero), "has_leaf": F.max("leaf").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    edge = F.max(F.when(own, F.struct("c", "d1", "parent", "cum", "n"))).alias("e")
    edges = met.groupBy(key).agg(F.sum("below").alias("below"), F.sum("owned_next").alias("children"), F.sum("has_leaf").alias("leaves"), edge)
    edges = edges.join(of.select(F.col("len").alias("d"), "a", "b", "ends"), key, "left")
    edges = tables.write(edges.select("e.*", F.col("d").alias("d2"), "below", "children", "leaves", F.coalesce("ends", F.lit(NOTHING)).alias("ends")), "edges")

    # unary nodes: the depths of an edge, RUN of them at a time
    inner = edges.where("d2 > 0").withColumnRenamed("cum", "cum2")
    inner = inner.withColumn("run", F.explode(F.sequence(F.floor(F.col("d1") / RUN), F.floor((F.col("d2") - 1) / RUN))))
    inner = inner.withColumn("d", F.explode(F.sequence(F.greatest(F.col("d1"), F.col("run") * RUN) + 1, F.least(F.col("d2"), (F.col("run") + 1) * RUN))))
    nodes = inner.join(paths.select("c", "d", "cum", "chars"), ["c", "d"])
    at_end = F.col("d") == F.col("d2")
    told = nodes.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") - 1 == F.col("d1"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("cum2") - F.col("cum") + F.col("chars"))).alias("saved_tokens"), F.when(at_end, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    root = edges.where("d2 = 0").select(F.col("c").alias("conv_id"), F.col("d2").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("below").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return told.unionByName(root)


def oracle() -> str:
    """SQL for DuckDB: every prefix of every rebuilt conversation as a list, every node with all nodes below it."""
    return f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n, c - c % {HUNDRED} AS base, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda s, x: list_reduce([xor(s, x)] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % {MOST} AS h
          FROM turns GROUP BY c),
parts AS (SELECT s.c, 0 AS side, t.pos, t.role, t.text FROM sizes s JOIN turns t ON t.c = s.base AND t.pos < s.h
          UNION ALL SELECT s.c, 1, t.pos, t.role, t.text FROM sizes s JOIN turns t ON t.c = s.c AND t.pos >= s.h),
whole AS (SELECT s.c, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY side, pos) FILTER (role IS NOT NULL), []) AS seq, coalesce(list(length(text) ORDER BY side, pos) FILTER (role IS NOT NULL), []) AS chars
          FROM sizes s LEFT JOIN parts p ON p.c = s.c GROUP BY s.c),
paths AS MATERIALIZED (SELECT c, d, len(seq) AS n, seq[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (SELECT d, key, min(c) AS conv, count(*) AS n_convs, any_value(chars) AS chars, max(n) = d AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM paths GROUP BY d, key),
below AS (SELECT p.d, p.key, sum((q.n_convs - 1) * q.chars) AS saved, count(*) FILTER (q.leaf) AS leaves, count(*) FILTER (q.d = p.d + 1) AS children FROM nodes q JOIN paths p ON p.c = q.conv AND p.d <= q.d GROUP BY p.d, p.key)
SELECT n.conv AS conv_id, n.d AS depth, u.conv AS parent_conv_id, n.n_convs, b.children AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.key = n.key LEFT JOIN nodes u ON u.d = n.d - 1 AND u.key = n.key[1:n.d - 1]
"""
