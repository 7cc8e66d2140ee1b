"""Secret scans: candidates by patterns, told apart by how many owners in the whole corpus hold the same value.

One pass over the texts finds candidates and hashes their values; texts go no further. Base kinds are ``assign``,
``access`` and ``hex``. Values are counted over the corpus by distinct repositories (source and language) and distinct owners
(source): a value that more than ``MOST_OWNERS`` owners hold is a widely copied example, the others are *live-looking*.

Base spans always stay. The method adds, where the value is live-looking: tokens with a vendor's prefix (``vendor``), private
keys (``pem``), signed tokens (``jwt``), passwords in addresses (``url``), and bare repetitions (``reuse``) of any such or base value
elsewhere in the corpus without the words that gave it away. ``n_live`` and ``n_copied`` count a text's spans of each class.

Values are counted by repository, then owner, then in all, with partial sums in every task, so a value found in a third of
all texts is one row a task; the join back is one on hashes, whose heavy ones Spark may split.

Defined cases: a null or empty text has no spans; rows with null or repeated ids are scanned one by one; a null source or language is
one of its own; texts are scanned whole; equal spans of two kinds are both listed; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import Tables

MOST_OWNERS = 3


def _either(words: str) -> str:
    """A pattern's letters in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# Patterns, by kind in order, with the group that holds the value and its least length.
KINDS = {
    "assign": (_either("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "vendor": (r"(gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_|AIza|SG\.)[A-Za-z0-9_.-]+", 0, 24),
    "pem": (r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----[\r\n\x20]+([A-Za-z0-9+/=]+)", 2, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "url": (r"(https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s:@/]+:([^\s:@/]+)@", 2, 6),
    "reuse": (r"[A-Za-z0-9+/_=-]+", 0, 12),
}
BASE = 3
NAMES = list(KINDS)
# hex runs and tokens are cheaper to find with their length in the pattern, which changes no match: no shorter one lies inside
_FAST = {"hex": r"[0-9a-f]{24,}", "reuse": r"[A-Za-z0-9+/_=-]{12,}"}
_COMPILED = [(k, re.compile(_FAST.get(name, rx)), group, least) for k, (name, (rx, group, least)) in enumerate(KINDS.items())]
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``start, kind, end, value`` in order, ends exclusive; bare tokens only where no other candidate is."""
    found = [(m.start(), k, m.end(), m[group]) for k, rx, group, least in _COMPILED[:-1] for m in rx.finditer(text) if len(m[group]) >= least]
    found.sort()
    k, rx, _, _ = _COMPILED[-1]
    tokens = [(m.start(), k, m.end(), m[0]) for m in rx.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    if tokens and found:
        merged, end, at = [], -1, 0
        for token in tokens:  # both in order; an earlier span may reach far
            while at < len(found) and found[at][0] < token[2]:
                end = max(end, found[at][2])
                at += 1
            if end <= token[0]:
                merged.append(token)
        tokens = merged
    return sorted(found + tokens)


def hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def _scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """A row for each text: ids, base columns, and arrays of its candidates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, shas, kinds, starts, ends, hashes = [], [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = candidates(text)
                    base = [x for x in found if x[1] < BASE]
                    counts.append([sum(x[1] == k for x in base) for k in range(BASE)])
                    shas.append(hashlib.sha256(",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest())
                    kinds.append([x[1] for x in found])
                    starts.append([x[0] for x in found])
                    ends.append([x[2] for x in found])
                    hashes.append([hashed(x[3]) for x in found])
                longs = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
                arrays = [pa.array(x, pa.list_(t)) for x, t in ((kinds, pa.int32()), (starts, pa.int64()), (ends, pa.int64()), (hashes, pa.int64()))]
                yield pa.record_batch([*(batch.column(k) for k in ("row", "doc_id", "owner", "repo")), *longs, pa.array(shas), *arrays], names=["row", "doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "kind", "start", "end", "hash"])

    texts = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in repo_cols])).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(scan, "row long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, kind array<int>, start array<long>, end array<long>, hash array<long>")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories, texts`` of every value that a pattern with context gave."""
    strong = found.select("row", "owner", "repo", F.explode(F.array_distinct(F.transform(F.filter(F.arrays_zip("kind", "hash"), lambda x: x["kind"] < len(NAMES) - 1), lambda x: x["hash"]))).alias("hash"))
    by_repo = strong.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("texts"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("texts").alias("texts"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("texts").alias("texts"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: list[str] | None = None, *, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` of each row."""
    tables = Tables(df.sparkSession, "secrets")
    found = tables.write(_scan(df, id_col, text_col, owner_col, repo_cols or ["source", "lang"]), "candidates")
    values = ownership(found).select("hash", (F.col("owners") <= most_owners).alias("live"))
    spans = found.where(F.size("kind") > 0).select("row", F.explode(F.arrays_zip("kind", "start", "end", "hash")).alias("s")).select("row", "s.*")
    known = spans.join(values, "hash").where((F.col("kind") < BASE) | F.col("live"))
    told = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, NAMES)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    of = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("x"))  # as long as a text has spans
    of = of.select("row", F.array_join(F.transform("x", told), ",").alias("spans"), F.size(F.filter("x", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("x", lambda x: ~x["live"])).cast("long").alias("n_copied"))
    plain = found.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    whole = plain.join(of, "row", "left")
    return whole.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def oracle(most_owners: int = MOST_OWNERS) -> str:
    """SQL for DuckDB: matches and the gaps between them give places."""

    def matches(k: int) -> str:
        rx, group, least = KINDS[NAMES[k]]
        rx = rx.replace("'", "''")
        return f"""SELECT r, {k} AS kind, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS a, length(ms[k]) AS n, vs[k] AS v
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT r, regexp_extract_all(text, '{rx}') AS ms, regexp_extract_all(text, '{rx}', {group}) AS vs, string_split_regex(text, '{rx}') AS gaps FROM docs))
WHERE length(vs[k]) >= {least}"""

    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{NAMES[k]}" for k in range(BASE))
    last = len(NAMES) - 1
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, 'none') AS owner, coalesce(text, '') AS text FROM documents),
strong AS MATERIALIZED ({" UNION ALL ".join(matches(k) for k in range(last))}),
bare AS (SELECT * FROM ({matches(last)}) AS b WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.r = b.r AND s.a < b.a + b.n AND b.a < s.a + s.n)),
own AS (SELECT v, count(DISTINCT owner) <= {most_owners} AS live FROM strong JOIN docs USING (r) GROUP BY v),
spans AS (SELECT r, kind, a, live, {names}[kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS s, a + n AS z FROM (SELECT * FROM strong UNION ALL SELECT * FROM bare) JOIN own USING (v) WHERE kind < {BASE} OR live)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < {BASE}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""
