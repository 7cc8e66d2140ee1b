"""Document fingerprints: homomorphic multiset hashes of paragraphs, by DataFrame functions alone.

A text is cut into paragraphs: at line ends and, so that short texts have some as well, at blanks behind any punctuation.
Every paragraph is hashed to a wide vector, and the vectors are added lane by lane modulo 2^60. The sum doesn't depend on
the paragraphs' order, equal multisets have equal sums, and a paragraph is inserted or deleted by adding or subtracting
its vector.

Lanes: 1 counts the paragraphs, 4 are full hashes under different seeds, 60 hold two counters each of 30 bits (a text of
2 GB can't overflow them), one for each of 120 bits of two other hashes. A counter, taken as +1 or -1 for each
paragraph, is a random projection of the vector of the paragraphs' counts, and so is the difference of two texts'
counters: mean squares over the 120 counters estimate the squared lengths of a text's vector and of the difference of
two, and so the likeness 1 - |a - b|^2 / (|a|^2 + |b|^2). Where no paragraph repeats that is the share of paragraphs in
common, 2 |both| / (|a| + |b|). The relative error of a squared length is sqrt(2 / 120), 0.13, one standard deviation.

Defined cases: a null or empty text has the fingerprint of no paragraphs, and two of these have likeness 1; repeated
rows keep a row each; rows with equal ids follow by descending hash of the text; rows without an id come last in
descending order; a table of one document is its own next; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.llm.common import OrderedBuckets

MODULUS = 1 << 60
STRONG, HASHES, FIELD = 4, 2, 30
PACKED = HASHES * FIELD
ONES = 1 | 1 << FIELD
CUT = r"[\n\r]+|(?<=[^\p{L}\p{N}\s])[ \t]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), CUT), lambda p: F.trim(p) != "")


def _total(values: Column, lane) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: (total + lane(v)) % F.lit(MODULUS))


def lanes(found: Column) -> Column:
    """The sum of the vectors of an array of paragraphs."""
    strong = [_total(found, lambda p, k=k: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(MODULUS - 1))) for k in range(1, STRONG + 1)]
    seeded = lambda seed: F.transform(found, lambda p: F.xxhash64(F.lit(seed), p))
    hashed = [seeded(seed) for seed in range(HASHES)]
    packed = [_total(hashes, lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ONES))) for hashes in hashed for k in range(FIELD)]
    return F.array(F.size(found).cast("long"), *strong, *packed)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint's lanes after inserting (``sign`` 1) or deleting (-1) the paragraphs summed in ``b``."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y + F.lit(MODULUS)) % F.lit(MODULUS))


def as_string(of: Column) -> Column:
    return F.concat_ws("", F.transform(of, lambda x: F.lpad(F.hex(x), 15, "0")))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, by the lanes alone."""
    count_a, count_b = F.element_at(a, 1), F.element_at(b, 1)

    def steps(lane: Column, count: Column) -> list[Column]:
        fields = [F.shiftrightunsigned(lane, k * FIELD).bitwiseAND(F.lit((1 << FIELD) - 1)) for k in range(2)]
        return [(2 * f - count).cast("double") for f in fields]

    def squares(x: Column, y: Column) -> Column:
        of_x, of_y = steps(x, count_a), steps(y, count_b)
        apart = sum((p - q) * (p - q) for p, q in zip(of_x, of_y))
        return F.struct(apart.alias("apart"), sum(p * p for p in of_x + of_y).alias("all"))

    first = 2 + STRONG
    found = F.zip_with(F.slice(a, first, PACKED), F.slice(b, first, PACKED), squares)
    total = lambda field: F.aggregate(F.transform(found, lambda s: s[field]), F.lit(0.0), lambda t, s: t + s)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - total("apart") / F.greatest(total("all"), F.lit(1e-9)))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_chars, lanes`` of every row."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = texts.withColumn("_cut", paragraphs(F.col("text")))
    return cut.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), lanes(F.col("_cut")).alias("lanes"))


def with_next(df: DataFrame, key: str, tie: Column, carried: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the next row in descending order of ``key`` and ``tie``; the first follows the last.

    Rows are windowed in consecutive ranges of both. The first row of each range is also dealt, as a guest, to the
    range before it in that order, so that no range needs another one and no window spans the table.
    """
    buckets = OrderedBuckets(df, F.col(key), tie)
    n, high = max(1, len(buckets)), [h for _, h in buckets.ranges] or [(0, 0, 0)]
    dealt = df.withColumn("_bucket", buckets.bucket()).withColumns(dict(zip(("_there", "_key", "_tie"), buckets.place())))
    last = [F.element_at(F.split(F.lit(",".join(str(h[k]) for h in high)), ",").cast("array<bigint>"), F.col("_bucket") + 1) for k in range(3)]
    head = (F.col("_there") == last[0]) & (F.col("_key") == last[1]) & (F.col("_tie") == last[2])
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("_bucket") + 1, F.lit(n)).alias("bucket"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("_place", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"_bucket": F.col("_place.bucket"), "_guest": F.col("_place.guest")}).drop("_place")
    window = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_there"), F.desc("_key"), F.desc("_tie"))
    dealt = dealt.withColumns({f"next_{column}": F.lead(column).over(window) for column in carried})  # one shuffle for all
    return dealt.where("_guest = 0").drop("_bucket", "_guest", "_there", "_key", "_tie")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    after = with_next(fingerprints(df, id_col, text_col), "doc_id", F.xxhash64("text"), ["text", "lanes"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = after.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "lanes", "next_lanes", paragraphs(F.col("edited")).alias("_cut"))
    edited = edited.select("doc_id", "n_chars", "edited_sha256", "lanes", "next_lanes", lanes(F.col("_cut")).alias("edited_lanes"))
    return edited.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("lanes")).alias("fingerprint"), as_string(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
