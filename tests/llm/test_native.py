"""Fingerprints and license scans: plans without Python, and brute force."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from matloom.llm import fingerprint, licenses


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_plans(odd):
    for df in (fingerprint.compare_with_edits(odd), licenses.scan_licenses(odd)):
        assert not any(w in plan(df) for w in ("Python", "Pandas", "Arrow"))


def one(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["lanes"] for r in fingerprint.fingerprints(df).collect()}


def test_order_does_not_matter_but_counts_do(spark):
    got = one(spark, ["one line\ntwo. Three", "two. Three\none line", "one line\none line\ntwo. Three", ""])
    assert got[0] == got[1] != got[2] and set(got[3]) == {0}


def test_insert_and_delete(spark):
    got = one(spark, ["first\nsecond", "third line", "first\nsecond\nthird line"])
    df = spark.createDataFrame([(got[0], got[1], got[2])], "a array<long>, b array<long>, c array<long>")
    r = df.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert r["sum"] == got[2] and r["rest"] == got[0]


def test_likeness_follows_shared_paragraphs(spark):
    base = [f"paragraph number {k}" for k in range(100)]
    other = [f"something else {k}" for k in range(100)]
    got = one(spark, ["\n".join(base), *["\n".join(base[:k] + other[k:]) for k in (90, 50, 0)]])
    df = spark.createDataFrame([(k, got[0], v) for k, v in got.items()], "k long, a array<long>, b array<long>")
    near = {r["k"]: r["n"] for r in df.select("k", fingerprint.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert near[0] == 1 and abs(near[1] - 0.9) < 0.08 and abs(near[2] - 0.5) < 0.25 and near[3] < 0.4


def check_edits(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    tie = {(r["doc_id"], r["t"]): r["h"] for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r]), reverse=True)
    wanted = []
    for k, (doc_id, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        wanted.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprint.compare_with_edits(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(wanted, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edits(spark, odd, none):
    check_edits(odd)
    check_edits(odd.where("doc_id = 1"))
    check_edits(spark.createDataFrame([(int(k) * 37 % 5000 - 900, f"text {k}. " * (k % 9)) for k in range(3000)], "doc_id long, text string"))
    assert fingerprint.compare_with_edits(none).count() == 0


def test_likeness_is_near_the_exact_one(spark):
    import re
    from collections import Counter

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    cut = lambda t: Counter(p for p in re.split(r"[\n\r]+|(?<=[^\w\s])[ \t]+", t) if p.strip(" "))
    order = sorted(texts, reverse=True)
    errors = []
    for r in fingerprint.compare_with_edits(df).collect():
        text, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(text) // 2
        for other, got in ((text[: len(text) - half] + after[:half], r["near_edited"]), (after, r["near_next"])):
            a, b = cut(text), cut(other)
            exact = 2 * sum(n * b[p] for p, n in a.items()) / max(1, sum(n * n for n in a.values()) + sum(n * n for n in b.values()))
            errors.append(abs(got - exact))
    errors = sorted(errors)
    assert sum(errors) / len(errors) < 0.06 and errors[int(0.95 * len(errors))] < 0.2 and errors[-1] < 0.5


def test_ranges_follow_the_rows(spark):
    from pyspark.sql import functions as F

    from matloom.llm.common import OrderedBuckets

    rows = [(k, f"t{k}") for k in range(6000)] + [(10**15, "far")] + [(None, f"n{k}") for k in range(6000)] + [(7, f"again {k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    buckets = OrderedBuckets(df, F.col("doc_id"), F.xxhash64("text"), target=1000)
    sizes = [r["count"] for r in df.groupBy(buckets.bucket().alias("b")).count().collect()]
    assert len(sizes) == len(buckets) > 12 and sum(sizes) == len(rows) and max(sizes) < 3000
    few = df.where("doc_id is null or doc_id < 40 or doc_id > 5990")
    check_edits(few)


@pytest.fixture(scope="module")
def licensed(spark):
    texts = [
        "Before. Released under the MIT License. After",
        "licensed  UNDER the apache\nlicense version 2 0",
        "x " * 500 + licenses.TEMPLATES["MIT-text"].replace("free of charge", "at no charge") + " y" * 300,
        licenses.TEMPLATES["GPL-3.0-notice"][:60],
        "MIT License released", "", None, "MIT", "Released under the",
        " ".join(licenses.TEMPLATES.values()),
        licenses.TEMPLATES["ISC"] + " ... " + licenses.TEMPLATES["ISC"],
    ]
    return spark.createDataFrame([(k // 2, t, "license") for k, t in enumerate(texts)], "doc_id long, text string, license string")


def test_licenses_by_brute_force(spark, licensed, odd, none):
    for df in (licensed, odd):
        documents = df.select("doc_id", "text").toPandas()  # noqa: F841  read by DuckDB
        con = duckdb.connect()
        con.register("documents", documents)
        wanted = sorted((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in con.sql(licenses.oracle()).fetchall())
        assert sorted(tuple(r) for r in licenses.scan_licenses(df).collect()) == wanted
    found = {r["license"] for r in licenses.scan_licenses(licensed).collect()}
    assert {"MIT", "Apache-2.0", "MIT-text", "ISC"} <= found
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(licensed, templates={}).count() == 0


def test_every_template_is_found_at_every_offset(spark):
    rows = [(k, " ".join(["filler%d" % (k * 31 + j) for j in range(k)]) + " " + t + " and so on for ever and ever") for k in range(9) for t in licenses.TEMPLATES.values()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").groupBy("license").count().collect()
    assert {r["license"] for r in got} == set(licenses.TEMPLATES) and all(r["count"] >= 9 for r in got)


def test_versions_and_variants_are_not_taken_for_one_another(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    clauses = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    altered = "This work is licensed under the GNU General Public License, version 2. " + "filler " * 30 + "That work is licensed under the GNU General Public License, version 3."
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0"}),
        (creative.format("-ShareAlike"), {"CC-BY-SA-4.0-text"}),
        (creative.format("-NonCommercial"), {"CC-BY-NC-4.0-text"}),
        (creative.format("-NoDerivatives"), {"CC-BY-ND-4.0-text"}),
        (creative.format("-NonCommercial-ShareAlike"), {"CC-BY-NC-SA-4.0-text"}),
        (creative.format(""), {"CC-BY-4.0"}),
        (gpl.format("Lesser "), {"LGPL-notice"}),
        (gpl.format("Affero "), {"AGPL-notice"}),
        (gpl.format(""), {"GPL-notice"}),
        (gpl.format("") + "; either version 2 of the License, or (at your option) any later version.", {"GPL-notice", "GPL-2.0-notice"}),
        (clauses + end, {"BSD", "BSD-2-Clause"}),
        (clauses + third + end, {"BSD", "BSD-3-Clause"}),
        (altered, {"GPL-2.0", "GPL-3.0"}),  # the second one counts where it stands, though more of it is in the first
    ]
    cases += [(t, {k}) for k, t in licenses.TEMPLATES.items() if k.endswith(("-4.0", "-3.0", "-2.0")) and k.startswith(("CC", "GPL", "LGPL", "AGPL", "EPL"))]
    df = spark.createDataFrame([(k, "Before. " + t + " After.") for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got: dict[int, set] = {k: set() for k in range(len(cases))}
    for r in licenses.scan_licenses(df).collect():
        got[r["doc_id"]].add(r["license"])
    assert [got[k] for k in got] == [names for _, names in cases]


def licenses_of(con, df):
    documents = df.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    return sorted((int(r[0]), *r[1:]) for r in con.sql(licenses.oracle()).fetchall())


def test_overlapping_versions_are_chosen_as_in_the_sql(spark):
    versions = [v for k, v in sorted(licenses.TEMPLATES.items()) if k.startswith(("GPL", "LGPL", "AGPL", "CC", "EPL", "BSD"))]
    rows = [(k, f"Before. {v} {'and so on ' * (k % 4)}{versions[(k * 7 + 3) % len(versions)]} After.") for k, v in enumerate(versions)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.scan_licenses(df).collect()) == licenses_of(duckdb.connect(), df)


def test_recall_of_bands_on_altered_templates(spark):
    import random

    draw, rows = random.Random(9), []
    for k in range(3000):
        words = draw.choice(sorted(licenses.TEMPLATES.values())).split()
        for _ in range(draw.randrange(1 + len(words) // 12)):
            at = draw.randrange(len(words))
            words[at : at + draw.choice((0, 1, 1))] = [f"other{draw.randrange(99)}"] * draw.choice((0, 1))
        rows.append((k, " ".join([f"w{draw.randrange(999)}" for _ in range(draw.randrange(9))] + words + ["and", "more"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, wanted = {tuple(r) for r in licenses.scan_licenses(df).collect()}, set(licenses_of(duckdb.connect(), df))
    assert len(wanted) > 2500 and got <= wanted and len(got) >= 0.999 * len(wanted)


def test_texts_are_shuffled_once(odd):
    text = fingerprint.compare_with_edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Window") == 1
