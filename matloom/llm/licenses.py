"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

DataFrame functions alone. Words are runs of letters and digits, lower-cased; a shingle is three words. A window has
``WINDOW`` = 3 shingles (5 words) and one begins at every shingle of texts and templates. Each of ``BANDS`` = 4 bands is one
minimum, of the window's shingle hashes under the band's own permutation (an exclusive-or with a constant). A template is
retrieved by the table of band keys alone: where any window of the text has a key of any of the template's windows.

Band settings: where three neighbouring shingles of a template stand in the text, the windows are equal and all bands agree
for certain. So every whole template is retrieved (the shortest has 3 shingles), and so is one with changed words, as
containment of 0.8 leaves runs of that length: a changed word costs 3 shingles, so a template of n shingles has n / 15 of
them at most. A window that has two of three shingles in common has likeness 1/2, and one of 4 bands agrees with
probability 1 - 2^-4 = 0.94 for each such window.

A retrieved template is verified exactly: over every stretch of the text a quarter longer than the template, the share
of the template's distinct shingles that occur there. Versions and variants of a license differ in few words, so a stretch
only counts if no stretch of another template with a larger share covers half of it or more (equal shares all count). The
largest share that counts is the template's containment. The SQL of ``oracle`` has the same choice, by joins over every
shingle of every text.

Defined cases: a null, empty or short text matches nothing; texts are scanned whole; rows with null or repeated ids are
scanned one by one, with a row out for each license found in each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, BANDS, SHINGLE = 3, 4, 3

# Names and notices of public licenses. What several versions or variants share has a name of its own
# ("BSD", "GPL-notice"), so that a text that tells no version isn't given one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Artistic-2.0": "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib-condition": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}
for _kind, _name, _versions in (("GPL", "", ("1", "2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    _notice = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name}General Public License{{}} as published by the Free Software Foundation"
    TEMPLATES[f"{_kind}-notice"] = _notice.format("")
    for _version in _versions:
        _full = f"{_kind}-{_version if '.' in _version else _version + '.0'}"
        TEMPLATES[_full] = f"This work is licensed under the GNU {_name}General Public License, version {_version}."
        TEMPLATES[f"{_full}-notice"] = _notice.format("") + f", either version {_version} of the License, or (at your option) any later version"
        TEMPLATES[f"{_full}-only-notice"] = _notice.format(f" version {_version}")
for _full, _date in (("GPL-2.0", "Version 2, June 1991"), ("GPL-3.0", "Version 3, 29 June 2007"), ("LGPL-2.1", "Version 2.1, February 1999"), ("LGPL-3.0", "Version 3, 29 June 2007"), ("AGPL-3.0", "Version 3, 19 November 2007")):
    TEMPLATES[f"{_full}-text"] = f"GNU { {'L': 'Lesser ', 'A': 'Affero '}.get(_full[0], '')}General Public License {_date}"
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[k] for k in _kind.split("-"))
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_kind}-{_version}"] = f"Licensed under CC {_kind} {_version}."
        TEMPLATES[f"CC-{_kind}-{_version}-text"] = f"This work is licensed under a Creative Commons {_long} {_version} {_port} License."
# the long form had this name before there were two
TEMPLATES["CC-BY-4.0"], TEMPLATES["CC-BY-4.0-short"] = TEMPLATES.pop("CC-BY-4.0-text"), TEMPLATES["CC-BY-4.0"]


def shingles(text: Column) -> Column:
    """Hashes of the three-word shingles of a text, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(
        F.array(words),  # so that the words are made once
        lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(SHINGLE)) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>")),
    )[0]


def _constant(band: int) -> int:
    value = (band * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)
    return value - (1 << 64) if value >> 63 else value


def band_keys(hashes: Column) -> list[Column]:
    """For each band the minima of all windows; those at the end are shorter."""

    def minima(band: int) -> Column:
        permuted = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_constant(band))))
        later = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
        lower = lambda a, b: F.least(a, b)  # noqa: E731  of a missing one the other
        return _once(permuted, lambda x: F.zip_with(F.zip_with(x, later(x, 1), lower), later(x, 2), lower))

    return [minima(band) for band in range(BANDS)]


def template_table(spark: SparkSession, templates: dict[str, str]) -> list:
    """(license, distinct shingles, keys of all windows by band) of each template; a bounded list."""
    if not templates:
        return []
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("hashes", shingles(F.col("text")))
    found = rows.select("license", F.array_distinct("hashes").alias("shingles"), _once(F.col("hashes"), lambda h: F.array(*map(F.array_distinct, band_keys(h)))).alias("keys")).collect()
    return sorted((r for r in found if r["shingles"]), key=lambda r: r["license"])


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded to one literal; thousands of nodes are slow to plan


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """``doc_id, license, containment, first_word`` of each license found in each row; words count from 0."""
    table = template_table(df.sparkSession, TEMPLATES if templates is None else templates)
    schema = "doc_id long, license string, containment double, first_word int"
    if not table:
        return df.sparkSession.createDataFrame([], schema)
    keys = [sorted({k for r in table for k in r["keys"][band]}) for band in range(BANDS)]
    wanted = F.array(*[F.struct(F.lit(r["license"]).alias("license"), _longs(r["shingles"]).alias("own"), _longs(sorted({k for band in r["keys"] for k in band})).alias("template_keys")) for r in table])
    longest = max(-(-5 * len(r["shingles"]) // 4) for r in table)

    def retrieved(hashes: Column) -> Column:
        met = lambda minima, known: F.filter(minima, lambda k: k.isin(known))
        hits = F.flatten(F.array(*map(met, band_keys(hashes), keys)))
        return _once(hits, lambda h: F.when(F.size(h) > 0, F.filter(wanted, lambda t: F.arrays_overlap(h, t["template_keys"]))).otherwise(F.slice(wanted, 1, 0)))

    def unbeaten(met: Column, stretches: Column) -> Column:
        # a stretch is as long as the longest template's at most, and a template has one at most from each place
        reach = F.size(met) * F.lit(longest)
        beats = lambda o, s: (o["share"] > s["share"]) & (o["license"] != s["license"]) & _covers(o, s)
        return F.filter(stretches, lambda s, k: ~F.exists(F.slice(stretches, F.greatest(k - reach, F.lit(0)) + 1, 2 * reach + 1), lambda o: beats(o, s)))

    def best(left: Column) -> Column:
        top = lambda name: F.array_max(F.transform(F.filter(left, lambda s: s["license"] == name), lambda s: F.struct(s["share"].alias("share"), (-s["start"]).alias("back"))))
        return F.transform(F.array_distinct(F.transform(left, lambda s: s["license"])), lambda name: F.struct(name.alias("license"), top(name).alias("best")))

    def scan(hashes: Column) -> Column:
        stretches = lambda met: F.array_sort(F.flatten(F.transform(met, lambda t: _stretches(hashes, t["license"], t["own"], least))))
        return _once(retrieved(hashes), lambda met: _once(_once(stretches(met), lambda all_: unbeaten(met, all_)), best))

    # one expression below one generator: a step that is a column of its own would be made anew wherever it is read
    found = df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(_once(shingles(F.coalesce(F.col(text_col), F.lit(""))), scan)).alias("f"))
    return found.select("doc_id", "f.license", F.col("f.best.share").alias("containment"), (-F.col("f.best.back")).cast("int").alias("first_word"))


def _once(value: Column, f) -> Column:
    """``f(value)`` where the value is made once, however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def _stretches(hashes: Column, license: Column, own: Column, least: float) -> Column:
    """``start, end, share, license`` of a template's stretches that hold enough of it, the best ones where they
    overlap; they begin and end with a shingle of the template."""
    span = F.ceil(F.size(own) * 1.25).cast("int")
    places = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(own, h), i)), lambda i: i.isNotNull())

    def shared(ps: Column) -> Column:
        shares = F.transform(ps, lambda i, k: F.struct(i.alias("start"), k.alias("k"), (F.size(F.array_intersect(F.slice(hashes, i + 1, span), own)) / F.size(own)).alias("share")))
        enough = F.filter(shares, lambda s: s["share"] >= F.lit(least))
        end = lambda s: F.array_max(F.filter(F.slice(ps, s["k"] + 1, span), lambda p: p < s["start"] + span))
        return F.transform(enough, lambda s: F.struct(s["start"].alias("start"), end(s).alias("end"), s["share"].alias("share"), license.alias("license")))

    def peaks(all_: Column) -> Column:
        higher = lambda o, s: ((o["share"] > s["share"]) | ((o["share"] == s["share"]) & (o["start"] < s["start"]))) & _covers(o, s)
        return F.filter(all_, lambda s, k: ~F.exists(F.slice(all_, F.greatest(k - span, F.lit(0)) + 1, 2 * span + 1), lambda o: higher(o, s)))

    return _once(_once(places, shared), peaks)


def _covers(other: Column, s: Column) -> Column:
    """Whether another stretch covers half of this one at least."""
    return 2 * (F.least(other["end"], s["end"]) - F.greatest(other["start"], s["start"]) + 1) >= s["end"] - s["start"] + 1


def oracle(templates: dict[str, str] | None = None, least: float = 0.8) -> str:
    """SQL for DuckDB by brute force: every stretch of every text against every template, then the choice among them."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((TEMPLATES if templates is None else templates).items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
own AS (SELECT license, {words.format("text")} AS w FROM (VALUES {rows}) AS t(license, text)),
parts AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
          FROM (SELECT license, w, unnest(range(1, len(w) - 1)) AS i FROM own)),
sizes AS (SELECT license, count(*) AS n FROM parts GROUP BY license),
spread AS (SELECT r, doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
           FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
hits AS (SELECT r, doc_id, p, s, license FROM spread JOIN parts USING (s)),
shares AS MATERIALIZED (SELECT a.r, a.doc_id, a.license, a.p, max(b.p) AS e, count(DISTINCT b.s) / any_value(n) AS share
           FROM hits a JOIN sizes USING (license) JOIN hits b ON a.r = b.r AND a.license = b.license AND b.p >= a.p AND b.p < a.p + ceil(n * 1.25)
           GROUP BY a.r, a.doc_id, a.license, a.p HAVING share >= {least}),
peaks AS MATERIALIZED (SELECT * FROM shares s WHERE NOT EXISTS (SELECT 1 FROM shares o WHERE o.r = s.r AND o.license = s.license
           AND (o.share > s.share OR o.share = s.share AND o.p < s.p) AND 2 * (least(o.e, s.e) - greatest(o.p, s.p) + 1) >= s.e - s.p + 1)),
chosen AS (SELECT * FROM peaks s WHERE NOT EXISTS (SELECT 1 FROM peaks o WHERE o.r = s.r AND o.license <> s.license
           AND o.share > s.share AND 2 * (least(o.e, s.e) - greatest(o.p, s.p) + 1) >= s.e - s.p + 1))
SELECT doc_id, license, CAST(max(share) AS DOUBLE) AS containment, CAST(arg_max(p, struct_pack(share := share, back := -p)) AS INTEGER) AS first_word FROM chosen GROUP BY r, doc_id, license
"""
