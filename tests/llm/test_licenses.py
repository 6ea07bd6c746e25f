import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from driftline.llm import licenses, license_rules, queries

RULES = license_rules.RULES
PATTERNS = [re.compile(rf"(?<![^ ])(?:{p})(?![^ ])") for *_, p in RULES]
ANY = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_base(text):
    words = ANY.findall(lowered(text))
    places = [
        (label, i) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(places, key=lambda p: (p[1], p[0]))


def slow_rules(text):
    """Every rule on every text; overlaps settled by comparing all pairs."""
    norm = " ".join(ANY.findall(lowered(text)))
    found = [(i, m.start(), m.end()) for i, p in enumerate(PATTERNS) for m in p.finditer(norm)]
    inside = lambda d, e: e[1] <= d[1] and d[2] <= e[2] and ((e[1], e[2]) != (d[1], d[2]) or e[0] < d[0])
    whole = [d for d in found if not any(inside(d, e) for e in found)]
    kept = []
    for d in sorted(whole, key=lambda d: d[:2]):
        if not any(d[1] < e[2] and e[1] < d[2] for e in kept):
            kept.append(d)
    word = lambda at: norm.count(" ", 0, at)
    return [(RULES[i][0], RULES[i][1], word(a), word(b - 1)) for i, a, b in sorted(kept, key=lambda d: d[1:])]


LABELS = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "either version 2 of the License, or (at your option) any later version of the GNU General Public License": "gpl-2.0-or-later",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl-2.1-or-later",
    "GNU Affero General Public License v3.0 only": "agpl-3.0-only",
    "GPLv2+ is not a word, GPL v2 or later is": "gpl-2.0,gpl-2.0-or-later",
    "LGPL-2.1": "lgpl-2.1",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
    "https://creativecommons.org/licenses/by-nd/4.0/": "cc-by-nd-4.0",
    "CC0 1.0 Universal": "cc0-1.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance": "apache-2.0",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd-2-clause",
    "Mozilla Public License, v. 2.0": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "three-clause BSD license": "bsd-3-clause",
    "MIT license and Apache license 2.0": "apache-2.0,mit",
    "Er fährt mit der Lizenz zum Lesen": "",
    "a license to drive, an artist's statement": "",
    "GNU GENERAL PUBLIC LICENCE": "gpl",
}


@pytest.mark.parametrize("text, labels", LABELS.items())
def test_labels(text, labels):
    assert ",".join(sorted({x[0] for x in licenses.scan(text)[2]})) == labels


def test_hundreds_of_rules_with_unique_patterns():
    assert len(RULES) >= 300
    assert len({(label, p) for label, _, _, p in RULES}) == len(RULES)
    assert all(0 < c <= 1 for _, c, _, _ in RULES)


@pytest.mark.parametrize("at", range(0, len(RULES), 3))
def test_keywords_stand_in_every_match(at):
    _, _, keywords, pattern = RULES[at]
    words = re.compile(pattern.replace("[^ ]", "[a-z]"), re.ASCII)

    @settings(max_examples=15, deadline=None)
    @given(st.from_regex(words, fullmatch=True))
    def check(text):
        assert any(k in text for k in keywords)

    check()


def some_texts(n, seed):
    rng = random.Random(seed)
    bits = [*LABELS, "cc by", "CC\nBY", "gnu general public license", "Apache License", "mit license", "version 3", "or later", "only", "GPL", "K", "É", "x", "2.0", "0", "\x00", "license" * 3]
    return [rng.choice([" ", ", ", "\n", ""]).join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_scan_equals_slow_version():
    for text in some_texts(250, 1) + [None, "", " \n", "cc by " * 500, "gnu " * 300 + "general public license"]:
        n, base, found = licenses.scan(text)
        assert (n, sorted(base, key=lambda p: (p[1], p[0]))) == slow_base(text)
        assert found == slow_rules(text), text


def test_long_texts_are_read_to_the_end():
    text = "word " * 400_000 + "MIT License. " + "cc by " * 50_000 + "GPLv3"
    n, base, found = licenses.scan(text)
    assert n == 500_003 and len(base) == 50_001 and base[0] == ("mit", 400_000)
    assert found[0][0] == "mit" and found[-1] == ("gpl-3.0", 0.95, 500_002, 500_002)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_license_rules(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n, base = slow_base(text)
        found = slow_rules(text)
        labels = {label for label, _ in base}
        at = [i for _, i in base] or [None]
        want = (doc_id, n, len(base), min(at), max(at), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in found})), max([x[1] for x in found], default=0.0))
        assert tuple(got[doc_id]) == want


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "MIT License"), (2, "MIT License")]
    frame = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, n_words string, label int")
    found = licenses.find_licenses(frame)
    assert found.columns == ["doc_id", "text", "label", "n_words", "base_places", "licenses"]
    got = licenses.digest(found, ["doc_id", "label"]).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in got) == [(0, 0, "", 0.0), (1, 0, "", 0.0), (1, 0, "", 0.0), (2, 2, "mit", 0.95), (2, 2, "mit", 0.95)]
    assert licenses.find_licenses(frame.limit(0)).count() == 0
