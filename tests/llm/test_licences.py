import re
import time

import numpy as np

from docmill.llm import licences, registry
from docmill.llm.licence_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(label, i) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op9_licences(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any("apache-2.0" in r.labels for r in got)


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    letters = [b"a", b"b", b"c"]
    for _ in range(60):
        seqs = [[letters[i] for i in rng.integers(0, 3, rng.integers(1, 9))] for _ in range(3)]
        sam = licences.Automaton(seqs)
        subs = {tuple(s[i:j]): set() for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for k, s in enumerate(seqs):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    subs[tuple(s[i:j])].add((k, j))
        for sub, ends in subs.items():
            at = sam.find(list(sub))
            assert sam.ends[at] == ends and sam.length[sam.link[at]] < len(sub) <= sam.length[at]


def test_templates_are_found_with_edits():
    scanner = licences.Scanner()
    for name, text in TEMPLATES.items():
        words = [b"xx"] * 7 + licences.words_of(text) + [b"yy"] * 5
        spans = scanner.scan(words)[1]
        assert name.split("#")[0] in [s[0] for s in spans], name
    mit = licences.words_of(TEMPLATES["mit"])
    changed = [b"zz" if i % 17 == 8 else w for i, w in enumerate(mit)]
    (label, first, last, cover), = scanner.scan([b"q"] * 3 + changed + [b"q"])[1]
    assert label == "mit" and first <= 12 and last >= len(mit) - 12 and 0.8 < cover < 1
    assert scanner.scan(licences.words_of("the of and to in this software is free and the rights"))[1] == []


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "CC BY CC-BY"), (4, "All rights reserved " * 20000), (None, "cc\xe9 by"), (None, "cc\xe9 by")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, labels int")
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in licences.scan(df).collect()]
    assert got[:3] == [(1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 4, 2, 0, 2, "cc-by")]
    assert got[3] == (4, 60000, 20000, 0, 59997, "reserved") and got[4] == got[5] == (None, 2, 0, None, None, "")
    assert licences.scan(df.filter("doc_id > 9")).count() == 0


def test_many_notices_take_linear_time():
    scanner, began = licences.Scanner(), time.perf_counter()
    spans = scanner.scan(licences.words_of((TEMPLATES["cc-by-4.0"] + " xx ") * 60_000))[1]  # 5 MB
    assert len(spans) == 60_000 and all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert time.perf_counter() - began < 30


def test_overlapping_spans_equal_brute_force():
    rng, scanner = np.random.default_rng(5), licences.Scanner()
    parts = [licences.words_of(t) for t in TEMPLATES.values()]
    for _ in range(30):
        words = [w for i in rng.integers(0, len(parts), 12) for w in parts[i][rng.integers(0, 3) :][: rng.integers(5, 400)] + [b"q"] * rng.integers(0, 3)]
        spans = scanner.scan(words)[1]
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))
        assert all(0 <= a <= b < len(words) and 0 < c <= 1 for _, a, b, c in spans)


def labels_of(text):
    return {s[0] for s in licences.Scanner().scan(licences.words_of(text))[1]}


def test_short_notices():
    for text, label in {
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "SPDX-License-Identifier: MIT-0": "mit-0", "SPDX-License-Identifier: MIT": "mit",
        "Licensed under the MIT license.": "mit", "Released under the BSD 3-Clause License": "bsd-3-clause", "BSD 3-Clause Clear License": "bsd-3-clause-clear", "Licensed under the Mozilla Public License 2.0": "mpl-2.0",
        "CC0 1.0 Universal": "cc0-1.0", "Apache License 2.0": "apache-2.0", "licensed under the GNU Affero General Public License version 3": "agpl-3.0",
        "licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1", "licensed under the GNU General Public License, version 3": "gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl-2.0",
        "distributed under the GNU Lesser General Public License, version 3": "lgpl-3.0", "available under the ISC license": "isc", "This work is licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0",
    }.items():
        assert labels_of(f"Some words before. {text} and more after it") == {label}, text
    assert labels_of("licensed under the GNU Wonderful General Public License version 3") == set()
    assert labels_of("licensed under the terms of the mit of the license") == labels_of("the general license of the apache people 2 0") == set()


def test_skipped_words_lower_the_score():
    agpl = TEMPLATES["agpl-3.0"]
    (label, _, _, cover), = licences.Scanner().scan(licences.words_of(agpl))[1]
    assert label == "agpl-3.0" and cover == 1.0
    only = licences.Scanner({"gpl-3.0": TEMPLATES["gpl-3.0"]}).scan(licences.words_of(agpl))[1]
    assert only[0][0] == "gpl-3.0" and 0.9 < only[0][3] < 1.0
    assert licences.Scanner({"gpl-3.0#short": TEMPLATES["gpl-3.0#short"]}).scan(licences.words_of("licensed under the GNU Affero General Public License, version 3"))[1] == []
