import re

from findings_lake.llm.license_rules import CONFIDENCE, rules
from findings_lake.llm.licenses import BASE, BASE_SCORE, REACH, license_scan

from .conftest import CLASHES, ODD_TEXTS

LINES = [
    "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. All rights reserved.", "SPDX-License-Identifier: Apache-2.0",
    "http://www.apache.org/licenses/LICENSE-2.0", "all rights all rights reserved reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "public domain", "the mit lab",
    "general public license general public license", "Copyright (c) 2019-2020 Some Body Inc. All rights reserved.",
    "licensed under the Frobnicate License", "distributed under the terms of the Boost Software License, Version 1.0", "ccby cc_by cc.by",
    "x " * 300 + "cc by " + "y " * 300 + "Apache License 2.0", "éll rights reserved all rights reservedé",
]


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {}
    for phrase, label in BASE.items():
        own = phrase.split()
        places[label] = [i for i in range(len(words)) if words[i:i + len(own)] == own]
    at = sorted(i for p in places.values() for i in p)
    base = {label for label, p in places.items() if p}
    found = []
    for i, w in enumerate(words):
        window = " ".join(words[i:i + REACH]) + " "
        for r in rules():
            if r.keyword == w and f" {r.must} " in f" {window}":
                m = re.match(r.regex, window)
                if m:
                    found.append((i, i + m[0].count(" "), r))
    kept = [(a, b, r) for a, b, r in found
            if not any(a2 <= a and b <= b2 and r2.priority <= r.priority and ((a2, b2) != (a, b) or (r2.priority, r2.rule) < (r.priority, r.rule))
                       for a2, b2, r2 in found)]
    score = max([CONFIDENCE[r.priority] for _, _, r in kept] + [BASE_SCORE] * bool(base) + [0.0])
    labels = sorted(base | {r.label for _, _, r in kept})
    return (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(labels), score)


def test_scan_equals_plain_python(documents):
    texts = ODD_TEXTS + LINES + [" ".join(LINES), "\n".join(LINES[::-1])] + [LINES[0]] * 2
    rows = license_scan(documents(texts, extra=CLASHES)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_rules_are_an_ordered_table():
    table = rules()
    assert len(table) > 200 and [r.rule for r in table] == list(range(len(table)))
    assert [r.priority for r in table] == sorted(r.priority for r in table)
    for r in table:
        re.compile(r.regex)
        assert r.regex.startswith(f"^(?:{r.keyword}")


def test_main_path_is_native(documents):
    plan = license_scan(documents(LINES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(documents):
    assert license_scan(documents(["a"]).limit(0)).collect() == []
