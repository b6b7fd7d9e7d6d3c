import re

from reposieve.llm import licenses, queries
from reposieve.llm.license_rules import rules
from tests.llm.helpers import awkward, docs, prose, with_extra

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text):
    """Base columns and surviving detections, each interval against each other."""
    w = words(text)
    padded = " " + "".join(x + " " for x in w)
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                starts.append(k)
                base.add(label)
    found = []
    for r in rules():
        if r.keyword in padded:
            for m in re.finditer(r.pattern, padded):
                first = padded[:m.start()].count(" ") - 1
                found.append((first, first + 1 + m[0].count(" "), r.priority, r.number, r.label))
    def inside(a, b):
        return b[0] <= a[0] and a[1] <= b[1]
    outer = [a for a in found if not any(
        inside(a, b) and (b[2] > a[2] or b[2] == a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[3] < a[3])) for b in found if b is not a)]
    kept = [a for a in outer if not any(inside(b, a) and b[2] > a[2] for b in outer)]
    labels = ",".join(sorted(base | {k[4] for k in kept}))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels)


def result(df):
    rows = licenses.scan(df, ["doc_id"]).collect()
    return sorted(((r.doc_id, *r[1:7]) for r in rows), key=repr)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT License. MIT License; mit-license MITlicense", "CC BY 4.0 and CC-BY-NC-SA 4.0, cc by", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. Copyright 2020 The Authors. All rights reserved.",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "see the license file " * 40, "gnu general public license " * 30,
    "licence", "permit license", "cc\nby", "ünter mit license é", "licensed under the well known mit license",
]


def test_against_brute_force(spark):
    df = docs(spark, TEXTS + [prose(1, 50) + " " + t + " " + prose(2, 30) for t in TEXTS])
    assert result(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)


def test_rules_are_many_and_gated():
    found = rules()
    assert len(found) > 200 and len({r.label for r in found}) > 60
    assert all(any(g in r.keyword for g in licenses.gates()) for r in found)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = {r[0]: r for r in result(with_extra(df))}
    assert rows[0][1:] == (0, 0, None, None, "", "") and len(result(df)) == df.count()
    assert result(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)
    assert result(docs(spark, [])) == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(docs(spark, TEXTS), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op4_licenses"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) == brute(r.text) and 0 <= g.score <= 1
