import random
import re

import numpy as np
import pyarrow as pa
import pytest
from lodespark.llm import decontaminate, licences
from lodespark.llm.decontaminate import suffix_array

DOCS = "doc_id long, text string"


def norm(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(rows, items, least=13):
    out = {}
    for d, t in rows:
        w = norm(t)
        for i, x in items:
            q = norm(x)
            need = min(least, len(q))
            if d is None or i is None or not q:
                continue
            for p in range(len(w)):
                for s in range(len(q)):
                    n = 0
                    while p + n < len(w) and s + n < len(q) and w[p + n] == q[s + n]:
                        n += 1
                    if n >= need and (n, -p, -s) > out.get((d, i), (0, 0, 0)):
                        out[d, i] = (n, -p, -s)
    return {(*k, n, -p, -s) for k, (n, p, s) in out.items()}


def case(rng):
    word = lambda: f"w{rng.randrange(30)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([5, 14, 40])))) for k in range(8)]
    rows = []
    for k in range(40):
        w = [word() for _ in range(rng.randrange(60))]
        if k % 2:
            q = norm(rng.choice(items)[1])
            w[3:3] = q[rng.randrange(4) :]
        rows.append((k, ", ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    return rows, items


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows, items = case(rng)
    rows += [(50, None), (51, ""), (None, items[1][1]), rows[1], (52, " ".join(x for _, x in items))]
    items += [(20, None), (21, ""), (None, rows[0][1]), items[1]]
    want = brute(rows, items)
    assert len(want) > 15
    for slice_bytes in (1 << 20, 300):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
        got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_decontaminate(spark):
    q = " ".join(f"q{k}" for k in range(15))
    docs = spark.createDataFrame([(1, "x " + q), (2, "clean"), (None, q), (3, None), (4, " ".join(q.split()[:12]))], DOCS).selectExpr("doc_id", "text", "1 AS item_id", "2 AS __gone")
    bench = spark.createDataFrame([(7, q)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 5


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_order(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 6)) if seed else 1 << 30
    a = rng.integers(0, top + 1, 300) if seed else rng.integers(0, 9, 300)
    sa, *_ = suffix_array(a, top, 300)
    want = sorted(range(300), key=lambda i: a[i:].tolist())
    assert sa.tolist() == want


def test_licences(spark):
    rows = [
        (1, "Hi. This work is licensed under the GNU General Public License, version 3."),
        (2, "this WORK is licensed under the gnu general public license version 3"),
        (3, "GNU General Public License, version 3"),  # less than MIN_SCORE of the notice
        (4, "Released under the MIT\nLicense. Released under the MIT License"),
        (5, "Licensed under CC BY-NC 4.0"),
        (6, "Licensed under the Apache License, Version 1.0"),
        (7, None),
        (8, ""),
        (None, "Released under the MIT License"),
        (9, "Released under the"),
        (10, "MIT License"),
    ]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS licence", "2 AS word")
    got = sorted((r.doc_id, r.licence, r.first_word, r.matched_words) for r in licences.scan(docs).collect())
    assert got == [(1, "GPL-3.0", 1, 12), (2, "GPL-3.0", 0, 12), (4, "MIT", 0, 5), (4, "MIT", 5, 5), (5, "CC-BY-NC-4.0", 0, 7)]
    assert licences.scan(docs.limit(0)).count() == 0
    assert licences.scan(spark.createDataFrame([rows[0], rows[0]], DOCS)).count() == 2


def test_long_text():
    t = " ".join(f"x{k % 977}" for k in range(300_000)) + " Released under the MIT License"
    ix = licences.index()
    found = [x for row, k, s, m in licences.findings(pa.array([t]), ix, np.ones(len(ix.vocab)), 0.75) for x in s]
    assert found == [300_000]


def brute_licences(rows, least=licences.MIN_SCORE):
    out = []
    for d, t in rows:
        w = norm(t)
        for name, notice, phrase in licences.TEMPLATES:
            q, k = norm(notice), norm(phrase)
            at = next(i for i in range(len(q)) if q[i : i + len(k)] == k)
            for s in range(-len(q), len(w)):
                same = [0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(q)]
                if d is not None and all(same[at : at + len(k)]) and sum(same) >= least * len(q):
                    out.append((d, name, s, sum(same)))
    return sorted(out)


def test_licences_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(120):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            q = norm(rng.choice(licences.TEMPLATES)[1])
            for _ in range(rng.randrange(len(q) // 8 + 1)):
                q[rng.randrange(len(q))] = rng.choice(["license", "the", "x"])
            w[(p := rng.randrange(len(w) + 1)) : p] = q[rng.randrange(3) :]
        rows.append((k, " ".join(w)))
    rows += [rows[1], (200, None), (201, ""), (None, rows[1][1])]
    got = sorted((r.doc_id, r.licence, r.first_word, r.matched_words) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_licences(rows) and len(got) > 25


def test_common_headers(spark):
    rows = [
        (1, "# SPDX-License-Identifier: GPL-3.0-or-later"),
        (2, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
        (3, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
        (4, "the Free Software Foundation and the terms of a license"),
    ]
    got = sorted((r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, "GPL-3.0"), (2, "MIT"), (3, "GPL-2.0")]


def test_decontaminate_judges_rows_not_ids(spark):
    q = " ".join(f"q{k}" for k in range(15))
    docs = spark.createDataFrame([(1, "x " + q), (1, "clean"), (1, "x " + q), (2, "one word")], DOCS)
    bench = spark.createDataFrame([(7, q), (8, "WORD")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, "clean")]
