"""Licence scan with a positional rare-token index.

A file looks up its highest-IDF licence words: the index has a posting (template, position) for the rarest word of each
template's mandatory key phrase, by document frequency over all files, so a file that holds the phrase always meets the
template and one without such words costs a table lookup a word, however many templates there are. Each posting met
fixes where the template would begin. At that relative position the key phrase is verified word for word, and the
template's other words are intersected with the file's; the share that agrees is the score. A finding needs MIN_SCORE.
The list of templates (one-line notices, file headers, passages of licence texts, SPDX lines) bounds what is found.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import docs_of
from lodespark.llm.textkernel import chunks, eased, words

MIN_SCORE = 0.75
#: licence, the notice's words, and the key phrase in them that can't be missing
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License", "the MIT License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License", "BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License", "BSD 2-Clause License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0", "Mozilla Public License, version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "CC BY 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0", "CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Apache License, Version 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("Zlib", "In no event will the authors be held liable for any damages arising from the use of this software", "the authors be held liable for any damages"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License, Version 1.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"),
    *[
        (name, f"you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation, either version {version} of the License", f"{gnu} as published by the Free Software Foundation, either version {version}")
        for name, gnu, version in [
            ("GPL-2.0", "GNU General Public License", "2"),
            ("GPL-3.0", "GNU General Public License", "3"),
            ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
            ("LGPL-3.0", "GNU Lesser General Public License", "3"),
            ("AGPL-3.0", "GNU Affero General Public License", "3"),
        ]
    ],
    *[
        (name, f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}")
        for name in "MIT ISC Zlib Unlicense Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 MPL-2.0 EPL-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
    ],
]


def norm(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


class Index(NamedTuple):
    """Distinct licence words (hashes, sorted), and each template's words, as numbers, with its key phrase's span."""

    vocab: np.ndarray
    names: list[str]
    words: list[np.ndarray]
    key: list[tuple[int, int]]


def index(templates=None) -> Index:
    templates = templates or TEMPLATES
    texts = [norm(t) for _, t, _ in templates]
    hashes = [words(pa.array([" ".join(t)])).h for t in texts]
    vocab = np.unique(np.concatenate(hashes))
    spans = []
    for t, (_, _, phrase) in zip(texts, templates, strict=True):
        p = norm(phrase)
        at = next(i for i in range(len(t)) if t[i : i + len(p)] == p)
        spans.append((at, at + len(p)))
    return Index(vocab, [n for n, _, _ in templates], [np.searchsorted(vocab, h) for h in hashes], spans)


def _numbers(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """The number of each word, or -1; nearly all words fall to a table of their low bits."""
    table = np.zeros(1 << 16, bool)
    table[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(h), -1, np.int64)
    some = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab, h[some]), len(vocab) - 1)
    ok = vocab[at] == h[some]
    out[some[ok]] = at[ok]
    return out


def frequencies(docs: DataFrame, ix: Index) -> np.ndarray:
    """How many documents have each licence word, over all documents."""

    def run(batches):
        total = np.zeros(len(ix.vocab), np.int64)
        for b in eased(batches):
            for _, part in chunks(b.column("text")):
                w = words(part)
                num = _numbers(w.h, ix.vocab)
                at = np.flatnonzero(num >= 0)
                pair = np.unique(w.doc_of()[at] * len(ix.vocab) + num[at])
                total += np.bincount(pair % len(ix.vocab), minlength=len(ix.vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "df"])

    out = np.zeros(len(ix.vocab), np.int64)
    for r in docs.select("text").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[r["word"]] = r["df"]
    return out


def postings(ix: Index, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each licence word the templates it enters (offsets, template) and where it stands in them: each template is
    entered by the rarest word of its key phrase, the first of equally rare ones."""
    pos = np.array([min(range(lo, hi), key=lambda i: (df[tw[i]], i)) for tw, (lo, hi) in zip(ix.words, ix.key, strict=True)])
    word = np.array([tw[i] for tw, i in zip(ix.words, pos, strict=True)])
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(ix.vocab) + 1)), order, pos[order]


def _agreeing(num, low, high, start, lo, n, flat, at) -> np.ndarray:
    """How many of the words lo .. lo + n of each candidate's template (they begin at flat[at]) the file has in place."""
    who = np.repeat(np.arange(len(start)), n)
    i = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lo[who]
    p = start[who] + i
    ok = (p >= low[who]) & (p < high[who])
    same = ok & (num[np.where(ok, p, 0)] == flat[at[who] + i])
    return np.bincount(who[same], minlength=len(start))


def findings(part: pa.Array, ix: Index, df: np.ndarray, min_score: float, room: int = 1 << 18):
    """Row of part, template, first word, words that agree."""
    w = words(part)
    num = _numbers(w.h, ix.vocab)
    off, template, place = postings(ix, df)
    flat, size = np.concatenate(ix.words), np.array([len(x) for x in ix.words])
    begin, key = np.cumsum(size) - size, np.array(ix.key)
    hits = np.flatnonzero(num >= 0)
    hits = hits[off[num[hits] + 1] > off[num[hits]]]
    doc = w.doc_of()
    step = max(1, room // len(size))
    for k in range(0, len(hits), step):
        p = hits[k : k + step]
        n = (off[num[p] + 1] - off[num[p]]).astype(np.int64)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[num[p]], n)
        p = np.repeat(p, n)
        t, start = template[entry], p - place[entry]
        low, high = w.off[doc[p]], w.off[doc[p] + 1]
        lo, n = key[t, 0], key[t, 1] - key[t, 0]
        ok = _agreeing(num, low, high, start, lo, n, flat, begin[t]) == n
        t, start, low, high, p = t[ok], start[ok], low[ok], high[ok], p[ok]
        agree = _agreeing(num, low, high, start, np.zeros(len(t), np.int64), size[t], flat, begin[t])
        ok = agree >= min_score * size[t] - 1e-9
        yield doc[p[ok]], t[ok], start[ok] - low[ok], agree[ok]


def scan(docs: DataFrame, templates=None, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, licence, first_word (in normalised words; before the text, if it begins inside the notice),
    matched_words, score: every place of every document where a notice stands.

    Templates are judged one by one, so a place where several stand (a header holds the notice it begins with) has a
    row for each. Null and empty texts have none; rows without doc_id are left out; each of repeated rows is scanned;
    extra columns are ignored; an empty table gives no rows.
    """
    docs = docs_of(docs)
    ix = index(templates)
    df = frequencies(docs, ix)

    def run(batches):
        for b in eased(batches):
            ids, out = b.column("doc_id").to_numpy(zero_copy_only=False), []
            for first, part in chunks(b.column("text")):
                for row, t, start, agree in findings(part, ix, df, min_score):
                    if len(row):
                        out.append((ids[first + row], t, start, agree))
            if out:
                i, t, s, m = (np.concatenate(c) for c in zip(*out, strict=True))
                size = np.array([len(x) for x in ix.words])[t]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.array(ix.names, object)[t], pa.string()), pa.array(s), pa.array(m), pa.array(np.round(m / size, 6))], ["doc_id", "licence", "first_word", "matched_words", "score"])

    return docs.mapInArrow(run, "doc_id long, licence string, first_word long, matched_words long, score double")


def scan_sql(templates=None, min_score: float = MIN_SCORE) -> str:
    """DuckDB SQL for the rows of scan()."""
    rows = []
    for t, (name, text, phrase) in enumerate(templates or TEMPLATES):
        ws, p = norm(text), norm(phrase)
        at = next(i for i in range(len(ws)) if ws[i : i + len(p)] == p)
        rows += [f"({t}, '{name}', {i}, '{w}', {int(at <= i < at + len(p))}, {len(ws)}, {len(p)})" for i, w in enumerate(ws)]
    return rf"""
WITH t(t, licence, i, w, k, n, nk) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
e AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
m AS (SELECT r, doc_id, t, licence, p - i AS first_word, count(*) AS matched_words, sum(k) AS k, any_value(n) AS n, any_value(nk) AS nk FROM e JOIN t USING (w) GROUP BY ALL)
SELECT doc_id, licence, first_word, matched_words, round(matched_words / n, 6) AS score FROM m WHERE k = nk AND matched_words >= {min_score} * n - 1e-9
"""
