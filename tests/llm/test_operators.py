"""The operators against plain versions, on a corpus with nulls, empty, long and repeated texts and clashing columns."""

import base64
import hashlib
import io
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearweave.plans.tables import Tables
from nearweave.llm import bpe, common, components, licenses, lines, media, minhash, packing, quality, queries, substring, tokencounts, topk

from . import brute

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return brute.documents(spark, [])


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXT = dict(brute.corpus())
NAMED = [i for i in TEXT]


def by_id(df):
    """Rows by doc_id; the repeated row must give equal rows."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r or r.doc_id == 3
        out[r.doc_id] = r
    return out


def test_licences(docs, empty):
    got = by_id(licenses.scan_licences(docs))
    assert len(got) == len(TEXT) + 1
    found = {i: r.licences for i, r in got.items() if r.licences}
    mit, gpl = len(TEXT) - 2, len(TEXT) - 1
    assert found == {mit: "MIT,Proprietary", gpl: "GPL-3.0-only"}
    assert got[mit].sentence_ids == "MitName AllRights" and got[mit].n_known == 2
    assert licenses.scan_licences(empty).count() == 0


def test_licence_rules_in_order(spark):
    s = licenses.SENTENCES
    text = ". ".join(s[x][0] for x in ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")) + ".\nwords\n" + s["BsdGrant"][0] + ". Unknown words here. " + s["BsdSource"][0] + ". " + s["BsdBinary"][0]
    row = licenses.scan_licences(brute.documents(spark, [(1, text), (2, s["BsdSource"][0])])).orderBy("doc_id").collect()
    assert [r.licences for r in row] == ["BSD-3-Clause,BSD-2-Clause", ""]
    assert row[1].n_known == 1


MIT = """MIT License
Copyright (c) 2020 Somebody
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution."""
BSD3 = """
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""


def test_wrapped_licences(spark):
    texts = [MIT, BSD, BSD + BSD3, APACHE, GPL, MIT.replace("\n", "\r\n"), MIT.replace("free of", "free  of, for")]
    rows = licenses.scan_licences(brute.documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-or-later", "MIT", ""]
    assert rows[0].sentence_ids == "MitGrant MitNotice MitAsIs" and rows[3].sentence_ids == "Apache2Name Apache2Use Apache2Copy Apache2AsIs"


HEADERS = {
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """         Copyright Somebody 2020.
Distributed under the Boost Software License, Version 1.0.
   (See accompanying file LICENSE_1_0.txt)""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL,
    "MIT": MIT,
}


def test_licence_headers_in_comments(spark):
    marks = [lambda x: x, lambda x: "# " + x.replace("\n", "\n# "), lambda x: "// " + x.replace("\n", "\n// ") + "\nint main();", lambda x: "/*\n * " + x.replace("\n", "\n * ") + "\n */\nint x;", lambda x: x.replace("\n", "\r\n")]
    cases = [(name, mark(text)) for name, text in HEADERS.items() for mark in marks]
    rows = licenses.scan_licences(brute.documents(spark, [(i, text) for i, (_, text) in enumerate(cases)])).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [name for name, _ in cases]


def test_licence_cue_with_other_blanks(spark):
    rows = licenses.scan_licences(brute.documents(spark, [(1, "This program is free  software."), (2, "This program is free\tsoftware.")])).collect()
    assert [(r.n_known, r.sentence_ids) for r in rows] == [(1, "GplFree")] * 2


def test_substring_dedup(docs, empty, spark):
    got = by_id(substring.removal_digests(docs))
    want = brute.repeats(TEXT.items())
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items() if i is not None} == want
    assert got[None].n_words == 4 and sum(x[1] for x in want.values()) > 1000
    assert substring.removal_digests(empty).count() == 0


def test_substring_dedup_with_frequent_anchors(docs, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT", 2)
    got = by_id(substring.removal_digests(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items() if i is not None} == brute.repeats(TEXT.items())


def test_substring_rewrite_keeps_columns(docs):
    out = substring.rewrite(docs)
    assert out.columns == docs.columns
    got = by_id(out)
    want = brute.repeats(TEXT.items())
    for i, t in TEXT.items():
        assert got[i].row == "row" and got[i].lang == "en"
        assert got[i].text == t if not want[i][1] else hashlib.sha256(got[i].text.encode()).hexdigest() == want[i][2]


def test_automaton_matches_substrings():
    r = np.random.default_rng(2)
    automaton, seen = substring.Automaton(), []
    for _ in range(30):
        s = r.integers(0, 3, r.integers(1, 25)).tolist()
        got = automaton.put(s)
        for i in range(len(s)):
            best = 0
            for n in range(1, i + 2):
                gram = s[i + 1 - n : i + 1]
                hay = seen + [s[:i]]
                if any(h[j : j + n] == gram for h in hay for j in range(len(h) - n + 1)):
                    best = n
            assert got[i] == best
        seen.append(s)


def test_topk(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 40) / 8]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 40), (302, [None] * 40), (303, [float("inf")] + [0.0] * 39), (304, [1.0, 2.0]), (350, [0.5, 1.0]), (400, [0.25] * 40), (None, [1.0] * 40)]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.exact_topk(table, table.filter("vec_id % 50 = 0")).collect())
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert got == want
    assert topk.exact_topk(table.limit(0), table.limit(0)).count() == 0


def test_topk_in_query_blocks_and_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    r = np.random.default_rng(6)
    rows = [(i % 230, [float(x) for x in r.integers(-3, 4, 40) / 8]) for i in range(250)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.exact_topk(table, table.filter("vec_id % 10 = 0")).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        own = min(v for i, v in rows if i == q)
        own = [int(np.floor(256 * x)) for x in own]
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert got == want


def test_topk_bounds_leave_candidates_out_after_one_block_of_dimensions():
    r = np.random.default_rng(7)
    rows = np.floor(r.normal(0, 1, (2000, 32)) * 256 * np.linspace(4, 0.2, 32))
    best = topk._Best(20, 5)
    topk._search(best, rows[:20], np.arange(20), rows, np.arange(2000))
    assert best.left_out[16] > 20 * 1000
    scores = rows[:20] @ rows.T
    for q in range(20):
        scores[q, q] = -np.inf
        assert best.score[q].tolist() == sorted(scores[q], reverse=True)[:5]


def test_topk_with_large_components(spark):
    rows = [(i, [float(3e14 + i), float(-1e14 * (i % 3))]) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.query_id, x.vec_id) for x in topk.exact_topk(table, table.filter("vec_id = 0"), k=3, scale=1).orderBy("rank").collect()]
    scores = sorted((-(int(rows[0][1][0]) * int(v[0]) + int(rows[0][1][1]) * int(v[1])), i) for i, v in rows[1:])
    clipped = sorted((-min(2**63 - 1, -s), i) for s, i in scores)
    assert len(got) == 3 and {i for _, i in got} <= {i for s, i in clipped if s <= clipped[2][0]}


def test_bpe(docs, empty, tik):
    got = by_id(bpe.round_trip(docs, RANKS))
    for i, t in TEXT.items():
        ids = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_bpe_tables_and_offsets(docs, tik):
    encoded = bpe.encode(docs, RANKS)
    texts = {r.doc_id: bytes(r.text) for r in bpe.decode(encoded, RANKS).collect()}
    assert all(texts[i] == (t or "").encode() for i, t in TEXT.items())
    import regex

    for r in encoded.collect():
        if r.doc_id is not None:
            t = TEXT[r.doc_id] or ""
            starts = [len(t[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, t)]
            assert np.frombuffer(r.piece_offsets, "<u4").tolist() == starts


def test_bpe_random_texts(tik):
    import random

    r, c = random.Random(4), bpe.codec(RANKS)
    texts = ["".join(r.choice(" '\n\t\r  sstrevdmlLL'aZé1²!.$ß\x1c\xa0 ́\U0001f600\0") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    ids, bounds, _, _ = c.encode(texts)
    assert all(ids[a:b].tolist() == tik.encode_ordinary(t) for a, b, t in zip(bounds[:-1], bounds[1:], texts))


def test_quality(spark, docs, empty):
    r = np.random.default_rng(1)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "into", "a", "valley", "of", "green", "trees."], 80))
    bad = lambda: " ".join(["BUY!! NOW!!", "x | y | z", "$$$ ***"][r.integers(3)] for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    table = brute.documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify(table, labels))
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for i, x in got.items())
    held = [x for x in got.values() if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in held) / len(held) > 0.97
    odd = by_id(quality.classify(docs, labels))
    assert len(odd) == len(TEXT) + 1 and all(0 <= x.score <= 1 for x in odd.values())
    assert {x.score for x in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    kept = quality.accepted(table, labels)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}


def test_quality_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{at}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 80 and sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_scores_match_a_plain_forward_pass():
    r = np.random.default_rng(3)
    first = np.array([0, 3, 4, 9])
    numbers = r.normal(0, 1, (9, quality.WIDTH)).astype(np.float32)
    model = quality.fit(numbers, first, np.array([1.0, 0.0, 1.0]), epochs=5)
    w, sig = model.w, lambda x: 1 / (1 + np.exp(-x))
    for i, got in enumerate(model.score(numbers, first)):
        hs = [np.tanh((x - model.mean) / model.scale @ w["E"] + w["e"]) for x in numbers[first[i] : first[i + 1]]]
        logits = np.array([(np.tanh(h @ w["V"]) * sig(h @ w["U"])) @ w["a"] for h in hs])
        share = np.exp(logits) / np.exp(logits).sum()
        assert abs(got - sig(sum(s * h for s, h in zip(share, hs)) @ w["o"] + w["b"][0])) < 1e-4


def test_quality_never_learns_from_held_out_labels(spark):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(200)]
    table = brute.documents(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2, 1) for i in range(200)], "doc_id long, quality int, toxic int")
    score = lambda labels: {x.doc_id: x.score for x in quality.classify(table, labels).collect()}
    assert score(one) == score(two)


def test_line_dedup(docs, empty):
    out = lines.rewrite(docs)
    assert out.columns == docs.columns
    got, want = by_id(out), brute.line_removals(TEXT.items())
    for i, t in TEXT.items():
        assert got[i].text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]))
    assert sum(map(len, want.values())) > 15
    assert lines.removal_digests(empty).count() == 0


def test_line_dedup_in_salted_parts_and_large_groups(docs, monkeypatch):
    monkeypatch.setattr(lines, "FREQUENT", 40)
    monkeypatch.setattr(lines, "GROUP", 3)
    got, want = by_id(lines.removal_digests(docs)), brute.line_removals(TEXT.items())
    assert {i: got[i].n_removed for i in TEXT} == {i: len(x) for i, x in want.items()}


def test_line_dedup_where_filters_tell_too_few_ids_apart(docs, monkeypatch):
    monkeypatch.setattr(lines, "FILTERED", 3)
    monkeypatch.setattr(common, "FILTER", 2)
    got, want = by_id(lines.removal_digests(docs)), brute.line_removals(TEXT.items())
    assert {i: got[i].n_removed for i in TEXT} == {i: len(x) for i, x in want.items()}


def test_line_dedup_deals_words_in_turns(docs, monkeypatch):
    """Every dealt row is in one turn, no turn has most of them, and the result is that of one turn."""
    monkeypatch.setattr(lines, "MANY", 0)
    monkeypatch.setattr(lines, "GROUP", 3)
    met, sizes = lines._met, []

    def counted(rows, turn, turns):
        prefixes = rows.select(F.explode("prefix").alias("w"))
        sizes.append((prefixes.filter(F.pmod("w", F.lit(turns)) == turn).count(), prefixes.count()))
        return met(rows, turn, turns)

    monkeypatch.setattr(lines, "_met", counted)
    got, want = by_id(lines.removal_digests(docs)), brute.line_removals(TEXT.items())
    assert {i: got[i].n_removed for i in TEXT} == {i: len(x) for i, x in want.items()}
    assert len(sizes) == lines.TURNS and sum(n for n, _ in sizes) == sizes[0][1] and max(n for n, _ in sizes) < sizes[0][1] / 2


def test_line_dedup_of_many_similar_lines(spark, monkeypatch):
    """A template that thousands of lines share, in which few are near, and copies of one line."""
    r = random.Random(9)
    template = [f"t{i}" for i in range(12)]
    rows = []
    for i in range(400):
        words = template + [f"v{r.randrange(30)}" for _ in range(4)]
        rows.append((i, " ".join(words) + "\nthe same line in every document of this table"))
    monkeypatch.setattr(lines, "GROUP", 20)
    got, want = by_id(lines.removal_digests(brute.documents(spark, rows))), brute.line_removals(rows)
    assert {i: got[i].n_removed for i, _ in rows} == {i: len(x) for i, x in want.items()}


def test_line_dedup_deals_two_words_in_turns_and_never_writes_dealt_rows(spark, monkeypatch):
    """Where most words have large groups, no table holds more rows with bitmaps than there are lines, and a turn deals a fixed number a line."""
    r = random.Random(4)
    rows = [(i, " ".join(f"t{j}" if r.random() < 0.9 else f"v{r.randrange(9)}" for j in range(16))) for i in range(60)]
    for name, value in (("GROUP", 4), ("MANY", 10), ("TURNS", 1), ("PAIRED", 4)):
        monkeypatch.setattr(lines, name, value)
    settle, met, sizes, turns = lines.Tables.settle, lines._met_by_two, [], []

    def counted(self, df):
        out = settle(self, df)
        sizes.extend([out.count()] if "b0" in df.columns else [])
        return out

    def turn(marked, one, of):
        turns.append((one, of))
        return met(marked, one, of)

    monkeypatch.setattr(lines.Tables, "settle", counted)
    monkeypatch.setattr(lines, "_met_by_two", turn)
    got, want = by_id(lines.removal_digests(brute.documents(spark, rows))), brute.line_removals(rows)
    assert {i: got[i].n_removed for i, _ in rows} == {i: len(x) for i, x in want.items()}
    assert max(sizes) <= len(rows) and len(turns) > 1 and turns == [(i, len(turns)) for i in range(len(turns))]


def test_line_dedup_counts_the_words_of_whole_texts(docs):
    """Counts are those of the words of all lines, one by one; the empty string beside separators doesn't matter."""
    bucket = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - lines.BITS).alias("k")
    got = Counter(x.k for x in lines._counted(docs).collect())
    table = docs.sparkSession.createDataFrame([(w,) for x in docs.select("text").collect() for w in brute.words(x.text)], "w string")
    want = Counter(x.k for x in table.select(bucket("w")).collect())
    empty = docs.sparkSession.range(1).select(bucket(F.lit(""))).collect()[0].k
    assert {k: c for k, c in got.items() if k != empty} == {k: c for k, c in want.items() if k != empty}


def test_line_dedup_sorts_plain_numbers_and_meets_long_and_short_sets(spark):
    """Sets hold no nulls to Spark's knowledge, so they are sorted unboxed; bitmaps of both sizes tell no similar sets apart."""
    table = brute.documents(spark, [(1, "a few words of a line")])
    a = lines._sets(table).select("prefix").schema["prefix"].dataType
    assert not a.containsNull
    r, rows = random.Random(3), []
    for i in range(60):
        n = lines.LONG - 6 + i % 12
        base = [f"w{i // 6}x{j}" for j in range(n)]
        for _ in range(r.randrange(2 * n // 9 // 2 + 2)):
            base[r.randrange(n)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    got, want = by_id(lines.removal_digests(brute.documents(spark, rows))), brute.line_removals(rows)
    assert {i: got[i].n_removed for i, _ in rows} == {i: len(x) for i, x in want.items()}
    assert 10 < sum(map(len, want.values())) < 55


def test_token_counts_refuse_ids_that_do_not_fit(spark):
    table = brute.documents(spark, [(1, "a")])
    with pytest.raises(ValueError):
        tokencounts.token_counts(table, RANKS, 1 << 16)
    with pytest.raises(Exception, match="separator"):
        tokencounts.token_counts(table, RANKS, int(bpe.codec(RANKS).encode(["a"])[0][0]))


def test_token_counts(docs, empty, tik):
    got = by_id(tokencounts.token_counts(docs, RANKS, 50256, block=1000))
    assert {i: got[i].n_tokens for i in TEXT} == {i: len(tik.encode_ordinary(t or "")) for i, t in TEXT.items()}
    assert len(got) == len(TEXT) + 1 and tokencounts.token_counts(empty, RANKS, 50256).count() == 0


def plain_resize(image, height, width):
    """Every pixel repeated so often that target pixels hold whole ones; the mean, rounded half up."""
    h, w, c = image.shape
    fine = np.repeat(np.repeat(image.astype(np.int64), height, 0), width, 1).reshape(height, h, width, w, c)
    return (2 * fine.sum((1, 3)) + h * w) // (2 * h * w)


def plain_hash(image):
    grey = (image.astype(int) * [299, 587, 114]).sum(2) // 1000
    small = plain_resize(grey[:, :, None], 8, 9)[:, :, 0]
    bits = "".join("1" if a < b else "0" for row in small.tolist() for a, b in zip(row, row[1:]))
    return f"{int(bits, 2):016x}"


def test_media(docs, empty):
    got = by_id(media.text_media(docs))
    for i, t in TEXT.items():
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        rows = len(payload) // 192
        stored = b"P6\n64 %d\n255\n" % rows + payload
        if rows % 2:
            flipped = np.frombuffer(payload, np.uint8).reshape(rows, 64, 3)[::-1, :, ::-1].tobytes()
            stored = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(payload), 0, 0, 54, 40, 64, rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + flipped
        r = got[i]
        image = np.frombuffer(payload, np.uint8).reshape(rows, 64, 3)
        assert (np.load(io.BytesIO(r.tile)) == plain_resize(image, 8, 8)).all() and r.feature == plain_hash(image)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(data), len(payload), zlib.crc32(payload[-16:]), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
    assert got[0].feature == got[1].feature != got[4].feature
    assert media.text_media(empty).count() == 0


def test_images():
    r = np.random.default_rng(0)
    rgb = r.integers(0, 256, (13, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(rgb)) == rgb).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert media.decode(b"P2 # note\n3 1 255\n1 2 3")[:, :, 0].tolist() == [[1, 2, 3]]
    assert media.decode(b"P1\n3 1\n1 0 1")[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0")[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0, 0] == 258
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    small = media.area_resize(rgb, 4, 3)
    fine = np.kron(rgb.astype(float), np.ones((4, 3, 1))).reshape(4, 13, 3, 7, 3).mean((1, 3))
    assert (small == np.floor(fine + 0.5 + 1e-9)).all()
    assert np.load(__import__("io").BytesIO(media.npy_tile(rgb, 5))).shape == (5, 5, 3)


def test_tiles_of_bad_images(spark):
    good = media.encode_ppm(np.zeros((4, 4, 3), np.uint8))
    bad = [b"P6\n9 9\n255\nxx", None, b"", b"P6\n9999999999999 9999999999999\n255\nxx", b"P6\n0 0\n255\n", b"P5\n0 3\n255\n", b"P2\n1 1\n9\n10", b"P2\n1 1\n255\n" + b"9" * 30, b"P6\n" + b"9" * 5000, b"P7\n1 1\n1\n1"]
    bad += [media.encode_bmp(np.zeros((4, 4, 3), np.uint8))[:60], b"BM" + b"\0" * 60, b"BM" + struct.pack("<IHHIIiiHHI", 0, 0, 0, 54, 40, 2**31 - 1, -(2**31), 1, 24, 0) + b"\0" * 40]
    table = spark.createDataFrame([(0, good), *enumerate(bad, 1)], "doc_id long, image binary")
    got = {r.doc_id: (r.height, r.width, r.tile and len(r.tile), r.dhash) for r in media.tiles(table, side=2).collect()}
    assert got == {0: (4, 4, 140, "0" * 16)} | {i: (None,) * 4 for i in range(1, len(bad) + 1)}


def test_resizing_in_bands():
    image = np.random.default_rng(3).integers(0, 256, (37, 11, 3), dtype=np.uint8)
    for band in (1, 100, 1 << 20):
        assert (media.area_resize(image, 5, 7, band) == plain_resize(image, 5, 7)).all()
        assert (media.luma(image, band) == media.luma(image)).all()


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.concat_and_cut(docs, WORDS, window=256).collect()
    streams = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in TEXT.items()}
    place = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place.get(r.sequence_id, 0) and r.offset + r.length <= 256
        place[r.sequence_id] = r.offset + r.length
        if r.doc_id is not None:
            ids = streams[r.doc_id]
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sorted(place) == list(range(len(place))) and [n for _, n in sorted(place.items())][:-1] == [256] * (len(place) - 1)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[i] == len(s) * (2 if i == 3 else 1) for i, s in streams.items())
    assert packing.concat_and_cut(empty, WORDS).count() == 0


def test_word_encoder_on_odd_words():
    import random

    import pyarrow as pa

    from nearweave.llm.common import raw

    r, tokenizer = random.Random(4), Tokenizer.from_file(WORDS)
    texts = ["".join(r.choice(" '\n\t sstrevdmlL'aZé1²!.ßΣΟΣ\x1c\xa0 ́\U0001f600İ\0<|") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    ids, bounds = packing.encoder(WORDS).encode(*raw(pa.array(texts)), 1)
    assert all(ids[a : b - 1].tolist() == tokenizer.encode(t, add_special_tokens=False).ids for a, b, t in zip(bounds[:-1], bounds[1:], texts))


def test_minhash(docs, empty):
    got = by_id(minhash.near_duplicates(docs))
    want = brute.groups([(i, t) for i, t in TEXT.items()])
    assert {i: (got[i].n_shingles, got[i].component_id) for i in TEXT} == want
    assert all(got[i].kept == (got[i].component_id == i) for i in TEXT) and got[None].component_id is None
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 300)
    kept = minhash.one_of_each(docs)
    want = brute.groups(list(TEXT.items()), 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert kept.columns == docs.columns


def _stubs(spark):
    """Long texts that hold a passage, and short ones that are little else and never lead: linked, but unlike the long ones."""
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = prose(100)
    last = F.least(*(F.xxhash64("id", F.lit(s)) for s in range(minhash.LEADERS))).desc()
    ids = [x.id for x in spark.range(1000, 9000).orderBy(last).limit(4).collect()]
    return [(i, " ".join(passage + prose(200))) for i in range(40)], [(i, " ".join(passage + prose(6))) for i in ids]


def test_minhash_links_members_unlike_all_leaders(spark, monkeypatch):
    # The case in which the stubs share no bucket without long texts.
    monkeypatch.setattr(minhash, "_bands", lambda reps, bands, rows: reps.select(F.lit(1).cast("long").alias("key"), "id"))
    long, stubs = _stubs(spark)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(brute.documents(spark, long + stubs)).collect()}
    want = {i: c for i, (_, c) in brute.groups(stubs).items()}
    assert len(set(want.values())) == 1
    assert got == {i: i for i, _ in long} | want


def test_minhash_links_members_unlike_all_leaders_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 7)
    monkeypatch.setattr(minhash, "MANY", 30)
    test_minhash_links_members_unlike_all_leaders(spark, monkeypatch)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    with Tables(spark) as tables:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "u long, v long"), tables).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
        assert components.connected_components(spark.createDataFrame([], "u long, v long"), tables).count() == 0


def test_one_of_each_with_repeated_rows_and_missing_ids(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    rows = [(2, text), (2, text), (2, "another text"), (5, near), (None, text), (None, "only here twice"), (None, "Only here\ttwice"), (None, None), (7, None), (7, None)]
    table = brute.documents(spark, rows).withColumn("_dropped", F.lit(1))
    out = minhash.one_of_each(table)
    assert out.columns == table.columns
    got = sorted((str(r.doc_id), " ".join((r.text or "").lower().split())) for r in out.collect())
    assert got == sorted([("2", text), ("2", "another text"), ("None", "only here twice"), ("None", ""), ("7", "")])
    assert minhash.one_of_each(table.limit(0)).count() == 0


def test_a_doc_id_with_two_texts_links_by_each(spark):
    prose = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n))
    a, b = prose(1, 90), prose(2, 90)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(brute.documents(spark, [(1, a), (1, b), (2, a + " end"), (3, b + " end")])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_linked_matches_all_pairs():
    r = np.random.default_rng(8)
    for _ in range(20):
        sets = [np.unique(r.integers(0, 12, r.integers(1, 10))).astype(np.uint64) for _ in range(12)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        edges = minhash.linked(np.arange(12), np.concatenate(sets), bounds, (80, 100))

        def closure(pairs):
            group = list(range(12))
            for a, b in pairs * 12:
                group[a] = group[b] = min(group[a], group[b])
            for _ in range(12):
                for a, b in pairs:
                    group[a] = group[b] = min(group[a], group[b])
            return group

        true = [(a, b) for a in range(12) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
        assert closure(edges) == closure(true)


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert json.load(open(WORDS))["model"]["type"] == "BPE"
