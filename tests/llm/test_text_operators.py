"""BPE, chat formatting, decontamination, top-k, licences, HTML: against plain versions of each."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat, decontam, htmlmain, licenses, textvec, topk

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


TEXTS = ["Hello world, it's 12 o'clock!", "", None, "  \n\t two  spaces \n\n", "naïve café 東京 🙂🙂", "<|endoftext|> x", "a" * 700, "the" * 200, "ab" * 128, " nbsp em", "x", "ß", "Ununbelievable thandedbleness"]


def test_bpe_equals_the_library_and_decodes(spark, tokenizer):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert list(r.ids) == tokenizer.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
        assert bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "")
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_bpe_of_random_words(spark, tokenizer):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeinorst'é ") for _ in range(rng.randint(1, 20))) for _ in range(40)) for _ in range(30)]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert all(list(r.ids) == tokenizer.encode_ordinary(texts[r.doc_id]) for r in rows)


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\<|end|>", "<|turn|>a<|text|>b<|end|>", "<<SYS>>x<</SYS>>", "plain", "", "[INST", "<|", "a\\\\[INST]", "🙂 <s>"]


def test_chat_texts_read_back_and_no_control_string_survives(spark):
    rows = [(k, t, "assistant" if (k + t) % 2 else "user", NASTY[(3 * k + t) % len(NASTY)]) for k in range(len(NASTY)) for t in range(5)] + [(None, 1, None, None), (77, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.conversations(df)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    for r in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t")).collect():
        assert [(x.role, x.text) for x in r.t] == want[r.conv_id]
        inside = r.formatted.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", inside)
    for r in chat.summaries(made).collect():
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    for r in chat.examples(made).collect():
        whole = next(x.formatted for x in made.collect() if x.conv_id == r.conv_id)
        assert whole.startswith(r.prompt + r.reply + r.closing)
    assert chat.summaries(chat.conversations(df.limit(0))).count() == 0


def _words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(["aa", "b", "Cé", "d4", "É"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 5, 10, 14]))) for i in range(12)] + [(50, None), (51, "!?")]
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, ""), (3, "aa")]
    docs += [(102, "zz, " + items[5][1] + "; yy"), (102, "zz, " + items[5][1] + "; yy")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        w, hit, found = _words(t), set(), set()
        for k, it in items:
            v = _words(it)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        want.append((i, len(w), len(hit), sorted(found)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()} == {0}


def test_more_windows_than_one_broadcast_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} x y z") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} x") for i in range(0, 20, 2)], "item_id long, text string")
    monkeypatch.setattr(decontam, "SLICE", 3)
    assert {r.doc_id: r.n_hit for r in decontam.contaminated(docs, items).collect()} == {i: 0 if i % 2 else 2 for i in range(20)}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 8) / 8]) for i in range(120)]
    rows += [(7, rows[7][1]), (200, None), (250, [0.5, None]), (300, [float("nan")] * 8), (350, [float("inf")] * 8), (None, rows[3][1]), (400, []), (450, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and i not in (250, 300, 350, 450)}
    want = []
    for q in (i for i in fine if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_licence_rules(spark):
    texts = [
        "x\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the MIT License. All rights reserved.", "Licensed under the Apache License, Version 2.0.", None, "", "licensed under the apache license", "All rights reserved." + " filler. word" * 30,
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licenses", F.lit(1))).collect()
    got = {r.doc_id: (r.licenses, r.n_matches, r.permissive) for r in rows}
    assert got == {0: (["Apache-2.0"], 1, True), 1: (["MIT", "Proprietary"], 2, False), 2: (["Apache-2.0"], 1, True), 3: ([], 0, None), 4: ([], 0, None), 5: ([], 0, None), 6: (["Proprietary"], 1, False)}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """MIT License

Copyright (c) 2020 A. Person

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
GPL3 = """Foobar is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
CC_SA = """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License."""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""


@pytest.mark.parametrize("wrap", ["as it is", "comment", "star comment", "one line", "narrow", "crlf", "amid text"])
def test_licences_in_their_own_words(spark, wrap):
    texts = {
        "Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "GPL-2.0-only": GPL2_ONLY, "BSD-2-Clause": BSD2,
        "BSD-3-Clause": BSD3, "MPL-2.0": MPL, "CC-BY-SA-4.0": CC_SA, "CC0-1.0": CC0, "": LGPL,
    }
    change = {
        "as it is": lambda t: t, "comment": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        "star comment": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;", "one line": lambda t: " ".join(t.split()) if t != MIT else re.sub(r"(?<!\n)\n(?!\n)", " ", t),
        "narrow": lambda t: "\n\n".join(re.sub(r"(\S+\s+\S+\s+\S+)\s+", r"\1\n", p) for p in t.split("\n\n")), "crlf": lambda t: t.replace("\n", "\r\n"),
        "amid text": lambda t: f"import this\n\n{t}\n\nFurther text stands here\nin two lines",
    }[wrap]
    df = spark.createDataFrame([(name, change(t)) for name, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: (r.licenses, r.n_matches) for r in licenses.scan(df).collect()}
    assert got == {name: ([name] if name else [], int(bool(name))) for name in texts}


def test_licence_tags_and_what_is_no_notice(spark):
    tags = {
        "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0+": "GPL-2.0-or-later",
        "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0", "Unknown": "",
    }
    rows = [(want, f"#!/bin/sh\n# SPDX-License-Identifier: {tag}\n\necho x") for tag, want in tags.items()]
    rows += [("", "this is not\nreleased under the MIT license we know"), ("", "You may not use this file except in compliance with the License.")]
    assert [(r.doc_id, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()] == [(w, [w] if w else []) for w, _ in rows]


def test_words_by_array_operations():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB é\t\n.") for _ in range(rng.randint(0, 50))) for _ in range(200)] + ["", None, "x" * 3000]
    body, offsets = textvec.raw(pa.array(texts, pa.string()))
    _, _, keys, counts = textvec.words(body, offsets)
    plain = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").replace("B", "b")) if w] for t in texts]
    assert counts.tolist() == [len(w) for w in plain]
    named = {}
    for k, w in zip(keys.tolist(), (w for ws in plain for w in ws), strict=True):
        assert named.setdefault(w, k) == k
    assert len(set(named.values())) == len(named)


def test_main_text_of_unseen_pages(spark):
    rng = np.random.default_rng(77)
    pages = [htmlmain.made_up(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(pages)] + [(90, None, None), (91, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in htmlmain.extract(df).collect()}
    kept = sum(len(set(got[i].split("\n\n")) & set(m)) for i, (_, m) in enumerate(pages))
    extra = sum(len(set(got[i].split("\n\n")) - set(m) - {""}) for i, (_, m) in enumerate(pages))
    total = sum(len(set(m)) for _, m in pages)
    assert kept >= 0.98 * total and extra <= 0.04 * total
    assert got[90] == got[91] == ""
    shown = spark.createDataFrame([(1, "u", "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three four five six.<br><p>Second paragraph is here.</p></article><footer>&copy; us</footer>")], "page_id long, url string, html string")
    assert htmlmain.extract(shown).first().text == "A & B\n\nOne two three four five six.\n\nSecond paragraph is here."
