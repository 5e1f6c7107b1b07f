"""Operators that judge rows by themselves: URLs, licences, quality, token counts."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from adgauge.llm import licenses, quality, tokens, urls
from adgauge.llm.queries import ORACLES, QUERIES, VOCABULARY
from tests.conftest import SMALL

CLASH = "doc_id long, text string, kept string, n_words string, sentence_ids string, n_tokens string, strict_hits string, host string"


def rows_of(cursor):
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    df = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) == rows_of(con.execute(ORACLES[name]))


def test_url_parts_rules_and_terms(spark):
    given = [
        (1, "HTTP://WWW.Example.COM/en/x?q=1"), (2, "http://example.com/en/1"), (3, "http://a.net/es/"), (4, "x://a.net/de/#/es/"),
        (5, None), (6, "no scheme"), (7, "http://com"), (8, "http://my-casino.org/"), (9, "http://mycasino.org/"),
        (10, "http://free-bets.org/"), (11, "http://free-free.org/"), (12, ""), (13, "a://b://c.com/"), (13, "a://b://c.com/"),
        (14, "http://notexample.com/en/"), (15, "http://x.org/" + "a" * 100_000 + "/free/WIN"), (None, "http://fr.net/fr/"),
        (16, "http://a.org/c%61sino?x"), (17, "http://a.org/%43%41SINO"), (18, "http://a.org/%2563asino"), (19, "http://a.org/fr%65e%2dw%69n%"), (20, "http://a.org/%C3%A9t%e9"),
    ]
    df = urls.judge_urls(spark.createDataFrame([(*r, "own") for r in given], "page_id long, url string, host string"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)

    def expected(page_id, url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
            host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", tail)[0]
        fits = [(len(r), r, v) for r, v in urls.RULES for site, rest in [r.split("/", 1)] if (host == site or host.endswith("." + site)) and path.startswith("/" + rest)]
        low = (url or "").lower()
        for code, char in urls.ENCODED.items():
            low = low.replace(code, char)
        hit = lambda terms: sum(bool(re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in terms)
        own = "block" if hit(urls.STRICT) or hit(urls.SOFT) >= 2 else "allow"
        return (page_id, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else own)

    assert got == sorted((expected(*r) for r in given), key=repr)
    assert {r[0]: r[4] for r in got if (r[0] or 0) > 15} == {16: "block", 17: "block", 18: "allow", 19: "block", 20: "allow"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_licence_rules(spark):
    def text(*ids):
        return " ".join(licenses.SENTENCES[i][0].capitalize() + "." for i in ids)

    bsd3, bsd2 = ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), ("bsd_grant", "bsd_source", "bsd_binary")
    given = {
        1: ("Prose.\nReleased under the MIT License.", "MIT"), 2: (text(*bsd3), "BSD-3-Clause"), 3: (text(*bsd2), "BSD-2-Clause"),
        4: (text("bsd_source", "bsd_grant", "bsd_binary"), ""), 5: (text(*bsd2).replace(" ", "\n"), "BSD-2-Clause"),
        6: ("LICENSED UNDER CC BY-NC 4.0! Licensed under the Apache License, Version 2.0.", "Apache-2.0,CC-BY-NC-4.0"),
        7: (None, ""), 8: ("", ""), 9: ("we license nothing " * 20_000, ""), 10: (text(*bsd3, *bsd3), "BSD-3-Clause"),
        11: (text("mit_grant", "mit_notice", "as_is"), "MIT"),
    }
    rows = [(k, v[0], *["own"] * 6) for k, v in given.items()] + [(1, given[1][0], *["own"] * 6)]
    df = licenses.scan_licenses(spark.createDataFrame(rows, CLASH))
    assert df.columns.count("sentence_ids") == 1 and "kept" in df.columns
    got = sorted((r.doc_id, r.licenses) for r in df.collect())
    assert got == sorted([(k, v[1]) for k, v in given.items()] + [(1, "MIT")])
    for group in licenses.SENTENCES.values():
        for sentence in group:
            assert any(a in sentence for a in licenses.ANCHORS)
            assert re.fullmatch("[a-z0-9.]+( [a-z0-9.]+)+", sentence) and ". " not in sentence + " "
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.SENTENCES) and sum(map(len, licenses.SENTENCES.values())) > 2000


MIT = """MIT License

Copyright (c) 2024 Jane Doe

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD_2 = """Copyright (c) 2024, Jane Doe
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
APACHE = """   Copyright 2024 Jane Doe

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """Copyright (C) 2024 Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_published_notices(spark):
    wanted = {
        "MIT": (MIT, "<mit_title><mit_grant><mit_notice><as_is>"), "BSD-2-Clause": (BSD_2, "<bsd_grant><bsd_source><bsd_binary>"),
        "BSD-3-Clause": (BSD_3, "<bsd_grant><bsd_source><bsd_binary><bsd_endorse>"), "Apache-2.0": (APACHE, "<named_Apache-2.0><apache_use><apache_copy>"),
        "GPL-3.0-or-later": (GPL, "<later_GPL-3.0><gpl_warranty><gpl_received>"),
    }
    rows, want = [], []
    for i, (name, (text, ids)) in enumerate(wanted.items()):
        forms = (text, text.replace("\n", "\r\n"), "".join(f"# {x}\n" for x in text.splitlines()), "".join(f" * | {x}\n" for x in text.splitlines()), "Prose.\n" + text)
        rows += [(10 * i + k, form) for k, form in enumerate(forms)]
        want += [(10 * i + k, ids, name) for k in range(len(forms))]
    rows += [(90, "Not released\nunder the MIT License"), (91, "The MIT. License\n"), (92, "licensed under\nthe MIT license"), (93, "license" + "." * 50_000 + ":" * 50_000 + "\n~ MIT License |\n")]
    want += [(90, "", ""), (91, "", ""), (92, "<named_MIT>", "MIT"), (93, "<mit_title>", "")]
    for i, (text, name) in enumerate(NOTICES):
        rows.append((200 + i, text))
        want.append((200 + i, None, name))
    rows += [(300, None), (301, ""), (301, ""), (302, "license"), (303, "Licensed under the MIT license, the Apache License 2.0 - see LICENSE")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.sentence_ids, r.n_sentences, r.licenses) for r in licenses.scan_licenses(frame).collect())
    found = {r[0]: (r[1], r[3]) for r in got}
    assert all(found[i] == (ids if ids is not None else found[i][0], name) for i, ids, name in want)
    assert all(n == ids.count("<") for _, ids, n, _ in got)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    twin = con.execute(f"SELECT doc_id, sentence_ids, n_sentences, licenses FROM ({licenses.SQL})").fetchall()
    assert sorted(twin) == got
    assert licenses.scan_licenses(frame.limit(0)).count() == 0


def gnu(kind, version, thing="program"):
    return f"""/* This {thing} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {kind} Public License as
 * published by the Free Software Foundation; either version {version} of
 * the License, or (at your option) any later version. */
"""


NOTICES = (
    (gnu("General", 2), "GPL-2.0-or-later"), (gnu("Lesser General", "2.1", "library"), "LGPL-2.1-or-later"), (gnu("Affero General", 3), "AGPL-3.0-or-later"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later"), ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("This project is licensed under the MIT License (see LICENSE).", "MIT"), ("Distributed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Eclipse Public License - v 2.0\n", "EPL-2.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", ""), ("we are licensed under the mit license of old", ""),
)


def brute_quality(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def longest(i):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        return best

    best = [longest(i) for i in range(n)]
    three = {j for i in range(n) if best[i] >= 3 for j in range(i, i + 3)}
    starts = [i for i in range(n) if best[i] >= least and (i == 0 or best[i - 1] != best[i] + 1)]
    covered = {j for i in starts for j in range(i, i + best[i])}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(three),
        len(starts), len(covered), max((best[i] for i in starts), default=0),
    )


def test_quality_equals_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a", "a b c a b c", "x\x85y\u00a0z \x0b#*<é", "a\n\na\n a\na"]
    for size in (5, 30, 120):
        for letters in ("ab", "abcdefgh"):
            texts += [" ".join(rng.choice(letters) for _ in range(size)).replace(" c", "\nc") for _ in range(6)]
    block = " ".join(f"w{i}" for i in range(30))
    texts += [f"{block} x {block} y {block}", block]
    for least in (2, 4):
        got = quality.measure(texts, least)
        assert [tuple(map(int, r)) for r in got.itertuples(index=False)] == [brute_quality(t, least) for t in texts]
    whole = quality.measure(texts, 4)
    for at in range(0, len(texts), 5):  # other texts beside it change nothing
        assert quality.measure(texts[at : at + 5], 4).to_numpy().tolist() == whole[at : at + 5].to_numpy().tolist()


def test_quality_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(300))
    some = " ".join(f"x{i}" for i in range(60))
    given = {1: (clean, True), 2: (f"{clean} {some} . {some}", True), 3: (f"{clean} {clean}", False), 4: ("few words", False), 5: (None, False), 6: ("", False),
             7: (" ".join(f"y{i}" for i in range(300)) + f" {some} z {some} q {some}", False), 8: (" ".join(f"l{i}" for i in range(30_000)), True)}
    long_repeat = " ".join(f"r{i}" for i in range(120))
    given[9] = (" ".join(f"u{i}" for i in range(2000)) + f" {long_repeat} z {long_repeat}", False)
    rows = [(k, v[0], *["own"] * 6) for k, v in given.items()] * 2
    df = quality.judge_quality(spark.createDataFrame(rows, CLASH))
    assert {(r.doc_id, r.kept) for r in df.collect()} == {(k, v[1]) for k, v in given.items()}
    assert df.count() == 2 * len(given)
    kept = quality.drop_poor(spark.createDataFrame(rows, CLASH))
    assert kept.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert {r.doc_id for r in kept.collect()} == {k for k, v in given.items() if v[1]} and {r.kept for r in kept.collect()} == {"own"}


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 200):
        s = rng.integers(0, 3, n)
        order, common = quality.suffix_array(s)
        assert [*order] == sorted(range(n), key=lambda i: [*s[i:]])
        for k in range(1, n):
            a, b = s[order[k - 1] :], s[order[k] :]
            m = min(len(a), len(b))
            assert common[k] == np.argmin(np.append(a[:m] == b[:m], False))


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    def counts(vocabulary, texts):
        model = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=True))
        model.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
        return [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    vocabulary = tokens.read_vocabulary(VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "  two  ", "▁mark ▁", "日本語 ☃ \U0001f600\U0001f600 é", "a" * 5000, "tab\there\nline"]
    df = tokens.count_tokens(spark.createDataFrame([(i, t, *["own"] * 6) for i, t in enumerate(texts)], CLASH), vocabulary)
    got = {r.doc_id: r.n_tokens for r in df.collect()}
    want = dict(enumerate(counts(vocabulary, texts)))
    assert got == want

    long = "word " * 30_000 + "x" * 100_000
    again = [(1, long, *["own"] * 6), (1, long, *["own"] * 6), (2, None, *["own"] * 6)]
    df = tokens.count_tokens(spark.createDataFrame(again, CLASH), vocabulary)
    assert sorted(r.n_tokens for r in df.collect()) == sorted(counts(vocabulary, [long, long, None]))
    assert df.limit(0).count() == 0 and tokens.count_tokens(spark.createDataFrame([], CLASH), vocabulary).count() == 0

    # many ties: equal scores, small alphabet; bytes are there for the fallback
    rng = random.Random(5)
    bytes_ = [(f"<0x{i:02X}>", -9.0) for i in range(256)]
    for _ in range(4):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(25)}
        small = [(p, -float(rng.randint(1, 3))) for p in sorted(pieces)] + bytes_
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(300)]
        counter = tokens.Counter(small)
        assert [counter.of("▁" + w)[0] for w in words] == counts(small, words)
