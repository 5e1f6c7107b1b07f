"""Licence scan by sentence rules: known sentences become identifiers, ordered rules match their sequence."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.llm.common import LOWER, UPPER, ascii_lower

# Sentences of licence texts and notices in normalised form (lower case, words and numbers only), by identifier.
TEXTS = {
    "mit_title": ("the mit license", "mit license"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "apache_title": ("apache license version 2.0 january 2004",),
    "apache_use": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"),
    "gpl3_title": ("gnu general public license version 3 29 june 2007",),
    "gpl2_title": ("gnu general public license version 2 june 1991",),
    "lgpl3_title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21_title": ("gnu lesser general public license version 2.1 february 1999",),
    "agpl3_title": ("gnu affero general public license version 3 19 november 2007",),
    "gpl_warranty": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"),
    "gpl_received": tuple(f"you should have received a copy of the gnu {kind}general public license along with this {thing}" for kind in ("", "lesser ", "affero ") for thing in ("program", "library", "software", "file")),
    "mpl2_header": ("this source code form is subject to the terms of the mozilla public license v",),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    "mpl2_title": ("mozilla public license version 2.0",),
    "epl2_title": ("eclipse public license v 2.0",),
    "epl1_title": ("eclipse public license v 1.0",),
    "epl2_header": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",),
    "unlicense_release": ("this is free and unencumbered software released into the public domain",),
    "boost_title": ("boost software license version 1.0 17 august 2003",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "wtfpl_title": ("do what the fuck you want to public license",),
    "cc0_dedication": ("this work is dedicated to the public domain without any license condition",),
}
# Names under which a licence is granted ("licensed under the ..."), by SPDX identifier.
NAMES = {
    "MIT": ("mit license", "expat license", "mit licence"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache software license version 2.0", "apache license version 2.0 the license"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "3 clause bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "EPL-1.0": ("eclipse public license 1.0", "eclipse public license version 1.0", "eclipse public license v1.0"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license version 2.0", "eclipse public license v2.0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl v3", "gnu affero general public license v3.0", "agpl 3.0", "agplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lgpl v2.1", "gnu lesser general public license v2.1", "lgpl 2.1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl v3", "gnu lesser general public license v3.0", "lgpl 3.0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl v2", "gnu general public license v2.0", "gpl 2.0", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl v3", "gnu general public license v3.0", "gpl 3.0", "gplv3"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl",),
    "0BSD": ("0bsd", "bsd zero clause license"),
}
# How a grant by name is worded, and what is granted; "or later" forms of the GNU licences.
SUBJECTS = ("", "this project is ", "this software is ", "this work is ", "this program is ")
GRANTS = ("licensed under", "released under", "distributed under", "licensed under the terms of")
GNU = {"GPL": "general", "LGPL": "lesser general", "AGPL": "affero general"}
GNU_VERSIONS = (("GPL", "2", "GPL-2.0"), ("GPL", "3", "GPL-3.0"), ("LGPL", "2.1", "LGPL-2.1"), ("LGPL", "3", "LGPL-3.0"), ("AGPL", "3", "AGPL-3.0"))
THINGS = ("this program", "this library", "this software", "this file", "it")
# Rules of whole texts and notices in the order they are tried; longer ones come first and use up what they match.
TEXT_RULES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("0bsd_grant",)),
    ("Zlib", ("zlib_grant",)),
    ("Apache-2.0", ("named_Apache-2.0", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_title",)),
    ("LGPL-3.0", ("lgpl3_title",)),
    ("LGPL-2.1", ("lgpl21_title",)),
    ("AGPL-3.0", ("agpl3_title",)),
    ("GPL-3.0", ("gpl3_title",)),
    ("GPL-2.0", ("gpl2_title",)),
    ("MPL-2.0", ("mpl2_header", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_header",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-2.0", ("epl2_header",)),
    ("EPL-2.0", ("epl2_title",)),
    ("EPL-1.0", ("epl1_title",)),
    ("Unlicense", ("unlicense_release",)),
    ("BSL-1.0", ("boost_title",)),
    ("WTFPL", ("wtfpl_title",)),
    ("CC0-1.0", ("cc0_dedication",)),
)
#: A text without any of these words has none of the sentences, and is not split.
ANCHORS = ("licen", "software", "redistribut", "released under", "distributed under", "distributed with")
BUCKETS = 256  # of the hashed lookup tables


def _sentences() -> dict[str, tuple[str, ...]]:
    """Identifier -> normalised sentences: the fixed texts, and by rule grants by name, SPDX tags and GNU headers."""
    known = {k: list(v) for k, v in TEXTS.items()}
    for spdx, names in NAMES.items():
        known[f"named_{spdx}"] = [f"{s}{g} {the}{n}" for s in SUBJECTS for g in GRANTS for the in ("the ", "") for n in names]
        plain = spdx.lower().replace("-", " ")
        known[f"tag_{spdx}"] = [f"spdx license identifier {plain}"] + ([f"spdx license identifier {plain} only"] if "GPL" in spdx else [])
    for kind, version, spdx in GNU_VERSIONS:
        terms = f"you can redistribute it and or modify it under the terms of the gnu {GNU[kind]} public license"
        end = f"as published by the free software foundation either version {version} of the license or at your option any later version"
        known[f"later_{spdx}"] = [f"{t} is free software {terms} {end}" for t in THINGS] + [f"spdx license identifier {spdx.lower().replace('-', ' ')} or later"]
        known[f"only_{spdx}"] = [f"{t} is free software {terms} version {version} as published by the free software foundation" for t in THINGS]
    return {k: tuple(v) for k, v in known.items()}


def _rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    rules = list(TEXT_RULES)
    for _, _, spdx in GNU_VERSIONS:
        rules += [(f"{spdx}-or-later", (f"later_{spdx}", "gpl_warranty", "gpl_received")), (f"{spdx}-or-later", (f"later_{spdx}",)), (spdx, (f"only_{spdx}",))]
    return tuple(rules + [(spdx, (f"{kind}_{spdx}",)) for kind in ("named", "tag") for spdx in NAMES])


SENTENCES = _sentences()
RULES = _rules()
#: Steps that mark a text: `|` where a sentence ends; `~` at line ends, colons, semicolons, commas, dashes and brackets.
MARKS = (
    ("[.!?:;]*[.!?][.!?:;]*[ \\t-\\r]+", "|"), ("[:;,]+[ \\t-\\r]+|[\\n\\r]+| +[-–—]+ +|[()\\[\\]]+", "~"),
    ("[^a-z0-9.|~]+|[.]+([^a-z0-9|~]|$)", " "), (" +", " "), ("[ ~]*[|][ |~]*", "|"), (" ?~[ ~]*", "~"),
)
TOKEN = "[|~ ][^|~ ]+"


def _marked(low: Column) -> Column:
    """The normalised words of a text, each after a blank or after the mark that it follows."""
    text = F.concat(F.lit("|"), F.translate(low, "|~", "##"), F.lit(" |"))
    for pattern, mark in MARKS:
        # a run of stops is taken whole or not at all, from where it begins
        text = F.regexp_replace(text, pattern.replace("[.!?:;]*[.!?][.!?:;]*", "(?<![.!?:;])[:;]*+[.!?][.!?:;]*+"), mark)
    return text


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class _Lookup:
    """A map of any size as buckets by hash; a lookup reads one bucket."""

    def __init__(self, entries: Mapping[str, object], kind: str) -> None:
        self.entries, self.kind = entries, kind

    def column(self, spark) -> Column:
        keys = list(self.entries)
        places = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(BUCKETS))).collect()]
        buckets: list[dict] = [{} for _ in range(BUCKETS)]
        for k, b in zip(keys, places, strict=True):
            buckets[b][k] = self.entries[k]
        return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{self.kind}>>")

    @staticmethod
    def get(buckets: Column, key: Column) -> Column:
        return F.element_at(F.element_at(buckets, (F.pmod(F.xxhash64(key), F.lit(BUCKETS)) + 1).cast("int")), key)


def _lengths(ids: Mapping[str, str]) -> dict[str, list[int]]:
    """First two words of known sentences -> their numbers of words, longest first."""
    found = defaultdict(set)
    for sentence in ids:
        words = sentence.split()
        found[" ".join(words[:2])].add(len(words))
    return {k: sorted(v, reverse=True) for k, v in found.items()}


def _known(low: Column, ids: Column, lengths: Column) -> Column:
    """`<id>` of every known sentence, in order, in one string.

    A sentence begins and ends at a mark of any kind; inside it, marks other than sentence ends are blanks. Where a
    part between marks begins, its first two words give the lengths of the sentences that begin with them, and the words up
    to each length, joined, are looked up; the longest known is taken, and the search goes on behind it.
    """
    def sentence(tokens: Column, i: Column, n: Column) -> Column:
        return F.translate(F.substring(F.array_join(F.slice(tokens, i, n), ""), F.lit(2), F.lit(1 << 30)), "~", " ")

    def scanned(tokens: Column) -> Column:
        size = F.size(tokens)
        opens = lambda i: F.substring(F.try_element_at(tokens, i), 1, 1) != F.lit(" ")
        starts = F.when(size > 1, F.filter(F.sequence(F.lit(1), size), opens)).otherwise(F.array().cast("array<int>"))

        def longest(i: Column) -> Column:
            first = F.concat(F.substring(F.element_at(tokens, i), F.lit(2), F.lit(1 << 30)), F.lit(" "), F.substring(F.coalesce(F.try_element_at(tokens, i + 1), F.lit("")), F.lit(2), F.lit(1 << 30)))

            def ends(n: Column) -> Column:
                closed = (i + n > size) | F.coalesce(opens(i + n), F.lit(True))
                return (i + n - 1 <= size) & closed & _Lookup.get(ids, sentence(tokens, i, n)).isNotNull()

            n = F.try_element_at(F.filter(_bound(first, lambda k: _Lookup.get(lengths, k)), ends), F.lit(1))
            return _bound(n, lambda m: F.when(m.isNotNull(), F.struct(i.alias("i"), m.alias("n"), _Lookup.get(ids, sentence(tokens, i, m)).alias("id"))))

        hits = F.filter(F.transform(starts, longest), lambda h: h.isNotNull())
        merged = F.aggregate(
            hits, F.struct(F.lit(0).alias("next"), F.lit("").alias("ids")),
            lambda done, h: F.when(h["i"] >= done["next"], F.struct((h["i"] + h["n"]).alias("next"), F.concat(done["ids"], F.lit("<"), h["id"], F.lit(">")).alias("ids"))).otherwise(done),
        )
        return merged["ids"]

    return _bound(F.regexp_extract_all(_marked(low), F.lit(TOKEN), F.lit(0)), scanned)


def _matched(sequence: Column, rules: Sequence[tuple[str, tuple[str, ...]]]) -> Column:
    """Names of the rules whose identifiers follow each other in `sequence`; what a rule matched is used up."""
    names, rest = [], sequence
    for name, ids in rules:
        wanted = "".join(f"<{i}>" for i in ids)
        names.append((name, wanted))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("ids")) for n, w in names])
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("names"))
    done = F.aggregate(
        table, start,
        lambda s, r: F.when(F.contains(s["rest"], r["ids"]), F.struct(F.replace(s["rest"], r["ids"], F.lit("|")).alias("rest"), F.array_append(s["names"], r["name"]).alias("names"))).otherwise(s),
    )
    return F.when(sequence != "", done["names"]).otherwise(F.array().cast("array<string>"))


def scan_licenses(
    docs: DataFrame, text: str = "text", sentences: Mapping[str, Sequence[str]] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES, anchors: Sequence[str] = ANCHORS,
) -> DataFrame:
    """Adds sentence_ids, n_sentences and licenses to each row.

    A known sentence, of two words at least, may begin and end at sentence ends, line ends, colons, semicolons, commas,
    dashes and brackets, and may run over all of them but sentence ends. Normalised sentences that are known become
    identifiers; everything else is passed over. sentence_ids holds the identifiers by position, licenses the names of the
    rules that match them, in rule order, each once, joined by commas. The cost of a lookup does not grow with the table.
    Null, empty and foreign texts have empty strings and 0. An empty table gives no rows, repeated rows are scanned each,
    a text of any length is scanned whole. Other columns stay; columns of the three names are replaced.
    """
    ids = {s: k for k, group in sentences.items() for s in group}
    low = ascii_lower(docs[text])
    source = F.when(low.rlike("|".join(anchors)), low)
    names = ("sentence_ids", "n_sentences", "licenses")
    spark = docs.sparkSession
    found = _known(source, _Lookup(ids, "string").column(spark), _Lookup(_lengths(ids), "array<int>").column(spark))
    best = docs.select(*[docs[c] for c in docs.columns if c not in names], F.coalesce(found, F.lit("")).alias("sentence_ids"))
    return best.select(
        "*", F.regexp_count("sentence_ids", F.lit("<")).cast("long").alias("n_sentences"),
        F.array_join(F.array_distinct(_matched(F.col("sentence_ids"), rules)), ",").alias("licenses"),
    )


def _sql() -> str:
    """The same method over `documents` in SQL: sentences are looked up one by one in a table."""
    rows = ", ".join(f"('{s}', '{k}')" for k, group in SENTENCES.items() for s in group)
    marked = "'|' || translate(low, '|~', '##') || ' |'"
    for pattern, mark in MARKS:
        marked = f"regexp_replace({marked}, '{pattern}', '{mark}', 'g')"
    steps = ", ".join(f"('{n}', '{''.join(f'<{i}>' for i in ids)}', {k})" for k, (n, ids) in enumerate(RULES))
    return f"""
WITH known AS MATERIALIZED (SELECT s, id, len(string_split(s, ' ')) AS n, string_split(s, ' ')[1] || ' ' || string_split(s, ' ')[2] AS first FROM (VALUES {rows}) t(s, id)),
rules AS MATERIALIZED (SELECT list({{'rest': ids, 'names': [name]}} ORDER BY k) AS all_rules FROM (VALUES {steps}) t(name, ids, k)),
low AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents),
tokens AS MATERIALIZED (SELECT rid, regexp_extract_all({marked}, '{TOKEN}') AS t FROM low WHERE regexp_matches(low, '{"|".join(ANCHORS)}')),
starts AS (SELECT rid, t, unnest(range(1, len(t))) AS i FROM tokens),
firsts AS (SELECT * FROM (SELECT rid, t, i, t[i][2:] || ' ' || t[i + 1][2:] AS first FROM starts WHERE t[i][1] <> ' ') WHERE first IN (SELECT first FROM known)),
hits AS (
  SELECT rid, i, n, id FROM firsts JOIN known USING (first)
  WHERE i + n - 1 <= len(t) AND (i + n > len(t) OR t[i + n][1] <> ' ') AND translate(array_to_string(list_slice(t, i, i + n - 1), '')[2:], '~', ' ') = s
  QUALIFY row_number() OVER (PARTITION BY rid, i ORDER BY n DESC) = 1),
listed AS (SELECT rid, list({{'i': i, 'n': n, 'ids': '<' || id || '>'}} ORDER BY i) AS l FROM hits GROUP BY rid),
merged AS (
  SELECT rid, list_reduce(list_prepend({{'i': 0::BIGINT, 'n': 0::BIGINT, 'ids': ''}}, l),
    lambda a, h: CASE WHEN h.i >= a.i + a.n THEN {{'i': h.i, 'n': h.n, 'ids': a.ids || h.ids}} ELSE a END).ids AS sentence_ids FROM listed),
told AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids FROM low LEFT JOIN merged USING (rid)),
done AS (
  SELECT doc_id, sentence_ids, list_reduce(list_prepend({{'rest': sentence_ids, 'names': []::VARCHAR[]}}, all_rules),
    lambda a, r: CASE WHEN contains(a.rest, r.rest) THEN {{'rest': replace(a.rest, r.rest, '|'), 'names': a.names || r.names}} ELSE a END).names AS names
  FROM told, rules)
SELECT doc_id, sentence_ids, (length(sentence_ids) - length(replace(sentence_ids, '<', '')))::BIGINT AS n_sentences,
  array_to_string(list_transform(list_filter(list_zip(names, range(1, len(names) + 1)), lambda x: list_position(names, x[1]) = x[2]), lambda x: x[1]), ',') AS licenses
FROM done"""


SQL = _sql()
