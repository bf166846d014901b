"""Operator 10, licence scans by sentence rules (DataFrame operations only).

A text is cut into sentences, in two ways: at sentence ends and blank lines
(so that wrapped lines stay together), and at sentence ends and every line end
(so that a notice on a line of its own stands alone). Normalised sentences
that are known licence sentences become identifiers; those of both ways are
merged by their place in the text, where the lines of a known sentence do not
count again. A known sentence that the cuts part in its real wording is known
by its fragments, one after the other. The identifiers of a document, in order, are matched against
licence rules, sequences of identifiers. Rules are tried in their order, and what one has matched is not
there for the next.

Each document is worked on by itself: nothing is shuffled or exploded.

Defined cases: missing and empty texts, and texts without known sentences, have
no licences; a notice that is repeated counts once in ``licenses`` and each
time in ``n_matches``; known sentences in no rule's order count in
``n_sentences`` alone; repeated rows give equal results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier (fixed values).
SENTENCES = {
    "apache2-short": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license 2 0", "released under the apache license version 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-short": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "the mit license", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "gpl3-short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-short": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl3-short": ["licensed under the gnu lesser general public license version 3", "this library is licensed under the gnu lesser general public license version 3"],
    "agpl3-short": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "or-later": ["or at your option any later version of the license"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3-short": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2-short": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "mpl2-short": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "cc0": ["licensed under cc0 1 0", "released under the cc0 1 0 public domain license", "this license dedicates the work to the public domain under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl2-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl21-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "epl2-short": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0", "licensed under the eclipse public license 2 0"],
    "reserved": ["all rights reserved under copyright", "copyright all rights reserved"],
}
#: Rules in their order: licence, category, identifiers (fixed values).
RULES = [
    ("MIT", "permissive", ["mit-short", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", "permissive", ["apache2-short", "apache2-comply", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", "permissive", ["apache2-comply", "apache2-copy", "apache2-basis"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-redistribute", "gpl-copy"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-short", "or-later"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-short", "or-later"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-redistribute"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-redistribute"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-redistribute"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-redistribute"]),
    ("BSD-3-Clause", "permissive", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("MIT", "permissive", ["mit-short"]),
    ("Apache-2.0", "permissive", ["apache2-short"]),
    ("GPL-3.0", "copyleft", ["gpl3-short"]),
    ("GPL-2.0", "copyleft", ["gpl2-short"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-short"]),
    ("AGPL-3.0", "copyleft", ["agpl3-short"]),
    ("BSD-3-Clause", "permissive", ["bsd3-short"]),
    ("BSD-2-Clause", "permissive", ["bsd2-short"]),
    ("MPL-2.0", "copyleft", ["mpl2-short"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("Zlib", "permissive", ["zlib-grant"]),
    ("BSL-1.0", "permissive", ["boost-grant"]),
    ("EPL-2.0", "copyleft", ["epl2-short"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC0-1.0", "public-domain", ["cc0"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("Proprietary", "restricted", ["reserved"]),
]
#: Every known sentence has one of these in a word (which no line end can part); texts without any have no known sentence.
STEMS = ["licen", "copyright", "permission", "redistribut", "unencumbered", "warrant"]
CUTS = {"sentences": r"\n[ \t\r]*\n|[.!?;:][ \t\r\n]", "lines": r"\n|[.!?;:][ \t\r]"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDENTIFIER = {s: k for k, v in SENTENCES.items() for s in v}
#: Real wordings that CUTS part.
WORDINGS = {
    "gpl-redistribute": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "gpl2-redistribute": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 2 of the license, or (at your option) any later version"],
    "lgpl21-redistribute": ["this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 2.1 of the license, or (at your option) any later version"],
    "lgpl3-redistribute": ["this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "agpl3-redistribute": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "mpl2-short": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
}


def _fragments(wording: str) -> tuple[str, ...]:
    return tuple(re.sub("[^a-z0-9]+", " ", x).strip() for x in re.split(CUTS["sentences"], wording))


#: The two fragments of each such wording, by identifier.
FRAGMENTS = {_fragments(x): k for k, v in WORDINGS.items() for x in v}


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _identifier(sentence: Column, after: Column) -> Column:
    """Of a sentence that is known, or whose wording goes on in ``after``, the next one as a whole or its first line."""
    known = F.create_map(*[F.lit(x) for pair in IDENTIFIER.items() for x in pair])
    out = F.when(F.length(sentence).between(min(map(len, IDENTIFIER)), max(map(len, IDENTIFIER))), known[sentence])
    for (first, rest), k in FRAGMENTS.items():
        out = F.when((sentence == first) & ((after["whole"] == rest) | (F.get(after["lines"], F.lit(0)) == rest)), F.lit(k)).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """(whole, lines) of each sentence, normalised, without blank ones; every cut of 'sentences' is one of 'lines' too."""
    lines = lambda s: F.filter(F.transform(F.split(s, CUTS["lines"]), _normal), lambda x: x != "")
    return F.filter(F.transform(F.split(text, CUTS["sentences"]), lambda s: F.struct(_normal(s).alias("whole"), lines(s).alias("lines"))), lambda x: x["whole"] != "")


def identifiers(parts: Column) -> Column:
    """The identifiers of the known ones among ``sentences()``, in order, as one string: each between spaces."""

    def found(x: Column, i: Column) -> Column:
        after = F.get(parts, i + 1)
        whole = _identifier(x["whole"], after)
        # fragments are sentences of their own, so only the last line of a sentence can go on in the next
        last = F.size(x["lines"]) - 1
        lines = F.transform(x["lines"], lambda y, j: _identifier(y, F.when(j == last, after)))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.filter(lines, lambda y: y.isNotNull()))

    return F.array_join(F.transform(F.flatten(F.transform(parts, found)), lambda s: F.concat(F.lit(" "), s, F.lit(" "))), "")


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, licenses, category, n_matches, n_sentences) of each row; category is that of the first licence by rule order."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    # literal stems: a text without any, by far the most, is not cut at all
    likely = F.lit(False)
    for stem in STEMS:
        likely |= text.contains(stem)
    out = documents.select("doc_id", F.when(likely, text).otherwise("").alias("low"))
    out = out.select("doc_id", F.when(F.col("low") != "", sentences(F.col("low"))).alias("parts"))
    out = out.select("doc_id", F.coalesce(identifiers(F.col("parts")), F.lit("")).alias("left"))
    out = out.select("doc_id", "left", F.floor(F.length(F.regexp_replace("left", "[^ ]", "")) / 2).cast("bigint").alias("n_sentences"))
    out = out.withColumns({"n_matches": F.lit(0).cast("bigint"), "matched": F.array().cast("array<int>")})
    empty = F.col("left") == ""
    state = F.struct(F.col("left").alias("left"), F.col("n_matches").alias("n"), F.col("matched").alias("rules"))
    patterns = F.array(*[F.struct(F.lit(i).alias("i"), F.lit("".join(f" {x} " for x in ids)).alias("p")) for i, (_, _, ids) in enumerate(RULES)])

    def step(s: Column, r: Column) -> Column:
        rest = F.replace(s["left"], r["p"], F.lit("|"))
        n = (F.length(s["left"]) - F.length(rest)) / (F.length(r["p"]) - 1)
        return F.struct(rest.alias("left"), (s["n"] + n.cast("bigint")).alias("n"), F.when(n > 0, F.concat(s["rules"], F.array(r["i"]))).otherwise(s["rules"]).alias("rules"))

    out = out.withColumn("s", F.when(empty, state).otherwise(F.aggregate(patterns, state, step)))
    names, kinds = (F.array(*[F.lit(r[k]) for r in RULES]) for k in (0, 1))
    rules = F.col("s.rules")
    licenses = F.array_join(F.array_distinct(F.transform(rules, lambda i: names[i])), ",")
    return out.select("doc_id", licenses.alias("licenses"), F.coalesce(F.when(F.size(rules) > 0, kinds[rules[0]]), F.lit("none")).alias("category"), F.col("s.n").alias("n_matches"), "n_sentences")


def sql() -> str:
    """The same scan in SQL for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(s)}: {q(k)}" for s, k in IDENTIFIER.items()) + "}"
    normal = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    lines = f"list_filter(list_transform(string_split_regex(s, {q(CUTS['lines'])}), lambda x: {normal('x')}), lambda x: x <> '')"

    def identifier(x: str, after: str) -> str:
        parts = "".join(f"WHEN {x} = {q(first)} AND (({after}).whole = {q(rest)} OR ({after}).lines[1] = {q(rest)}) THEN {q(k)} " for (first, rest), k in FRAGMENTS.items())
        return f"(CASE {parts}ELSE {known}[{x}] END)"

    steps, last = [], "s0"
    for i, (_, _, ids) in enumerate(RULES):
        p = "".join(f" {x} " for x in ids)
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (replace(remaining, {q(p)}, '|') AS remaining), (length(remaining) - length(replace(remaining, {q(p)}, '|'))) // {len(p) - 1} AS n{i} FROM {last})")
        last = f"s{i + 1}"
    total = " + ".join(f"n{i}" for i in range(len(RULES)))
    names = ", ".join(f"CASE WHEN n{i} > 0 THEN {q(r[0])} END" for i, r in enumerate(RULES))
    kind = " ".join(f"WHEN n{i} > 0 THEN {q(r[1])}" for i, r in enumerate(RULES))
    return f"""
WITH base AS (SELECT doc_id, translate(coalesce(text, ''), {q(UPPER)}, {q(LOWER)}) AS low FROM documents),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(low, {q(CUTS["sentences"])}), lambda s: {{'whole': {normal("s")}, 'lines': {lines}}}), lambda p: p.whole <> '') AS parts
  FROM base),
told AS (
  SELECT doc_id, flatten(list_transform(parts, lambda p, i: CASE WHEN {identifier("p.whole", "parts[i + 1]")} IS NOT NULL THEN [{identifier("p.whole", "parts[i + 1]")}]
    ELSE list_transform(p.lines, lambda y, j: {identifier("y", "CASE WHEN j = len(p.lines) THEN parts[i + 1] END")}) END)) AS ids
  FROM cut),
picked AS (SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(ids, lambda x: x IS NOT NULL), lambda x: ' ' || x || ' '), ''), '') AS remaining FROM told),
s0 AS (SELECT *, length(regexp_replace(remaining, '[^ ]', '', 'g')) // 2 AS n_sentences FROM picked),
{", ".join(steps)},
named AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS l FROM {last})
SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licenses, CASE {kind} ELSE 'none' END AS category,
       ({total})::BIGINT AS n_matches, n_sentences::BIGINT AS n_sentences
FROM named
"""
