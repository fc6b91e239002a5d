"""Licence scans: normalised text against licence templates by Dice over word bigrams.

A *unit* is a line, a paragraph (between empty lines) or the whole text of a document,
lower case, with every run of other characters than letters and digits as one blank. Its
set of word bigrams A is compared with each template's set B: Dice = 2 |A and B| /
(|A| + |B|), and 0.8 or more is a match. A match needs |B| t / (2 - t) <= |A| <=
|B| (2 - t) / t, so templates out of these bounds are not compared; and it shares more than
``t / (2 - t)`` of B, so a unit without one of a few anchor words, computed from the templates,
is not looked at. Both tests leave no match out.

A *notice* inside other words does not hang on lines: it is a run of words of the whole text
whose bigrams match a template by the same Dice, between the template's size bounds. Only
runs that begin and end with a bigram of the template are compared (without an outer bigram that
the template lacks, Dice is larger). Of runs that overlap, the one of larger Dice stays, then
the longer. A notice counts as a unit more, unless a matching unit of its name holds its words.

All of it is columns over one row: no shuffle, no Python.

Defined cases: a null or empty text, and one of fewer than two words, matches nothing;
equal units of a document count once, as do equal notices; of equal Dice the first name wins; repeated rows
match alike; an empty table gives an empty table; ``license``, ``dice``, ``licenses``
and ``n_matches`` replace columns of these names, others pass through.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from sentiscope.llm.common import let, table

THRESHOLD = Fraction(4, 5)

# The notices of common licences, as their publishers word them.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("All rights reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Whole short licences, and how the bodies of long ones begin.
BODIES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
)
TEMPLATES = (*NOTICES, *BODIES)
OTHER = r"[^\p{L}\p{N}]+"


def bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, t: Fraction = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a unit that can match a template of this size."""
    return -(-size * t // (2 - t)), size * (2 - t) // t


def anchors(templates=TEMPLATES, t: Fraction = THRESHOLD) -> list[str]:
    """Words of which every matching unit holds one: for each template, the bigrams
    that touch them outnumber those that a match may lack."""
    open_ = [(set(b), len(b) - bounds(len(b), t)[0]) for b in (bigrams(x) for _, x in templates)]
    chosen: list[str] = []
    while open_ := [(b, spare) for b, spare in open_
                    if sum(any(w in chosen for w in x.split()) for x in b) <= spare]:
        gain: dict[str, int] = {}
        for b, _ in open_:
            for w in {w for x in b for w in x.split()} - set(chosen):
                gain[w] = gain.get(w, 0) + len(w) ** 2  # long words are rare in other text
        chosen.append(max(gain, key=lambda w: (gain[w], w)))
    return chosen


def _known(t: Fraction, templates) -> Column:
    """The templates: bigrams, their number and bounds, minus their place in order, name."""
    ordered = sorted(templates)
    return F.array(*[F.struct(F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                              F.lit(-i).alias("place"), F.lit(name).alias("name"))
                     for i, (name, text) in enumerate(ordered) for b in [bigrams(text)] for lo, hi in [bounds(len(b), t)]])


def _dice(a: Column, x: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(a, x["b"])) / (F.size(a) + x["n"])


def _match(units: Column, t: Fraction, templates) -> Column:
    """The matches of a column of units, each its bigram set ``a`` and words ``said``:
    (dice, minus the template's place in order, name, said)."""
    best = lambda u: F.array_max(F.transform(
        F.filter(_known(t, templates), lambda x: F.size(u["a"]).between(x["lo"], x["hi"])),
        lambda x: F.struct(_dice(u["a"], x).alias("dice"), x["place"].alias("place"), x["name"].alias("name"), u["said"].alias("said"))))
    return F.filter(F.transform(units, best), lambda m: F.coalesce(m["dice"] >= float(t), F.lit(False)))


def _pairs(w: Column) -> Column:
    """The bigrams of an array of words, in order."""
    return F.when(F.size(w) > 1, F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))


def _notices(words: Column, t: Fraction, templates=TEMPLATES) -> Column:
    """The notices in the words of a text, as ``_match`` gives units."""
    every = F.array(*map(F.lit, sorted({b for _, text in templates for b in bigrams(text)})))

    def runs(w, pairs, x, hit):
        """Runs of one template: (-dice, -words, -place, first and last bigram, name)."""
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda s: F.get(hit, s)
                      & (F.size(F.filter(F.slice(hit, s + 1, x["hi"]), lambda h: h)) >= x["lo"]))
        last = lambda s: F.least(s + x["hi"], F.size(pairs)) - 1
        ends = lambda s: F.when(last(s) >= s + x["lo"] - 1, F.filter(
            F.sequence(s + x["lo"] - 1, last(s)), lambda e: F.get(hit, e)))
        made = F.flatten(F.transform(at, lambda s: F.transform(ends(s), lambda e: F.struct(
            (-_dice(F.array_distinct(F.slice(pairs, s + 1, e - s + 1)), x)).alias("less"), (s - e).alias("short"),
            (-x["place"]).alias("place"), s.alias("s"), e.alias("e"), x["name"].alias("name")))))
        return F.filter(made, lambda r: r["less"] <= -float(t))

    def of_text(w, pairs):
        some = F.array_intersect(pairs, every)  # distinct
        near = F.filter(_known(t, templates), lambda x: F.size(F.array_intersect(some, x["b"])) >= x["lo"])
        found = F.array_sort(F.flatten(F.transform(near, lambda x: let(
            F.transform(pairs, lambda p: F.array_contains(x["b"], p)), lambda hit: runs(w, pairs, x, hit)))))
        none = F.filter(found, lambda r: F.lit(False))
        apart = F.aggregate(found, none, lambda kept, r: F.when(
            F.exists(kept, lambda k: (k["s"] <= r["e"] + 1) & (r["s"] <= k["e"] + 1)), kept).otherwise(F.array_append(kept, r)))
        return F.array_distinct(F.transform(apart, lambda r: F.struct(
            (-r["less"]).alias("dice"), (-r["place"]).alias("place"), r["name"].alias("name"),
            F.array_join(F.slice(w, r["s"] + 1, r["e"] - r["s"] + 2), " ").alias("said"))))

    return let(words, lambda w: let(_pairs(w), lambda pairs: of_text(w, pairs)))


def scan(docs: DataFrame, t: Fraction = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``templates``: (name, text) of each template, as literals of the plan. The columns of ``docs`` with ``license`` (the best match, or null), its ``dice``,
    all names in ``licenses`` and ``n_matches``, the matching units."""
    made = ("license", "dice", "licenses", "n_matches")
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in made])
    text = F.col("rest.text")
    word = r"(?<![\p{L}\p{N}])(?:" + "|".join(anchors(templates, t)) + r")(?![\p{L}\p{N}])"
    likely = lambda c: F.lower(c).rlike(word)
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n\n"), F.array(text)))
    none = F.array().cast("array<string>")
    words = lambda u: F.split(F.trim(F.regexp_replace(F.lower(u), OTHER, " ")), " ")
    d = docs.select(rest.alias("rest")).select("rest", F.when(likely(text), units).otherwise(none).alias("units"),
                                               F.when(likely(text), text).alias("whole"))
    sets = F.transform(F.filter("units", likely), lambda u: let(words(u), lambda w: F.struct(
        F.array_distinct(_pairs(w)).alias("a"), F.array_join(w, " ").alias("said"))))
    d = d.select("rest", _match(F.filter(sets, lambda x: x["a"].isNotNull()), t, templates).alias("units"), _notices(words(F.col("whole")), t, templates).alias("notices"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    fresh = lambda units, notices: F.filter(notices, lambda x: ~F.exists(
        units, lambda u: (u["name"] == x["name"]) & spaced(u["said"]).contains(spaced(x["said"]))))
    d = d.select("rest", let(F.struct("units", F.coalesce("notices", F.filter("units", lambda u: F.lit(False))).alias("notices")), lambda f: F.concat(f["units"], fresh(f["units"], f["notices"]))).alias("found"))
    best = F.array_max("found")
    return d.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in made],
                    best["name"].alias("license"), best["dice"].alias("dice"),
                    F.array_sort(F.array_distinct(F.col("found.name"))).alias("licenses"),
                    F.size("found").cast("long").alias("n_matches"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence notice of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", "dice", "n_matches")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH t AS (
  SELECT * FROM (VALUES {", ".join(f"({-i}, {_quoted(n)}, {_quoted(x)})" for i, (n, x) in enumerate(sorted(TEMPLATES)))}) AS v(place, name, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
u AS (
  SELECT r, unnest(list_distinct(string_split(text, chr(10)) || string_split(text, chr(10) || chr(10)) || [text])) AS unit
  FROM d WHERE text IS NOT NULL),
w AS (SELECT r, unit, string_split(trim(regexp_replace(lower(unit), '{OTHER}', ' ', 'g')), ' ') AS w FROM u),
a AS (
  SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM w WHERE len(w) > 1),
tw AS (SELECT place, name, string_split(trim(regexp_replace(lower(text), '{OTHER}', ' ', 'g')), ' ') AS w FROM t),
b AS (SELECT place, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
c AS (
  SELECT r, unit, place, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM a JOIN b ON 3 * len(a) >= 2 * len(b) AND 2 * len(a) <= 3 * len(b)),
m AS (
  SELECT r, unit, max(row(dice, place, name)) AS m FROM c WHERE dice >= 0.8 GROUP BY r, unit),
g AS (SELECT r, max(m) AS m, count(*) AS n FROM m GROUP BY r)
SELECT d.doc_id, struct_extract(g.m, 3) AS license, struct_extract(g.m, 1) AS dice, coalesce(g.n, 0) AS n_matches
FROM d LEFT JOIN g USING (r)
"""
