import random
from fractions import Fraction

from helpers import SCHEMA, SF001, same_as_sql
from sentiscope.llm import licenses as M


def test_query_equals_sql(spark):
    same_as_sql(M.op10_license_scan(spark, SF001), M.SQL)


def test_every_template_is_found_and_its_variants(spark):
    given = []
    for name, text in M.NOTICES:
        given += [text, text.upper(), "Some prose before it.\n" + text.replace(" ", "  ") + "\nand after.", text + " Thanks."]
    df = spark.createDataFrame(list(enumerate(given)), SCHEMA)
    out = {r.doc_id: r for r in M.scan(df).collect()}
    for i in range(len(given)):
        name = M.NOTICES[i // 4][0]
        if i % 4 < 3:
            assert out[i].license == name and out[i].dice == 1.0
    same_as_sql(M.scan(df).select("doc_id", "license", "dice", "n_matches"), M.SQL, documents=df)


def test_anchors_and_bounds_leave_no_match_out():
    chosen = set(M.anchors())
    for _, text in M.TEMPLATES:
        b = M.bigrams(text)
        low, high = M.bounds(len(b))
        touched = sum(any(w in chosen for w in x.split()) for x in b)
        assert touched > len(b) - low  # what a match may lack cannot hold all of them
        for n in range(1, 3 * len(b)):
            possible = Fraction(2 * min(n, len(b)), n + len(b)) >= M.THRESHOLD
            assert possible == (low <= n <= high)


def test_cases(spark):
    long = "word " * 30000 + "\nReleased under the MIT license!"
    given = [(1, None), (2, ""), (3, "mit"), (4, long), (4, long), (None, "Released under the MIT License."), (5, "licensed " * 40)]
    df = spark.createDataFrame(given, SCHEMA)
    out = M.scan(df.selectExpr("*", "1 as dice", "2 as rest", "3 as found"))
    got = sorted(((r.doc_id, r.license, r.n_matches, r.rest, r.found) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 0, 2, 3), (2, None, 0, 2, 3), (3, None, 0, 2, 3), (4, "MIT", 2, 2, 3), (4, "MIT", 2, 2, 3),  # its line, and its few bigrams as a whole
                          (None, "MIT", 1, 2, 3), (5, None, 0, 2, 3)], key=str)
    same_as_sql(M.scan(df).select("doc_id", "license", "dice", "n_matches"), M.SQL, documents=df)
    assert M.scan(df.limit(0)).collect() == []


def test_notices_inside_lines(spark):
    apache, gpl = ([x for n, x in M.TEMPLATES if n == name][1] for name in ("Apache-2.0", "GPL-3.0"))
    given = [("Copyright 2020 Foo Inc. Released under the MIT License.", "MIT", ["MIT"], 1),
             ("(c) 2023 Acme Corp. All rights reserved.", "All rights reserved", ["All rights reserved"], 1),
             ("We hope you enjoyed this. Licensed under the Apache License, Version 2.0.", "Apache-2.0", ["Apache-2.0"], 1),
             ("An introduction of some words.\r\n\r\n" + gpl.replace(" you", "\r\nyou").replace(" General", "\r\nGeneral") + "\r\n \r\n" + " ".join(f"word{i}" for i in range(60)), "GPL-3.0", ["GPL-3.0"], 1),
             ("# a file that does many things\n#\n# " + apache.replace(" use", "\n# use") + "\n# \n# and more words after it, of which there are some", "Apache-2.0", ["Apache-2.0"], 1),
             ("Licensed under the Apache License, Version 2.0. All rights reserved.", "All rights reserved", ["All rights reserved", "Apache-2.0"], 2),
             ("Here is our text. Released under the MIT License. Much later it says: Licensed under CC BY-SA 4.0. Then it ends", "CC-BY-SA-4.0", ["CC-BY-SA-4.0", "MIT"], 2),
             ("Released under the MIT License\nand once more, as said above: Released under the MIT License", "MIT", ["MIT"], 1),
             ("the mit license of all rights that are not reserved, under the version", None, [], 0)]
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(given)], SCHEMA)
    out = {r.doc_id: r for r in M.scan(df).collect()}
    for i, (text, name, names, n) in enumerate(given):
        assert (out[i].license, out[i].licenses, out[i].n_matches) == (name, names, n), text
        assert out[i].dice == (1.0 if name else None), text


def test_notices_equal_brute_force(spark):
    rng = random.Random(4)
    pool = sorted({w for _, x in M.NOTICES for w in M.re.findall(r"[^\W_]+", x.lower())})
    given = []
    for n in range(60):
        w = []
        for _ in range(rng.randint(1, 3)):
            w += [f"q{rng.randint(0, 9)}" for _ in range(rng.randint(3, 25))]
            part = M.re.findall(r"[^\W_]+", rng.choice(M.NOTICES)[1])[:50]
            for _ in range(rng.randint(0, 4)):
                part.insert(rng.randrange(len(part)), rng.choice(pool))
                del part[rng.randrange(len(part))]
            w += part
        given.append((n, " ".join(w + ["tail"] * 20)))

    def brute(text):
        w, found = text.lower().split(), []
        for place, (name, x) in enumerate(sorted(M.NOTICES)):
            b = set(M.bigrams(x))
            low, high = M.bounds(len(b))
            for s in range(len(w)):
                for size in range(low, min(high, len(w) - 1 - s) + 1):
                    a = {f"{p} {q}" for p, q in zip(w[s:s + size], w[s + 1:s + size + 1])}
                    dice = 2.0 * len(a & b) / (len(a) + len(b))
                    if dice >= 0.8 and f"{w[s]} {w[s + 1]}" in b and f"{w[s + size - 1]} {w[s + size]}" in b:
                        found.append((-dice, -size, place, s, s + size, name))
        kept = []
        for r in sorted(found):
            if all(r[4] < k[3] or k[4] < r[3] for k in kept):
                kept.append(r)
        return {(r[5], -r[0], " ".join(w[r[3]:r[4] + 1])) for r in kept}

    df = spark.createDataFrame(given, SCHEMA)
    plain = {r.doc_id: {(x.name, x.dice, x.said) for x in r.found or []} for r in df.select(
        "doc_id", M._notices(M.F.split(M.F.lower("text"), " "), M.THRESHOLD, M.NOTICES).alias("found")).collect()}
    want = {i: brute(t) for i, t in given}
    assert sum(map(len, want.values())) > 40 and plain == want


def test_whole_licences_and_the_heads_of_long_ones(spark):
    body = dict(M.BODIES)
    wrapped = lambda t: t.replace(". ", ".\n\n")
    given = [("MIT License\n\nCopyright (c) 2024 Somebody\n\n" + wrapped(body["MIT"]), "MIT"), ("Copyright 2020\n" + wrapped(body["ISC"]), "ISC"),
             (wrapped(body["BSD-2-Clause"]) + "\n\nThis software is provided by somebody.", "BSD-2-Clause"),
             (wrapped(body["BSD-3-Clause"]) + "\n\nThis software is provided by somebody.", "BSD-3-Clause"),
             ("                Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n"
              "   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + "long body follows here " * 50, "Apache-2.0"),
             (body["GPL-3.0"].upper() + "\n\nPreamble\n" + "and so on " * 80, "GPL-3.0")]
    out = {r.doc_id: r for r in M.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], SCHEMA)).collect()}
    for i, (text, name) in enumerate(given):
        assert name in out[i].licenses, (name, out[i])


def test_templates_are_an_argument(spark):
    own = (("House-1", "This text belongs to the house and stays in the house."), ("House-2", "Anybody may take this text away with them."))
    given = [(1, "Chapter one is long and says many other things before. This text belongs to the house and stays in the house. The end comes after many more words than these."), (2, "ANYBODY may take this text away with them"), (3, "Released under the MIT License.")]
    out = {r.doc_id: (r.license, r.dice) for r in M.scan(spark.createDataFrame(given, SCHEMA), templates=own).collect()}
    assert out == {1: ("House-1", 1.0), 2: ("House-2", 1.0), 3: (None, None)}
