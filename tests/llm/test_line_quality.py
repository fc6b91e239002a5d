import random

from helpers import SCHEMA, SF001, same_as_sql, words
from sentiscope.llm import line_quality as M


def test_query_equals_sql(spark):
    same_as_sql(M.op6_line_quality(spark, SF001), M.SQL)


def _repeated(text, width=5):
    w = words(text)
    seen = {}
    for i in range(len(w) - width + 1):
        seen.setdefault(tuple(w[i:i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def test_repeated_words_and_cases_equal_sql(spark):
    rng = random.Random(4)
    texts = [None, "", "  \n \n", "x " * 30, "a b c d e\n" * 2, "one line. \none line. \n\ttwo", "w" * 20000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x y"), (3, "x " * 30)], SCHEMA)
    out = M.judge(df.selectExpr("*", "1 as w", "2 as rest", "'k' as kept"))
    for r in out.collect():
        if r.doc_id is not None:
            assert r.n_repeat_words == _repeated(texts[r.doc_id]) and (r.w, r.rest) == (1, 2)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same_as_sql(out.select(*names), M.SQL, documents=df)


def test_lines_go_first(spark):
    good = "this is a line of ordinary words that ends as it should."
    more = "quite another sentence stands below, with no phrase in common."
    text = "\n".join([good, more, "home | news | about | help", "All rights reserved.", "no closing mark here"])
    r, = M.judge(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert r.cleaned == "\n".join(text.split("\n")[:2])
    assert r.lost_words == 7 + 3 + 4 and not r.kept
    r, = M.judge(spark.createDataFrame([(1, good + "\n" + more)], SCHEMA)).collect()
    assert r.kept and r.lost_words == 0


def test_empty_table(spark):
    assert M.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_labels_agree(spark):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in M.op6_line_quality(spark, SF001).where("kept").collect()}
    assert not bad & kept and len(good & kept) >= 0.9 * len(good)


GOOD = ["She was designing a house near the river.", "They were assigning homework to students.", "The catalog in the library is old.",
        "We bake cookies every Sunday.", "He said \u201cI will go home.\u201d", "\u4ed6\u6628\u5929\u53bb\u4e86\u56fe\u4e66\u9986\u3002", "\u0935\u0939 \u0918\u0930 \u091c\u093e \u0930\u0939\u093e \u0939\u0948\u0964",
        "\u0647\u0644 \u0630\u0647\u0628 \u0625\u0644\u0649 \u0627\u0644\u0628\u064a\u062a\u061f", "Er sagte \u00bbja\u00ab und ging\u2026", "\u0e40\u0e02\u0e32\u0e44\u0e1b\u0e15\u0e25\u0e32\u0e14", "\u300c\u306f\u3044\u300d", "The copyrighted work was released undercover in JavaScript land.",
        "Il a dit \u00ab oui \u00bb", "I like to read.", "'Tis so'"]
BAD = ["no closing mark here", "and a comma at its end,", "home | news | about | help.", "Please log in.", "Sign in!", "Click here!", "(c) 2023 Acme.",
       "Copyright 2020 Foo.", "All rights reserved.", "This site uses cookies.", "Please enable JavaScript.", "Alle Rechte vorbehalten.", "Tous droits r\u00e9serv\u00e9s.",
       "\u4f60\u597d\u4e16\u754c", "what??!! now??", "A list \u2022", "ends in a slash /", "Read more."]


def test_lines_of_many_kinds(spark):
    """Each line alone: the query and the SQL agree, and the verdict is the one wanted."""
    lines = [(i, x + "\n" + "the filler is a plain line of words, and it is long enough.") for i, x in enumerate(GOOD + BAD)]
    df = spark.createDataFrame(lines, SCHEMA)
    out = M.judge(df)
    failed = {r.doc_id for r in out.collect() if r.lost_words}
    assert {x for i, x in enumerate(GOOD + BAD) if i in failed} == set(BAD)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same_as_sql(out.select(*names), M.SQL, documents=df)
    alone = spark.createDataFrame([(i, "\n".join([x] * 1 + [f"{k} {x}" for k in range(9)])) for i, x in enumerate(GOOD + BAD)], SCHEMA)
    same_as_sql(M.judge(alone).select(*names), M.SQL, documents=alone)
