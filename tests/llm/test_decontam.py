import random
import unicodedata

import pytest

from helpers import SCHEMA, SF001, edit_distance_inside, words
from sentiscope.llm import decontam as M


def plain_words(text):
    """NFKC, lower case, cut at white space, punctuation and symbols."""
    low = unicodedata.normalize("NFKC", text or "").lower()
    return "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in low).split()


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 70))]
        t = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        mask = {}
        for i, w in enumerate(p):
            mask[w] = mask.get(w, 0) | 1 << i
        assert M.best_distance(mask, len(p), t)[0] == edit_distance_inside(p, t)


def test_pieces_cover_an_item():
    for n in range(8, 60):
        k = M.budget(n)
        cut = M.split(n, k + 1)
        assert cut[0][0] == 0 and cut[-1][1] == n and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        assert min(b - a for a, b in cut) >= n // (k + 1) >= 1


def test_query_finds_every_exact_passage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if i.text.lower() in (d.text or "").lower()}
    got = {(r.doc_id, r.item_id): r.distance for r in M.op9_decontamination(spark, SF001).collect()}
    assert exact and exact <= set(got) and all(got[k] == 0 for k in exact)


@pytest.fixture(scope="module")
def edited(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 60)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[3][1]), (3, items[3][1])]
    docs = []
    for n in range(150):
        w = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, int(M.ERROR * len(w)) + 2)):
            at, kind = rng.randrange(max(1, len(w))), rng.random()
            if kind < 0.3 and w:
                w[at] = "zz"
            elif kind < 0.6:
                del w[at:at + 1]
            else:
                w.insert(at, "qq")
        docs.append((n, " ".join(["aa"] * rng.randint(0, 20) + w + ["bb"] * rng.randint(0, 20)).upper().replace(" ", rng.choice([" ", ", ", " \u2014", " (?"]), 9)))
    docs += [(None, None), (5, ""), (6, " "), (None, docs[0][1]), (0, docs[0][1])]
    want, bad = [], set()
    for d, t in docs:
        for i, x in set(items):
            w = plain_words(x)
            if len(w) >= M.MIN_WORDS:
                e = edit_distance_inside(w, plain_words(t))
                if e <= M.budget(len(w)):
                    want.append((d, i, e))
                    bad.add(t)
    return docs, items, sorted(want, key=str), bad


@pytest.mark.parametrize("block", [M.BLOCK_BYTES, 500])
def test_edited_passages_equal_brute_force(spark, edited, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    docs, items, want, bad = edited
    d = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as item_id", "2 as _lower", "3 as row", "4 as stay")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in M.contaminations(d, b).collect()), key=str)
    assert got == want
    clean = M.drop_contaminated(d, b)
    assert clean.columns == d.columns and {tuple(r)[2:] for r in clean.collect()} <= {(1, 2, 3, 4)}
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(
        [x for x in docs if x[1] not in bad], key=str)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert M.contaminations(d, b).collect() == [] and M.contaminations(one, b).collect() == []
    assert M.drop_contaminated(one, b).count() == 1


def test_a_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "x " * 200000 + item + " y" * 1000
    d = spark.createDataFrame([(1, text)], SCHEMA)
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance, r.end_word) for r in M.contaminations(d, b).collect()] == [(1, 9, 0, 200040)]


def test_short_items_match(spark):
    items = [(1, "Paris"), (2, "the capital"), (3, "who wrote Hamlet now ?"), (4, "one two three four five six seven"), (5, " "),
             (6, " ".join(f"w{i}" for i in range(30)))]
    docs = [(1, "in paris, or in PARIS and Paris again"), (2, "What is the capital of it"), (3, "so who wrote hamlet now ? nobody"), (4, "a one two three x five six seven b"),
            (5, "who wrote hamlet then ?"), (6, items[5][1].replace("w4", "x")), (7, "parisian the one capital"), (8, "")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, j, e) for i, t in docs for j, x in items
                  for w in [plain_words(x)] if w
                  for e in [edit_distance_inside(w, plain_words(t))] if e <= M.budget(len(w)))
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (6, 6, 1)} == set(want)
    found = M.contaminations(d, b).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == want
    assert [r.end_word for r in found if r.doc_id == 1] == [2]
    assert sorted(r.doc_id for r in M.drop_contaminated(d, b).collect()) == [5, 7, 8]
    assert sorted(r.doc_id for r in M.drop_contaminated(d, b, min_words=8).collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_punctuation_and_spelling_forms_do_not_hide_an_item(spark):
    items = [(1, "What is the capital of France"), (2, "one two three four five six seven eight nine ten"), (3, "the price is 100 euros"), (4, "?!")]
    docs = [(1, "Quiz: What is the capital of France? Paris."), (2, "(one) two, three four; five six seven eight, nine 'ten'"),
            (3, "So the price \u2014 is \uff11\uff10\uff10 Euros!"), (4, "?! ?!"), (5, "What is the capital, of Spain")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = M.contaminations(d, b)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found.collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert sorted(tuple(r) for r in M.documents_per_item(found).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert sorted(r.doc_id for r in M.drop_contaminated(d, b).collect()) == [4, 5]
