import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import SCHEMA, SF001, linked, near_classes, rows
from sentiscope.llm import ngram_join as M
from sentiscope.llm.components import components

NAMES = ("doc_id", "class_id", "n_links", "n_texts")


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(M.op8_ngram_join(spark, SF001), *NAMES) == near_classes(docs)


@pytest.fixture(scope="module")
def given():
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(3)]
    out = []
    for i in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 3)}"
        out.append((rng.choice([None, i, i, i, 3]), rng.choice([None, "", "a b", *[" ".join(w)] * 3])))
    return out + out[:4]


def test_blocks_and_cases_equal_brute_force(spark, given, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)  # a component meets itself in many pairs of blocks
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 as sid", "2 as root")
    assert rows(M.near_classes(df), *NAMES) == near_classes(given)


def test_one_row_of_each_class_stays(spark, given):
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 as th", "2 as keep")
    out = M.drop_near_copies(df)
    assert out.columns == df.columns
    real = [g for g in given if (g[1] or "").strip()]
    component = {g: c for g, (c, _, _) in zip(real, linked(real))}
    got = [component[r.doc_id, r.text] for r in out.collect() if (r.text or "").strip()]
    assert sorted(got) == sorted(set(component.values()))
    assert {(r.doc_id, r.text) for r in out.collect() if not (r.text or "").strip()} == {g for g in given if not (g[1] or "").strip()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.near_classes(df).collect() == [] and M.drop_near_copies(df).collect() == []


def test_band_count_reaches_the_recall():
    b = M.band_counts(0.8, 6, 0.9999)
    assert 1 - (1 - 0.8 ** 6) ** b >= 0.9999 > 1 - (1 - 0.8 ** 6) ** (b - 1)


@pytest.mark.parametrize("size", [8, 40, 400])
def test_measured_recall_at_the_threshold(size):
    rng = np.random.default_rng(size)
    common = round(size * 2 * 0.8 / 1.8)  # of two sets of this size at similarity 0.8
    bands, found, n = M.band_counts(), 0, 300
    for _ in range(n):
        pool = rng.integers(0, 2 ** 63, 2 * size - common).astype(np.uint64)
        a, b = pool[:size], pool[size - common:]
        s = M.signatures(np.array([0, size, 2 * size]), np.concatenate([a, b]), bands * M.ROWS)
        x, y = M._bands(s, bands)
        found += bool((x == y).any())
    assert found >= 0.98 * n


def test_shingle_sets_are_distinct_and_sorted():
    first, h = M.shingle_sets(pa.array(["a b c d e a b c d e a", "a b", "a b", None, "", "b a"]), 5)
    assert np.diff(first).tolist() == [5, 1, 1, 0, 0, 1]
    assert h[5] == h[6] != h[7]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in components(edges, "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("size", [8, 40, 400, 3000])
def test_measured_recall_of_bands_and_signatures_together(size):
    """Pairs at the threshold are links: hardly one is lost before the full sets."""
    rng = np.random.default_rng(size + 1)
    common = -(-size * 2 * 8 // 18)  # similarity 0.8 or a little more
    bands, found, n = M.band_counts(), 0, 300
    for _ in range(n):
        pool = rng.integers(0, 2 ** 63, 2 * size - common).astype(np.uint64)
        first, h = np.array([0, size, 2 * size]), np.concatenate([np.sort(pool[:size]), np.sort(pool[size - common:])])
        near, compared = M.links(first, h, np.zeros(2), 0, 0, bands, M.ROWS, 0.8)
        found += near[0, 1]
    assert found >= 0.98 * n


def _template(rng, n):
    """Texts with 100 words in common and 64 of their own: similarity 0.44, no link."""
    head = [f"t{k}" for k in range(100)]
    return [(i, " ".join(head + [f"w{rng.randrange(10 ** 9)}" for _ in range(64)])) for i in range(n)]


def test_a_common_template_makes_no_candidates(spark):
    rng = random.Random(8)
    given = _template(rng, 1500)
    first, h = M.shingle_sets(pa.array([t for _, t in given]), 5)
    near, compared = M.links(first, h, np.zeros(1500), 0, 0, M.band_counts(), M.ROWS, 0.8)
    assert not near.any() and compared <= 100  # of 1 124 250 pairs
    sig = M.signatures(first, h, M.band_counts() * M.ROWS)
    shared = (M._bands(sig, M.band_counts())[:200, None] == M._bands(sig, M.band_counts())[None, :200]).any(axis=2)
    assert np.triu(shared, 1).sum() > 0.05 * 200 * 199 / 2  # the bands alone would let many through
    rows_ = [(i, len(h[a:b]), M._bands(sig[i:i + 1], M.band_counts())[0].view(np.int64).tolist(), sig[i].astype(np.uint8).tobytes())
             for i, (a, b) in enumerate(zip(first, first[1:]))]
    members = spark.createDataFrame(rows_, "node long, n int, bands array<long>, signature binary")
    groups = components(M.candidate_edges(members), "node", "peer").groupBy("root").count().collect()
    assert max([r["count"] for r in groups], default=0) <= 3
    assert all(r.n_links == 0 for r in M.near_classes(spark.createDataFrame(given, SCHEMA)).collect())


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_both_ways_to_count_what_sets_share(monkeypatch, dense):
    monkeypatch.setattr(M, "DENSE", dense)
    rng = random.Random(9)
    first, h = M.shingle_sets(pa.array([" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(30)]), 3)
    sets = [set(h[a:b].tolist()) for a, b in zip(first, first[1:])]
    left, right = np.arange(0, 20), np.arange(10, 30)
    wanted = np.array([[rng.random() < 0.5 for _ in right] for _ in left])
    got = M._common(first, h, left, right, wanted)
    assert got.tolist() == [[len(sets[a] & sets[b]) if w else 0 for b, w in zip(right, ws)] for a, ws in zip(left, wanted)]


def test_rows_that_stay(spark):
    given = [(1, "", "a"), (1, "", "a"), (None, None, "b"), (2, " \n", "c"), (3, None, "d"), (4, "\t", "e"),  # wordless: all stay
             (5, "one two three", "z"), (5, "one two three", "b"), (5, "one two three", None), (6, "x " * 40000, "l"), (7, "x " * 40000, "l")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    clash = df.selectExpr("*", "1 as row", "2 as _h", "3 as _id", "4 as _th", "5 as h", "map('k', source) as id", "7 as worded", "8 as keep_id", "9 as `a.b`")
    out = M.drop_near_copies(clash)
    assert out.columns == clash.columns
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == sorted(
        given[:6] + [(5, "one two three", None), (6, "x " * 40000, "l")], key=str)


def test_repeats_of_a_representative_are_sent_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    given = [(1, text)] * 40 + [(2, text.replace("w30 ", "v ")), (3, text + " more")]
    assert rows(M.near_classes(spark.createDataFrame(given, SCHEMA).repartition(4)), *NAMES) == near_classes(given)
