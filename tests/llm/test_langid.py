import itertools
import math
import random

import numpy as np
import pytest

from helpers import SF001
from sentiscope.llm import langid as M

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "abb", "é"]


def _cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            yield [word[i:j] for i, j in zip((0, *at), (*at, len(word)))]


@pytest.fixture(scope="module")
def model():
    p = np.random.default_rng(0).random((len(PIECES) + 1, 2))
    return M.Model(M.Pieces(PIECES), ["x", "y"], p / p.sum(0))


def test_forward_sums_all_segmentations(model):
    rng = random.Random(0)
    words = ["▁" + "".join(rng.choice("abéz") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    got = model.word_scores(words)
    for w, scores in zip(words, got):
        for k in (0, 1):
            total = sum(math.prod(model.p[PIECES.index(x) if x in PIECES else -1, k] for x in cut)
                        for cut in _cuts(w) if all(x in PIECES or len(x) == 1 for x in cut))
            assert math.isclose(scores[k], math.log(total), rel_tol=1e-9)


def test_expectation_maximisation_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(M, "PRIOR", 1e-6)
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(80)})
    counts = np.random.default_rng(1).integers(1, 5, (len(words), 2)).astype(float)
    found = [float((M.fit(M.Pieces(PIECES), ["x", "y"], words, counts, n).word_scores(words) * counts).sum()) for n in range(1, 6)]
    assert all(b >= a - 1e-6 for a, b in zip(found, found[1:]))


def test_cases(spark):
    given = [(1, None, "a"), (2, "", "b"), (3, "12 3", None), (4, "x" * 5000, "a"), (5, "hello  world", "b"), (5, "hello  world", "b"), (None, "héllo", None)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    model = M.train(df, PIECES)
    assert model.languages == ["a", "b"] and np.allclose(model.p.sum(0), 1, atol=1e-3)
    out = M.predict(df.selectExpr("*", "'z' as score", "1 as first"), model)
    got = sorted(((r.doc_id, r.lang_pred, r.first) for r in out.collect()), key=str)
    assert got == sorted([(1, "und", 1), (2, "und", 1), (3, "und", 1), (4, "a", 1), (5, "b", 1), (5, "b", 1), (None, "b", 1)], key=str)
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert M.train(df, PIECES) is None
    assert M.predict(df, None).collect() == []
    one = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in M.predict(one, None).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = M.op5_language_id(spark, SF001).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)


@pytest.fixture(scope="module")
def large():
    """Two languages of a million and of 200 000 expected pieces, smoothed as ``fit`` does."""
    pieces = M.Pieces([*PIECES, *"cdefghijklmnopqrstuvwxyz"])
    expected = np.zeros((pieces.size + 1, 2))
    expected[:pieces.size] = np.random.default_rng(2).random((pieces.size, 2))
    expected = expected / expected.sum(0) * [1e6, 2e5]
    together = expected.sum(1) + 0.01
    smooth = expected + M.PRIOR * (together / together.sum())[:, None]
    return M.Model(pieces, ["x", "y"], smooth / smooth.sum(0))


def test_a_run_of_characters_not_seen_stays_in_range(large):
    for n in (20, 38, 44, 64):
        got = large.word_scores(["ไ" * n, "▁ab"])
        assert np.allclose(got[0], n * np.log(large.p[-1]), rtol=1e-9)
    mixed = large.word_scores(["ไ" * 50 + "abc" * 4])[0]
    assert np.allclose(mixed, 50 * np.log(large.p[-1]) + large.word_scores(["abc" * 4])[0], rtol=1e-9)


def test_one_such_run_does_not_decide_a_text(spark, large):
    rng = random.Random(5)
    pick = large.p[:-1, 0] / large.p[:-1, 0].sum()
    names = [*PIECES, *"cdefghijklmnopqrstuvwxyz"]
    text = " ".join("".join(rng.choices(names, pick, k=6)).replace("▁", "") for _ in range(2000))
    df = spark.createDataFrame([(1, text), (2, text + " " + "ไ" * 64), (3, "ไ" * 64)], "doc_id long, text string")
    out = {r.doc_id: r for r in M.predict(df, large).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "x"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_fitting_with_a_run_of_characters_of_one_language():
    words = ["▁ab", "▁abb", "ไ" * 64, "é" * 64]
    counts = np.array([[40_000_000, 0], [10_000_000, 50_000], [0, 1], [1, 0]], float)
    made = M.fit(M.Pieces([*PIECES, *(chr(0x4E00 + i) for i in range(30_000))]), ["x", "y"], words, counts)
    assert np.isfinite(made.p).all() and np.allclose(made.p.sum(0), 1)
    assert np.isfinite(made.word_scores(words)).all()


def test_logarithms_equal_scaled_sums(model, monkeypatch):
    words = ["▁" + w for w in ("abba", "ébab", "zz", "", "aabbaé")]
    counts = np.random.default_rng(3).integers(1, 5, (5, 2)).astype(float)
    scores, made = model.word_scores(words), M.fit(M.Pieces(PIECES), ["x", "y"], words, counts)
    monkeypatch.setattr(M, "FLOOR", np.inf)
    assert np.allclose(model.word_scores(words), scores, rtol=1e-12)
    assert np.allclose(M.fit(M.Pieces(PIECES), ["x", "y"], words, counts).p, made.p, rtol=1e-9)


def test_the_sample_is_bounded_whatever_ids_repeat(spark):
    """Null and repeated ids bring no more rows than the bound; repeated rows count once."""
    given = [(None, f"word{i} la la", "xx") for i in range(300)] + [(7, "the same text", "yy")] * 200 + [(i, f"text {i}", "yy") for i in range(50)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    vocabulary = ["<unk>", "▁", *"abcdefghijklmnopqrstuvwxyz0123456789"]
    assert M.train(df, vocabulary, 10).languages == ["xx", "yy"]
    out = {r.lang: r.n for r in M.sampled(df, 10).groupBy("lang").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert out == {"xx": 10, "yy": 10}
