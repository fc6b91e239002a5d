import numpy as np
import pyarrow as pa

from helpers import SF001
from sentiscope.llm import fm_quality as M
from sentiscope.llm.common import fold


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    first, index, value = M.features(pa.array(["a b c A!! 1\nfoo", "x", None, "", "b b b b"]))
    m = M.Machine(0.3, rng.normal(size=M.N_FEATURES).astype("f"), rng.normal(size=(M.N_FEATURES, M.RANK)).astype("f"))
    z, _ = m.parts(first, index, value)
    for i in range(5):
        at = range(first[i], first[i + 1])
        want = m.bias + sum(m.weights[index[j]] * value[j] for j in at)
        want += sum(float(m.vectors[index[j]] @ m.vectors[index[k]]) * value[j] * value[k] for j in at for k in at if j < k)
        assert abs(want - z[i]) < 1e-3


def test_features_do_not_depend_on_neighbours():
    texts = ["one two two", None, "THREE!! 4 | 5", "", "x" * 10000, "one two two"]
    whole = M.features(pa.array(texts))
    for i, t in enumerate(texts):
        f, k, v = M.features(pa.array([t], pa.string()))
        a, b = whole[0][i], whole[0][i + 1]
        assert np.array_equal(whole[1][a:b], k) and np.allclose(whole[2][a:b], v)


def test_held_out_rows_are_told_apart(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/labels.parquet").collect()}
    out = M.op7_quality(spark, SF001.replace("0.001", "0.01")).collect()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_cases(spark):
    given = [(i, ("good words here. " if i % 2 else "BAD!! ") * (1 + i % 4)) for i in range(60)]
    given += [(100, None), (101, ""), (101, ""), (None, "good"), (102, "x " * 50000)]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as label", "2 as rank")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, None), (1, 5), (1, 1), (999, 1)], "doc_id long, quality int")
    model = M.train(docs, labels)
    out = M.score(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(given) and out.columns == ["doc_id", "text", "label", "rank", "score", "predicted"]
    assert all(got[i].predicted == i % 2 for i in range(60))
    assert got[100].score == got[101].score


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in M.score(docs, M.train(docs, none)).collect()] == [0.5, 0.5]
    assert M.score(docs.limit(0), M.train(docs.limit(0), none)).collect() == []


def test_the_held_out_fold_is_not_learned_from(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert M.learnable(labels).where(fold(3) == 1).count() == 0
    assert M.learnable(labels).count() + labels.where(fold(3) == 1).count() == 30
