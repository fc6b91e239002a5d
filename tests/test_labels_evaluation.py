"""Labels, splits, metrics, quality: D10-D12, D21, D24 and split properties."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from sentiscope.functions.labels import argmax, canonical_label
from sentiscope.operators import evaluation as ev
from sentiscope.operators import labelling as lab
from sentiscope.operators import quality as qa
from sentiscope.operators import review as rv


def test_nine_spellings_and_unknown(spark):
    vals = ["negative", "neutral", "positive", "0", "1", "2", "0.0", "1.0", "2.0", "3", "bad", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(canonical_label(F.col("v"))).collect()]
    assert got == [0, 1, 2, 0, 1, 2, 0, 1, 2, None, None, None]


def test_training_labels_feedback_wins_and_unmapped_dropped(spark):
    df = spark.createDataFrame(
        [("1", "positive", "0"), ("2", "negative", None), ("3", "neutral", "2.0"), ("4", "meh", None),
         ("5", None, "1")],
        "id string, sentiment string, user_feedback string")
    got = {r.id: r.label for r in lab.training_labels(df).collect()}
    assert got == {"1": 0, "2": 0, "3": 2}  # D11 feedback first, D12 '4' dropped, FLT-02 '5' unscored


def test_split_sizes_are_exact_and_add_up(spark):
    for n in (1, 7, 70, 180, 215, 256, 1003):
        df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("label"))
        sizes = {r.split: r.n for r in lab.split_sizes(lab.train_val_test_split(df)).collect()}
        t = math.ceil(0.2 * n)
        v = math.ceil(0.1 * (n - t))
        assert sizes.get("test", 0) == t and sizes.get("validation", 0) == v
        assert sizes.get("train", 0) == n - t - v and sizes[None] == n


def _by_global_order(rows, seed, test, val):
    """The split by its definition: sort by md5(key || seed), cut by position."""
    order = sorted(rows, key=lambda k: hashlib.md5(f"{k}{seed}".encode()).hexdigest())
    n = len(order)
    t = math.ceil(test * n)
    v = math.ceil(val * (n - t))
    return {**{k: "test" for k in order[:t]}, **{k: "validation" for k in order[t:t + v]}, **{k: "train" for k in order[t + v:]}}


def test_split_equals_one_global_order(spark):
    for n, test, val in ((0, 0.2, 0.1), (1, 0.2, 0.1), (500, 0.2, 0.1), (3000, 0.5, 0.999), (300, 0.0, 0.0), (300, 1.0, 0.5), (300, 0.0, 0.3)):
        df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("split_"))
        got = {r.id: r.split for r in lab.train_val_test_split(df, "id", 7, test, val).collect()}
        assert got == _by_global_order([str(i) for i in range(n)], 7, test, val)


def test_stratified_split_equals_one_order_in_each_class(spark):
    rows = [(str(i), (None, "a", "b", "b", "c")[i % 5] if i else "single") for i in range(800)]
    df = spark.createDataFrame(rows, "id string, label string")
    got = {r.id: r.split for r in lab.train_val_test_split(df, "id", 42, 0.2, 0.1, "label").collect()}
    want = {}
    for c in {r[1] for r in rows}:
        want |= _by_global_order([i for i, x in rows if x == c], 42, 0.2, 0.1)
    assert got == want


def test_split_exchanges_no_rows(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
    plan = lab.train_val_test_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_a_cut_inside_rows_that_are_all_alike_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lab, "CHUNK", 7)
    for rows in ([("k", 1)] * 100, [("k", 1)] * 50 + [("k", 2)] * 50, [(None, 1)] * 30 + [("z", i) for i in range(30)], [("a", 1)] * 3):
        df = spark.createDataFrame(rows, "id string, label int").repartition(4)
        out = lab.train_val_test_split(df).collect()
        t = math.ceil(0.2 * len(rows))
        v = math.ceil(0.1 * (len(rows) - t))
        assert Counter(r.split for r in out) == {k: c for k, c in (("test", t), ("validation", v), ("train", len(rows) - t - v)) if c}
        assert Counter((r.id, r.label) for r in out) == Counter(rows)


def test_log_split_rule_matches_reference_runs():
    # validation = ceil(0.1 * rows left after the test cut): 7 of 70, 18 of 180, 22 of 215, 26 of 256
    for n, v in ((70, 7), (180, 18), (215, 22), (256, 26)):
        assert math.ceil(0.1 * n) == v


def test_metrics_on_known_predictions(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 2, 2), (5, 2, 0), (6, 1, 1)]
    p = spark.createDataFrame(rows, "id long, label int, pred int")
    assert abs(ev.accuracy(p).first().accuracy - 4 / 6) < 1e-12
    # per-class F1: c0 2*1/(2+2)=0.5, c1 2*2/(2+3)=0.8, c2 2*1/(2+1)=2/3
    assert abs(ev.macro_f1(p).first().macro_f1 - round((0.5 + 0.8 + 2 / 3) / 3, 6)) < 1e-9
    cm = {(r.label, r.pred): r.share for r in ev.confusion_matrix(p).collect()}
    assert cm[(0, 0)] == 0.5 and cm[(1, 1)] == 1.0
    r = ev.misclassification_rate(p).first()
    assert (r.wrong, r.total, r.wrong_percent) == (2, 6, 33.33)
    assert [x.id for x in ev.misclassified(p).collect()] == [2, 5]


def test_f1_counts_classes_seen_only_in_predictions(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 0, 2)], "id long, label int, pred int")
    r = ev.macro_f1(p).first()
    assert r.classes == 2 and abs(r.macro_f1 - round((2 / 3 + 0.0) / 2, 6)) < 1e-9


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0, 1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in df.select(argmax(F.col("s"))).collect()] == [1, 0]


def test_review_queue_threshold_strict_and_ties_by_id(spark):
    rows = [("b", "positive", 0.5, None), ("a", "positive", 0.5, None), ("c", "neutral", 0.8, None),
            ("d", "neutral", 0.1, "1"), ("e", None, None, None), ("f", "negative", 0.79, None)]
    df = spark.createDataFrame(rows, "id string, sentiment string, confidence double, user_feedback string")
    assert [r.id for r in rv.review_queue(df, 0.8, 2).collect()] == ["a", "b"]
    assert [r.id for r in rv.review_queue(df, 0.8, 50).collect()] == ["a", "b", "f"]


def test_quality_report_flags(spark):
    rows = [(0,)] * 20 + [(1,)] * 30 + [(2,)] * 16 + [(None,)] * 2
    r = qa.quality_report(spark.createDataFrame(rows, "label int")).first()
    assert (r.rows, r.unmapped, r.classes, r.min_class, r.max_class) == (68, 2, 3, 16, 30)
    assert r.not_empty and not r.all_mapped and r.multi_class and r.min_class_ok and r.balanced
    r2 = qa.quality_report(spark.createDataFrame([(0,)] * 200 + [(1,)] * 3, "label int")).first()
    assert not r2.min_class_ok and not r2.balanced


def test_distribution_matrix_margins(spark):
    rows = [("1", 0, "train"), ("2", 0, "test"), ("3", 1, "train"), ("4", 2, "validation")]
    df = spark.createDataFrame(rows, "id string, label int, split string")
    m = {r.label: r for r in lab.distribution_matrix(df).collect()}
    assert (m[0].train, m[0].test, m[0].total) == (1, 1, 2)
    assert (m[None].train, m[None].validation, m[None].test, m[None].total) == (2, 1, 1, 4)


def test_model_scorer_shape(spark):
    from sentiscope.operators import training as tr
    rows = [(str(i), t, float(lbl), "train") for i, (t, lbl) in enumerate(
        [("good great love", 2), ("bad awful hate", 0), ("the a an", 1)] * 10)]
    df = spark.createDataFrame(rows, "id string, text string, label double, split string")
    model = tr.featurizer(1 << 10).fit(df)
    lr = tr.classifier(0.0, 20).fit(model.transform(df))
    from pyspark.ml import PipelineModel
    full = PipelineModel(stages=list(model.stages) + [lr])
    out = {r.id: r for r in tr.score_with_model(full, df).collect()}
    assert out["0"].sentiment == "positive" and out["1"].sentiment == "negative"
    assert all(0.0 <= r.confidence <= 1.0 for r in out.values())


def test_split_survives_a_key_copied_into_a_third_of_the_rows(spark):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        (F.col("id") % 3).cast("int").alias("label")).repartition(7)
    sizes = {x.split: x.n for x in lab.split_sizes(lab.train_val_test_split(df)).collect()}
    assert sizes["test"] == 600 and sizes["validation"] == 240 and sizes["train"] == 2160


def test_scorers_golden_sentences(spark):
    from sentiscope.operators.scoring import lexicon_scores, score_posts
    rows = [("neg", "My order was lost again and the refund is late. Worst service."),
            ("pos", "I love this phone, the camera is amazing and the battery is great!")]
    df = spark.createDataFrame(rows, "id string, text string")
    for scored in (score_posts(df), lexicon_scores(df)):
        got = {r.id: (r.sentiment, r.confidence) for r in scored.collect()}
        assert got["neg"][0] == "negative" and got["pos"][0] == "positive"
        assert all(0.0 < c <= 1.0 for _, c in got.values())


def test_naive_bayes_by_hand(spark):
    from sentiscope.operators.naive_bayes import predict_split
    rows = [("1", "good good day", 2, "train"), ("2", "bad day", 0, "train"), ("3", "bad bad", 0, "train"),
            ("4", "good", 2, "test"), ("5", "bad day", 2, "test"), ("6", "unknown", 1, "test"), ("7", None, 0, "test")]
    df = spark.createDataFrame(rows, "id string, text string, label int, split string")
    got = {r.id: (r.label, r.pred) for r in predict_split(df).collect()}
    # class 0 has two of three rows and four words, class 2 one row and three; three words in all
    assert got["4"] == (2, 2) and got["5"] == (2, 0) and got["6"][1] == 0 and set(got) == {"4", "5", "6", "7"}
    assert predict_split(df.limit(0)).collect() == []


def _bayes(rows, alpha, target):
    """Naive Bayes by its formulas: {id: (label, pred, p_true)}."""
    train = [r for r in rows if r[3] == "train"]
    labels = sorted({r[2] for r in train})
    counts = {c: Counter(w for r in train if r[2] == c for w in (r[1] or "").split()) for c in labels}
    v = len({w for c in labels for w in counts[c]})
    out = {}
    for i, text, label, split in rows:
        if split != target:
            continue
        s = {c: math.log(sum(r[2] == c for r in train)) + sum(
            math.log((counts[c][w] + alpha) / (sum(counts[c].values()) + alpha * v)) for w in (text or "").split()) for c in labels}
        m = max(s.values())
        z = sum(math.exp(x - m) for x in s.values())
        out[i] = (label, min(c for c in labels if s[c] == m), math.exp(s[label] - m) / z if label in s else 0.0)
    return out


def test_naive_bayes_settings_probabilities_and_reload(spark, scratch):
    import random
    from sentiscope.operators import naive_bayes as nb
    rng = random.Random(2)
    rows = [(str(i), " ".join(rng.choice("abcdefgh"[c:c + 5]) for _ in range(rng.randint(0, 8))) or None, c if i % 40 else 3, ("train", "train", "validation", "test")[i % 4])
            for i, c in ((i, rng.randrange(3)) for i in range(200))]
    df = spark.createDataFrame(rows, "id string, text string, label int, split string")
    pred = nb.predict(nb.fit(df.where("split = 'train'")), df.where("split = 'validation'"), nb.SETTINGS)
    for k, a in enumerate(nb.SETTINGS):
        want = _bayes(rows, a, "validation")
        got = {r.id: r for r in pred.where(F.col("setting") == k).collect()}
        assert set(got) == set(want)
        for i, (label, p, own) in want.items():
            assert got[i].label == label and abs(got[i].p_true - own) < 1e-9 and (got[i].pred == p or abs(own - 0.5) < 1e-9)
    model, result = nb.train_evaluate(df)
    tried = {r.setting: r for r in nb.metrics(pred).collect()}
    assert result["val_f1"] == max(r.eval_f1 for r in tried.values()) and result["smoothing"] in nb.SETTINGS
    nb.save_model(model, f"{scratch}/model")
    again, smoothing = nb.load_model(spark, f"{scratch}/model")
    test = df.where("split = 'test'")
    one, two = (sorted((r.id, r.label, r.pred, round(r.p_true, 9)) for r in nb.predict(m, test, (smoothing,)).collect()) for m in (model, again))
    assert one == two and smoothing == result["smoothing"]
    done = nb.metrics(nb.predict(again, test, (smoothing,))).first()
    assert (done.eval_loss, done.eval_accuracy, done.eval_f1, done["rows"]) == tuple(result[k] for k in ("eval_loss", "eval_accuracy", "eval_f1", "test_rows"))
    empty = nb.train_evaluate(df.limit(0))[1]
    assert empty["test_rows"] == 0 and empty["eval_accuracy"] is None
