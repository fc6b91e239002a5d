import duckdb

import corpus_pipeline as P
from helpers import SF001, near_classes, repeats_removed, rows, words
from sentiscope.llm import decontam, fm_quality, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _written(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark, scratch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    steps = dict(P.STAGES)
    assert list(steps) == ["quality_classifier", "ngram_join", "substring_dedup", "decontamination", "mixing"]

    model = fm_quality.train(docs, fm_quality.learnable(spark.read.parquet(f"{SF001}/labels.parquet")))
    one = _written(spark, steps["quality_classifier"](spark, docs, SF001), f"{scratch}/1")
    assert one.columns == COLUMNS
    assert rows(one, "doc_id") == rows(fm_quality.score(docs, model).where("score >= 0.5"), "doc_id")

    two = _written(spark, steps["ngram_join"](spark, one, SF001), f"{scratch}/2")
    classes = near_classes([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == COLUMNS and rows(two, "doc_id") == sorted(((c,) for c in {x[1] for x in classes}), key=str)

    three = _written(spark, steps["substring_dedup"](spark, two, SF001), f"{scratch}/3")
    cut = {d: (n, gone) for d, n, gone, _ in repeats_removed([(r.doc_id, r.text) for r in two.collect()], 20)}
    before = {r.doc_id: r for r in two.collect()}
    after = {r.doc_id: r for r in three.collect()}
    assert set(after) == {d for d, (n, gone) in cut.items() if not gone or gone < n}
    for d, r in after.items():
        assert len(words(r.text)) == cut[d][0] - cut[d][1]
        assert r.text == before[d].text if not cut[d][1] else r.n_chars == len(r.text)

    four = _written(spark, steps["decontamination"](spark, three, SF001), f"{scratch}/4")
    bad = {r.doc_id for r in decontam.contaminations(three, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()}
    assert four.columns == COLUMNS and {r.doc_id for r in four.collect()} == set(after) - bad

    five = _written(spark, steps["mixing"](spark, four, SF001), f"{scratch}/5")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{scratch}/4/*.parquet'")
    taken = {d: (size, t) for d, size, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    got = {}
    for r in five.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for d, (size, t) in taken.items():
        if size:
            assert got.get(d, 0) * size == t

    assert rows(P.run(spark, SF001), "doc_id", "copy") == rows(five, "doc_id", "copy")


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF001).count() == 0


def test_stages_take_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s", 0), (3, None, "en", None, None)], docs.schema)
    docs = docs.limit(40).union(docs.limit(5)).union(odd)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF001)
        assert out.columns[:5] == COLUMNS and out.count() > 0, name


def test_a_lost_run_goes_on_after_its_last_stage(spark, monkeypatch):
    import os
    import uuid
    from sentiscope.session import checkpoint_root
    done, run_id = [], uuid.uuid4().hex
    real = list(P.STAGES)

    def counted(name, stage, dies):
        def f(*a):
            done.append(name)
            if dies:
                raise RuntimeError("driver lost")
            return stage(*a)
        return f

    monkeypatch.setattr(P, "STAGES", [(n, counted(n, f, n == "decontamination")) for n, f in real])
    try:
        P.run(spark, SF001, run_id)
        raise AssertionError("not lost")
    except RuntimeError:
        pass
    assert done == [n for n, _ in real[:4]]
    monkeypatch.setattr(P, "STAGES", [(n, counted(n, f, False)) for n, f in real])
    out = P.run(spark, SF001, run_id, keep=False)
    assert done == [n for n, _ in real[:4]] + [n for n, _ in real[3:]]
    assert rows(out, "doc_id", "copy") == rows(P.run(spark, SF001), "doc_id", "copy")
    assert "mixing" in os.listdir(f"{checkpoint_root(spark)}/pipeline-{run_id}")
    assert "decontamination" not in os.listdir(f"{checkpoint_root(spark)}/pipeline-{run_id}")
    assert rows(P.run(spark, SF001, run_id), "doc_id", "copy") == rows(out, "doc_id", "copy") and len(done) == 4 + 2 + 5


def test_stages_leave_other_columns_alone(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    names = ["rate", "_source", "_h", "_id", "_th", "_lower", "batch", "rest", "row", "label", "rank"]
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF001)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), name
