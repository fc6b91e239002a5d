from fractions import Fraction

from helpers import SF001, rows, same_as_sql, words
from sentiscope.llm import mixing as M


def _targets(sizes):
    """Resharing by its words: give what is left by weight, stop who is above, again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not above:
            return target | {s: weight[s] * unit for s in free}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= above
    return target


def test_query_equals_sql(spark):
    same_as_sql(M.op2_mixing(spark, SF001), M.SQL)


def _docs(spark):
    given = [(i, " ".join(["w"] * (i % 13)), None if i % 5 == 0 else "s" + "ab\U0001F600￮d"[i % 5]) for i in range(400)]
    given += [(None, "a b c", "sa"), (7, None, "sb"), (7, None, "sb"), (8, "", "only empty")]
    return given, spark.createDataFrame(given, "doc_id long, text string, source string")


def test_targets_by_repeated_resharing(spark):
    given, df = _docs(spark)
    sizes = {}
    for _, t, s in given:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    got = {r.source: r for r in M.source_targets(df).collect()}
    want = _targets(sizes)
    assert set(got) == set(want)
    for s, r in got.items():
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, r.target)


def test_plan_takes_floor_or_one_more_and_agrees_on_reruns(spark):
    given, df = _docs(spark)
    plan = M.mix_plan(df.selectExpr("*", "9 as size", "'x' as rate2"))
    got = plan.collect()
    assert len(got) == len(given)
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert r.copies in (int(rate), int(rate) + 1)
    keep = ("doc_id", "source", "taken")
    assert rows(plan, *keep) == rows(M.mix_plan(df), *keep)
    same_as_sql(M.mix_plan(df).select("doc_id", "size", "source_size", "target", "taken"), M.SQL, documents=df)


def test_taken_words_come_near_targets(spark):
    given = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(20000)]
    plan = M.mix_plan(spark.createDataFrame(given, "doc_id long, text string, source string"))
    for r in plan.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05


def test_mix_emits_the_copies(spark):
    _, df = _docs(spark)
    assert M.mix(df).count() == sum(r.copies for r in M.mix_plan(df).collect())
    assert M.mix(df).columns == ["doc_id", "text", "source", "copy"]


def test_empty_table_and_join_of_many_sources(spark, monkeypatch):
    _, df = _docs(spark)
    assert M.mix_plan(df.limit(0)).count() == 0
    want = rows(M.mix_plan(df), "doc_id", "taken")
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert rows(M.mix_plan(df), "doc_id", "taken") == want
