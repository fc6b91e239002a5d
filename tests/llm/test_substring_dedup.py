import hashlib
import random

import pyarrow as pa
import pytest

from helpers import SCHEMA, SF001, repeats_removed, rows, words
from sentiscope.llm import substring_dedup as M


def _digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(M.op3_substring_dedup(spark, SF001), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats_removed(docs, 20)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("window,seed", [(4, 1), (6, 2), (20, 3)])
def test_random_tables(spark, window, seed, monkeypatch):
    monkeypatch.setattr("sentiscope.llm.common.UNIT_BYTES", 64)
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("ab") for _ in range(25)) for _ in range(3)]
    given = []
    for _ in range(60):
        text = rng.choice([None, "", "  ", " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))), *passages,
                           rng.choice(passages) + "\n" + rng.choice(passages)])
        given.append((rng.choice([None, *range(12)]), text))
    given += given[:5]
    df = spark.createDataFrame(given, SCHEMA)
    assert _digest(M.remove_repeats(df, window)) == repeats_removed(given, window)


def test_a_long_text_and_a_hot_passage(spark):
    hot = " ".join(f"h{i}" for i in range(30))
    given = [(i, f"own{i} {hot} end{i}") for i in range(300)] + [(1000, " ".join(f"w{i % 5000}" for i in range(60000)))]
    got = _digest(M.remove_repeats(spark.createDataFrame(given, SCHEMA)))
    assert got == repeats_removed(given, 20)


def test_layout_spans_and_clashing_columns(spark):
    a = " ".join(f"w{i}" for i in range(24))
    given = [(1, f"top\n{a}"), (2, f"x  y\n{a}\nz"), (3, None), (4, " ")]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 as batch", "'n' as n_words", "array(1) as rest", "2 as part")
    out = {r.doc_id: r for r in M.remove_repeats(df, layout=True).collect()}
    assert set(out[1].asDict()) == {"doc_id", "batch", "rest", "part", "kept", "n_words", "n_removed", "removed"}
    assert out[1].kept == given[0][1] and out[2].kept == "x  y\nz" and out[3].kept is None and out[4].kept == " "
    assert [tuple(s) for s in out[2].removed] == [(2, 26)] and out[2].n_removed == 24
    assert out[2].batch == 1 and out[2].rest == [1] and out[2].part == 2


def test_a_batch_does_not_depend_on_the_order_of_its_rows():
    rng = random.Random(5)
    given = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", " ".join(rng.choice("abc") for _ in range(30))]), i) for i in range(40)]
    made = []
    for rows_ in (given, given[::-1]):
        t = pa.table({"doc_id": pa.array([r[0] for r in rows_], pa.int64()), "text": pa.array([r[1] for r in rows_], pa.string()),
                      "rest": pa.array([{"n": r[2]} for r in rows_])})
        b = M._Batch(t, 4, 3)
        made.append((b.first.tolist(), b.hashes.tolist(), [x.tolist() for x in b.windows(b.probes()[0][:5])]))
    assert made[0] == made[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.remove_repeats(df).collect() == []


def test_odd_window_is_refused(spark):
    with pytest.raises(ValueError):
        M.remove_repeats(spark.createDataFrame([], SCHEMA), 7)


def test_words_cut():
    assert words("a\x1cb c") == ["a\x1cb", "c"]


@pytest.mark.parametrize("total", [0, 10 ** 8, 3 * 10 ** 10, 10 ** 12, 10 ** 14])
def test_messages_keep_their_size_whatever_the_input(total):
    batches, parts = M.sizes(total, 200)
    if total >= 10 ** 10:
        words_of_a_batch = total / batches / 6
        assert words_of_a_batch / parts >= 60  # entries of a message
        assert total / batches <= 120 << 20 and total / parts <= 360 << 20  # what one task holds at 100 TB
        assert batches * parts * 6 * 60 <= total  # messages of all batches against the input
    else:
        assert batches >= 200 and parts >= 200


def test_repeats_of_a_row_are_judged_once(spark):
    hot = " ".join(f"h{i}" for i in range(30))
    given = [(5, f"x {hot}")] * 300 + [(None, hot)] * 40 + [(2, f"{hot} y"), (9, None), (9, None), (9, ""), (7, "a b")]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "monotonically_increasing_id() as rest", "1 as h", "2 as of", "3 as single", "4 as id").repartition(5)
    out = M.remove_repeats(df)
    assert _digest(out.fillna("", ["kept"])) == repeats_removed(given, 20)
    assert len({r.rest for r in out.collect()}) == len(given) and {(r.h, r.of, r.single, r.id) for r in out.collect()} == {(1, 2, 3, 4)}


def test_windows_differ_by_both_halves_of_their_hash():
    t = pa.table({"doc_id": pa.array([1]), "text": pa.array([" ".join(f"w{i}" for i in range(30))])})
    b = M._Batch(t, 4, 3)
    h, g, *_ = b.windows(b.probes()[0][:20])
    assert len(set(h.tolist())) == len(set(g.tolist())) == 20 and not set(h.tolist()) & set(g.tolist())
