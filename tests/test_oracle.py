"""Driver contract: entry smoke check and every registered query against its DuckDB oracle."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import digest  # noqa: E402

from sentiscope.plans.catalog import QUERIES  # noqa: E402

from conftest import SF001, SF01  # noqa: E402

# an optimiser's fit and its wall times have no SQL
SLOW = {"train_logistic"}
# the queries of the optional subpackage have tests of their own
KEYS = sorted(QUERIES)
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from sentiscope.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "positive_count", "negative_count", "neutral_count", "reputation_index"]
    assert df.count() > 0


def test_every_key_has_an_oracle_or_is_a_known_rows_check():
    assert set(KEYS) - set(ORACLE) == SLOW


def test_every_oracle_is_text_of_a_registered_query():
    made = entry.oracle_sql()
    assert {k for k, v in made.items() if not isinstance(v, str)} == set()
    assert set(made) <= set(entry.queries())


@pytest.mark.parametrize("key", [k for k in KEYS if k in ORACLE])
def test_query_matches_oracle(spark, duck, key):
    sdf = entry.queries()[key](spark, SF01)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_logistic_training_shape(spark):
    r, = entry.queries()["train_logistic"](spark, SF001).collect()
    assert 0.0 <= r.eval_accuracy <= 1.0 and r.eval_samples_per_second > 0 and r.test_rows > 0
