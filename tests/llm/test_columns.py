"""Columns of a caller whose names operators use themselves come through as they are."""

import public_tokenizers
import pytest

from helpers import SF001
from sentiscope.llm import decontam, fm_quality, langid, licenses, line_quality, mixing, ngram_join, substring_dedup, token_counts

NAMES = ("rate", "_source", "_h", "_id", "_th", "_lower", "batch", "rest", "row", "key", "of", "u", "place", "at", "h", "id", "worded", "single",
         "part", "lot", "m", "block", "copies_", "count")


def _emitters(spark, docs):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF001}/benchmark.parquet")
    vocabulary = langid.read_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    return {
        "mix": lambda d: mixing.mix(d), "mix_plan": lambda d: mixing.mix_plan(d), "drop_near_copies": lambda d: ngram_join.drop_near_copies(d),
        "remove_repeats": lambda d: substring_dedup.remove_repeats(d), "drop_contaminated": lambda d: decontam.drop_contaminated(d, benchmark),
        "score": lambda d: fm_quality.score(d, fm_quality.train(docs, labels)), "judge": lambda d: line_quality.judge(d), "scan": lambda d: licenses.scan(d),
        "count_tokens": lambda d: token_counts.count_tokens(d, str(public_tokenizers.path("word_bpe_49k.json"))),
        "predict": lambda d: langid.predict(d, langid.train(docs, vocabulary, 20)),
    }


@pytest.mark.parametrize("name", ["mix", "mix_plan", "drop_near_copies", "remove_repeats", "drop_contaminated", "score", "judge", "scan", "count_tokens", "predict"])
def test_clashing_names_come_through(spark, name):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("n_chars < 3000").limit(60)
    given = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])
    out = _emitters(spark, docs)[name](given)
    assert set(NAMES) <= set(out.columns)
    got = out.select("doc_id", *NAMES).collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)
    plain = _emitters(spark, docs)[name](docs)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain.select("doc_id").collect())
