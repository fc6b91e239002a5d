import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import SF001
from sentiscope.llm import token_counts as M

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        made = M.Transducer(f.read())
    library = Tokenizer.from_file(PATH)
    return made, lambda s: len(library.encode(s, add_special_tokens=False).ids)


def test_hand_picked_texts(pair):
    made, library = pair
    for s in ["", "   ", "Hello's world ''s 's's 123 ab12 !!?", "x<|startoftext|>y <|endoftext|>", "<|STARTOFTEXT|> <|startoftext|",
              "İstanbul ǅ ß ﬁ é é", "ΑΣ Σ ΑΣ.", "a\x1cb\x85c d", "don'T 'r 're 'rx 'v 'l 'll '' ''' 'a '1 x's' 'l'l'",
              "a" * 5000, "!" * 3000, "中文字 かな", "12 3.5 ½ Ⅷ"]:
        assert made.count(s) == library(s), s
    assert made.count(None) == 0


def test_random_texts(pair):
    made, library = pair
    rng = random.Random(0)
    for _ in range(3000):
        s = "".join(rng.choice("abcdeéß'stmdrvl '!?.,12<|>\n\tΣñ中ü") for _ in range(rng.randint(0, 25)))
        assert made.count(s) == library(s), s


def test_chunk_maps_compose_to_the_whole(pair, monkeypatch):
    made, library = pair
    rng = random.Random(2)
    for size in (1, 3, 7):
        monkeypatch.setattr(M, "CHUNK", size)
        for _ in range(200):
            s = "".join(rng.choice("ab's re 1!\n") for _ in range(rng.randint(0, 40)))
            assert made.count(s) == library(s), s


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(M, "RUNS", 5)
    monkeypatch.setattr(M, "PAIRS", 5)
    with open(PATH, encoding="utf-8") as f:
        made = M.Transducer(f.read(), states=5)
    text = "many different words come here and again many different words"
    assert made.count(text) == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


def test_operator(spark, pair):
    _, library = pair
    given = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "naïve"), (4, "word " * 3000)]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "1 as batch")
    out = M.count_tokens(df, PATH)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.batch) for r in out.collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(t or ""), library(t or "") > 2048, 1) for i, t in given), key=str)
    assert got == want
    assert M.count_tokens(df.limit(0), PATH).count() == 0


def test_query(spark, pair):
    _, library = pair
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in M.op1_token_counts(spark, SF001).collect():
        text = docs[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 2048)
