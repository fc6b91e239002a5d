import math
import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import SCHEMA, SF001, rows
from sentiscope.llm import packing as M
from sentiscope.llm.encoders import ByteLevel

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
ODD = ["", "x<|endoftext|>y <|endoftext|>", "été    naïve\t\n\n", "日本語テキスト 123", "🙂🙂", "  a   b ", "it's we'll I'd", " 　x", "a" * 5000]


def cut(given, capacity):
    """Pieces by the tokenizers library: (doc_id, piece, start, length, crc)."""
    t = Tokenizer.from_file(FILE)
    out = []
    for doc_id, text in given:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def held(df, given, capacity=1024):
    """The pieces are right, and sequences hold them without gaps; the number of sequences."""
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == cut(given, capacity)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    return len(by)


def test_query_is_near_the_bound(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = M.op12_packing(spark, SF001)
    assert out.columns == NAMES
    lengths = [c[3] for c in cut(given, 1024)]
    assert held(out, given) <= math.ceil(sum(lengths) / 1024) + 1


def test_encoder_equals_the_library():
    t = Tokenizer.from_file(FILE)
    special, plain = (ByteLevel(open(FILE, encoding="utf-8").read(), special=s) for s in (True, False))
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1FAFF), 10, 32]))
                           for _ in range(200)) for _ in range(200)]
    for x in texts:
        assert special.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids
    t.encode_special_tokens = True
    for x in texts:
        ids = plain.ids(x).tolist()
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert b"".join(plain.bytes[i] for i in ids) == x.encode()


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        ByteLevel(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), special=True)


def test_fields_levels_and_odd_rows(spark):
    rng = random.Random(2)
    given = [(i, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.choice([3, 9, 20, 100])))) for i in range(150)]
    given += [(None, None), (7, None), (None, "x y"), *[(8, t) for t in ODD], *given[:40], *[(9, "a b c")] * 60]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 as row", "2 as length", "3 as field").repartition(5)
    made = M.pieces(df, FILE, 32)
    n = held(M.pack(made, 32, field=30), given, 32)
    total = sum(c[3] for c in cut(given, 32))
    assert n <= math.ceil(total / 32) * 1.03


def test_empty_table(spark):
    out = M.pack(M.pieces(spark.createDataFrame([], SCHEMA), FILE))
    assert out.columns == NAMES and out.collect() == []


def test_pieces_are_cut_from_the_end():
    assert M.cuts(1, 4) == [(0, 1)] and M.cuts(4, 4) == [(0, 4)] and M.cuts(9, 4) == [(0, 1), (1, 5), (5, 9)] and M.cuts(8, 4) == [(0, 4), (4, 8)]


def least_bins(lengths, capacity):
    for k in range(1, len(lengths) + 1):
        for at in product(range(k), repeat=len(lengths)):
            if all(sum(n for n, b in zip(lengths, at) if b == j) <= capacity for j in range(k)):
                return k
    return 0


def test_bound_and_search_against_all_packings():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 10) for _ in range(rng.randint(0, 6))), reverse=True)
        best = least_bins(lengths, 10)
        a = np.array(lengths, np.int64)
        assert M.lower_bound(a, 10) <= best
        if lengths:
            assert M.score(M.evolve(a, 10, [], 1)[0], a, 10)[0] == best


@pytest.mark.parametrize("low,high", [(1, 1023), (200, 500), (300, 380), (512, 1000)])
def test_children_are_packings_and_improve(low, high):
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(low, high + 1, 500))[::-1].copy()
    first = M._fresh(lengths, 1024, rng, 0.0)
    grown = M.evolve(lengths, 1024, [], 5)
    for s in [first, *grown, M.crossover(grown[0], first, lengths, 1024, rng), M.mutate(first, lengths, 1024, rng)]:
        fill = M._fills(s, lengths)
        assert len(s) == 500 and fill.min() > 0 and fill.max() <= 1024 and fill.sum() == lengths.sum()
    assert M.score(grown[0], lengths, 1024) <= M.score(first, lengths, 1024)
    if low in (200, 300):
        assert M.score(grown[0], lengths, 1024)[0] < M.score(first, lengths, 1024)[0]


def test_a_child_keeps_the_whole_bins_it_is_given():
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(100, 701, 60))[::-1].copy()
    a, b = (M._fresh(lengths, 1024, rng, 0.2) for _ in range(2))
    child = M.crossover(a, b, lengths, 1024, rng)
    bins = lambda s: {tuple(np.flatnonzero(s == j)) for j in range(s.max() + 1)}
    assert len(bins(child) & bins(a)) > 5


def test_reruns_agree(spark):
    one, two = (rows(M.op12_packing(spark, SF001), *NAMES) for _ in range(2))
    assert one == two


def test_migrants_reach_the_next_island(spark):
    rng = random.Random(7)
    problems = spark.createDataFrame([(f, sorted((rng.randint(200, 500) for _ in range(300)), reverse=True)) for f in range(3)],
                                     "field long, lengths array<int>")
    one = {r.field: r.bins for r in M.solve(problems, 3, islands=2, epochs=1).collect()}
    three = {r.field: r.bins for r in M.solve(problems, 3, islands=2, epochs=3).collect()}
    assert set(one) == {0, 1, 2} and all(three[f] <= one[f] for f in one)
