import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helpers import SCHEMA, SF001, rows
from sentiscope.llm import alignment as M
from sentiscope.llm.encoders import byte_of_letter

A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "\n\n \t", "a▁b", "x<|endoftext|>y <s> </s>", "日本語のテキスト、漢字仮名交じり文。", "🙂🙂🏽 é ñ", "éé́", "0" * 300,
       "́̂̃̄̅̆" * 40, "ﷺ ﷺ ½ Ⅻ", "a" * 3000, "​‌﻿ x", "the the the the"]


def brute(given):
    """op11 by its definition, with the two libraries."""
    tk, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tk.encode_special_tokens = True
    letter, text_of = byte_of_letter(), {i: t for t, i in tk.get_vocab().items()}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for doc_id, text in given:
        a, b = (tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        sides = [bytes(letter[c] for c in text_of[i]) for i in a], [piece(i) for i in b]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            docs.append((doc_id, None))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side]):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        docs.append((doc_id, (len(a), len(b), groups, links)))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, made in docs:
        if made is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = made
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = M.op11_alignment(spark, SF001)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(out, *NAMES) == brute(given)


@pytest.mark.parametrize("options", [{}, {"digits": 5, "fan_in": 2, "batch_bytes": 400}, {"digits": 1, "fan_in": 3, "batch_bytes": 2000}])
def test_odd_texts_batches_and_levels_of_runs(spark, options):
    rng = random.Random(1)
    given = [(n, t) for n, t in enumerate(ODD)] + [(None, "the cat"), (None, None), (3, "the cat"), (3, "the cat")]
    given += [(100 + n, " ".join(rng.choice(["the", "cat", "sat", "naïve", "x1", "日本"]) for _ in range(rng.randint(1, 60)))) for n in range(40)]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 as batch", "2 as runs", "'x' as digit").repartition(6)
    assert rows(M.alignments(df, A, B, **options), *NAMES) == brute(given)


def test_empty_table(spark):
    out = M.alignments(spark.createDataFrame([], SCHEMA), A, B)
    assert out.columns == NAMES[:1] + list(M._NUMBERS) + ["n_best", "count_sum", "groups_sha256"] and out.collect() == []


def _random_runs(rng, k, size, sides):
    out = []
    for _ in range(k):
        keys = np.unique(np.array([rng.randrange(sides) << 32 | rng.randrange(50) for _ in range(rng.randint(0, size))], np.uint64))
        out.append((keys, np.array([rng.randint(1, 9) for _ in keys], np.int64)))
    return out


@pytest.mark.parametrize("k,size,sides,pool", [(0, 9, 3, 4), (1, 50, 4, 8), (9, 300, 20, 16), (9, 300, 1, 16), (30, 40, 40, 1 << 20)])
def test_merge_counts_sides_and_answers(monkeypatch, k, size, sides, pool):
    monkeypatch.setattr(M, "FRAME", 7)
    made = _random_runs(random.Random(k), k, size, sides)
    total, top = Counter(), {}
    for keys, counts in made:
        for key, n in zip(keys.tolist(), counts.tolist()):
            total[key] += n
    for key, n in total.items():
        top[key >> 32] = max(top.get(key >> 32, 0), n)
    runs = [M.Run(M.pack_run(*r)) for r in made]
    steps = list(M.merge(runs, pool))
    got = [key for s in steps for key in s[0].tolist()]
    assert got == sorted(total) and [n for s in steps for n in s[1].tolist()] == [total[x] for x in got]
    seen = [set((s[0] >> np.uint64(32)).tolist()) for s in steps]
    assert sum(map(len, seen)) == len(set().union(*seen)) if seen else True  # a side is never cut
    filled = [r for r in made if len(r[0])]
    answers = M._spread([M.Run(M.pack_run(*r)) for r in filled],
                        (((run, place, entry), (c, M.best_of_side(keys, c))) for keys, c, run, place, entry in M.merge([M.Run(M.pack_run(*r)) for r in filled], pool)))
    for (keys, _), raw in zip(filled, answers):
        counts, best = M.unpack_answer(raw)
        assert counts.tolist() == [total[x] for x in keys.tolist()]
        assert best.tolist() == [total[x] == top[x >> 32] for x in keys.tolist()]


@pytest.mark.parametrize("large", [0, 3, 64])
def test_groups_of_many_tokens_count_by_their_ids(monkeypatch, large):
    monkeypatch.setattr(M, "LARGE_GROUP", large)
    monkeypatch.setattr(M, "EXPAND", 50)
    rng = np.random.default_rng(large)
    na, nb = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
    ga, gb = np.repeat(np.arange(40), na), np.repeat(np.arange(40), nb)
    a, b, doc = rng.integers(0, 5, len(ga)), rng.integers(0, 5, len(gb)), np.repeat(np.arange(8), 5)
    want = Counter((int(doc[g]), int(x) << 32 | int(y)) for g in range(40) for x in a[ga == g] for y in b[gb == g])
    d, p, n = M._records(a, b, ga, gb, na, nb, doc)
    assert list(zip(d.tolist(), p.tolist())) == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]


def test_a_run_holds_a_common_pair_once_whatever_its_documents(spark):
    aligner = M.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    few, many = (M._batch_row(0, list(range(n)), M.align(aligner, ["the cat sat"] * n), 8).to_pylist()[0] for n in (2, 2000))
    entries = lambda row: sum(len(M.Run(r["run"]).frame()[0]) for r in row["runs"])
    assert entries(few) == entries(many)
