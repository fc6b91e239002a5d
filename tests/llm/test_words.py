import random

import numpy as np
import pyarrow as pa

from helpers import words
from sentiscope.llm import words as K


def _texts(rng, n):
    kinds = [None, "", "  ", "\x1c"]
    return [rng.choice(kinds + ["".join(rng.choice("ab é\n\t\x1c ") for _ in range(rng.randint(0, 30)))] * 4) for _ in range(n)]


def test_words_and_windows_follow_their_definition():
    rng = random.Random(1)
    for _ in range(100):
        given = _texts(rng, rng.randint(0, 8))
        column = pa.array([None, *given, "x"], pa.string()).slice(1, len(given))
        first, starts, ends, h, data = K.words(column)
        got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
        assert got == [words(t) for t in given]
        flat = [w for t in given for w in words(t)]
        known = dict(zip(flat, h.tolist()))
        assert [known[w] for w in flat] == h.tolist() and len(set(known.values())) == len(known)
        for k in (1, 2, 5):
            assert [tuple(flat[i:i + k]) for i in K.inside(first, len(h), k)] == [
                tuple(w[i:i + k]) for w in map(words, given) for i in range(len(w) - k + 1)]


def test_huge_words_differ_by_their_far_characters():
    a, b = "x" * 9000, "x" * 8999 + "y"
    c = "y" + "x" * 8999
    _, _, _, h, _ = K.words(pa.array([f"q {a} {b}", f"{c} {a}"]))
    assert len(set(h.tolist())) == 4 and h[1] == h[4]


def test_pieces_cover_a_batch_in_order():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    cut = list(K.pieces(batch, most=20))
    assert pa.Table.from_batches(cut).column("text").to_pylist() == batch.column("text").to_pylist()
    assert np.sum([p.num_rows for p in cut]) == 5
