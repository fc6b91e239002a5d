"""Token ids by public tokenizer files, inside Spark tasks.

A byte-level BPE file of the ``tokenizers`` library is read for its vocabulary and encoded by
``tiktoken``, which gives the same ids several times faster; files of another kind are refused. A file's
text is read on the driver and sent to the tasks, which keep one encoder for each worker process.
"""

from __future__ import annotations

import json

import numpy as np

#: The published cutting pattern of byte-level BPE.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others take the letters from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteLevel:
    """Encoder of a byte-level BPE file. ``special``: strings of special tokens inside texts become
    their ids (the library's default) or are ordinary text."""

    def __init__(self, text: str, special: bool):
        import tiktoken
        file = json.loads(text)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
                or not cut.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout")):
            raise ValueError("not a plain byte-level BPE file")
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        letters = byte_of_letter()
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
        if made != sorted(made) or any(len(t) > 1 and i < made[0] for t, i in ranks.items()):
            raise ValueError("the order of the merges is not the order of the ids")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in file.get("added_tokens", [])):
            raise ValueError("special tokens that take their surroundings along")
        self.bytes = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in added.items()}
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._special = "all" if special else set()

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special=self._special, disallowed_special=())


class Pieces:
    """Encoder of a sentencepiece model."""

    def __init__(self, raw: bytes):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = {}
        for i in range(self._model.get_piece_size()):
            p = self._model.id_to_piece(i)
            self.bytes[i] = bytes([int(p[1:-1], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


_made: dict = {}


def kept(name: str, content, build):
    """``build(content)``, made once in each worker process for a name and content."""
    key = name, hash(content)
    if key not in _made:
        for old in [k for k in _made if k[0] == name]:
            del _made[old]
        _made[key] = build(content)
    return _made[key]
