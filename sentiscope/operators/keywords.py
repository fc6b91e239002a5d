"""Keyword match by a walk over prefixes (JON-06, FLT-07): one way for a list of any length.

From every place of a text the bytes are read on for as long as they are the beginning of some keyword. Two
sets decide that, the beginnings of keywords and the whole keywords, and both are kept as one Bloom
filter of bounded size:

1. the filter is made of the list (one pass over the list; tasks send words of bits, which are joined by ``or``);
2. the texts are read once. A step takes one more byte of all places that are still beginnings, so most places are left
   after a few bytes, and the work does not grow with the list. Bytes that may be a whole keyword are sent once for each
   text, and those of several texts of a task together in one row;
3. these rows meet the list in a join on the bytes, which drops what only the filter took for a keyword. So what is
   sent is the result and little else.

No list of keywords reaches a task or the driver. What is broadcast is the filter, at most ``MOST_BITS`` bits whatever
the list; of a longer list more is sent for nothing, and the join still decides. The ids of a keyword that is in very many
texts go to several places.

Bytes are those of UTF-8: a run of bytes that is contained is a run of characters that is contained, as UTF-8
cannot be misread from the middle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts whose ids go to one place, at most about.
SPLIT = 4_000_000
#: Bytes of text that are handled at once, and places in them that are walked at once.
PIECE, BLOCK = 4 << 20, 1 << 18
#: Bytes that a code holds as they are; of longer runs it is a hash.
EXACT = 8
#: Every beginning up to this length is in the filter, of longer ones those whose length is a power of two.
DENSE = 16
BITS, LEAST_BITS, MOST_BITS = 16, 16, 28  # bits for each entry; the filter's size as a power of two
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0]:o[-1]]


def _pieces(batch: pa.RecordBatch, column: str):
    first = 0
    offsets, _ = _flat(batch.column(column))
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _longer(code: np.ndarray, byte: np.ndarray, size: int) -> np.ndarray:
    """The codes of runs of ``size`` bytes, from those of all but their last."""
    if size <= EXACT:
        return code << np.uint64(8) | byte
    x = (code ^ code >> np.uint64(29)) * _MIX[0] + byte
    return x ^ x >> np.uint64(32)


def _slots(code: np.ndarray, size: int, kind: int, bits: int) -> np.ndarray:
    """Place in the filter: of a beginning (kind 0) and, twice, of a whole keyword (1 and 2)."""
    x = (code + np.uint64(4 * size + kind)) * _MIX[kind]
    x = (x ^ x >> np.uint64(32)) * _MIX[(kind + 1) % 3]
    return x >> np.uint64(64 - bits)


def _in(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _beginnings(size: int) -> bool:
    """Whether the filter holds the beginnings of this length."""
    return size <= DENSE or size & (size - 1) == 0


def _enter(bits: int):
    """The filter's entries of keywords, as words of 64 bits that are not 0."""
    def enter(batches):
        for batch in batches:
            offsets, raw = _flat(batch.column("kb"))
            start, length = offsets[:-1], np.diff(offsets)
            code, slots = np.zeros(len(length), np.uint64), []
            for size in range(1, int(length.max(initial=0)) + 1):
                on = length >= size
                start, length = start[on], length[on]
                code = _longer(code[on], raw[start + size - 1], size)
                if _beginnings(size):
                    slots.append(_slots(code[length > size], size, 0, bits))
                slots += [_slots(code[length == size], size, kind, bits) for kind in (1, 2)]
            if slots:
                slots = np.unique(np.concatenate(slots))
                word, first = np.unique(slots >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])
    return enter


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the runs of ``size`` bytes at two places are equal."""
    same = np.ones(len(a), bool)
    for k in range(size):
        same &= raw[a + k] == raw[b + k]
    return same


def _once(raw: np.ndarray, at: np.ndarray, row: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
    """Indexes of runs, of those that a text has several times fewer."""
    slot = ((code + row.view(np.uint64) * _MIX[1]) * _MIX[0] >> np.uint64(64 - 19)).view(np.int64)
    own = np.arange(len(at), dtype=np.int32)
    table = np.empty(1 << 19, np.int32)
    table[slot] = own
    first = table[slot]
    again = np.flatnonzero((first != own) & (row[first] == row) & (code[first] == code))
    if size > EXACT and len(again):
        again = again[_same(raw, at[again], at[first[again]], size)]
    keep = np.ones(len(at), bool)
    keep[again] = False
    return np.flatnonzero(keep)


def _walk(offsets: np.ndarray, raw: np.ndarray, words: np.ndarray, bits: int, most: int) -> dict[int, list]:
    """By length, (place, row, code) of the runs of bytes that the filter takes for keywords."""
    found: dict[int, list] = {}
    for begin in range(0, len(raw), BLOCK):
        at = np.arange(begin, min(begin + BLOCK, len(raw)))
        row = np.searchsorted(offsets, at, side="right") - 1
        room = offsets[row + 1] - at
        code = np.zeros(len(at), np.uint64)
        for size in range(1, most + 1):
            if size > 1:
                on = room >= size
                if _beginnings(size - 1):
                    on &= _in(words, _slots(code, size - 1, 0, bits))
                on = np.flatnonzero(on)
                at, row, room, code = at[on], row[on], room[on], code[on]
            if not len(at):
                break
            code = _longer(code, raw[at + (size - 1)], size)
            hit = np.flatnonzero(_in(words, _slots(code, size, 1, bits)))
            hit = hit[_in(words, _slots(code[hit], size, 2, bits))]
            if len(hit):
                hit = hit[_once(raw, at[hit], row[hit], code[hit], size)]
                found.setdefault(size, []).append((at[hit], row[hit], code[hit]))
    return found


def _around(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes raw[lo:hi] of each row."""
    n = hi - lo
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - lo, n)
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[at]))]).cast(pa.binary())


def _occur(shared):
    """(bytes, place, ids) of what may be keywords in the texts of a piece."""
    def occur(batches):
        words, bits, most = shared.value
        for batch in batches:
            for piece in _pieces(batch, "lc"):
                offsets, raw = _flat(piece.column("lc"))
                places = piece.column("place").to_numpy()
                for size, parts in _walk(offsets, raw, words, bits, most).items():
                    at, row, code = (np.concatenate(x) for x in zip(*parts))
                    order = np.lexsort((code, places[row]))  # stable: texts stay in order
                    if size > EXACT:
                        even = np.flatnonzero(code[order[1:]] == code[order[:-1]])
                        if not _same(raw, at[order[even + 1]], at[order[even]], size).all():  # by chance
                            code = _around(raw, at, at + size).dictionary_encode().indices.to_numpy()
                            order = np.lexsort((code, places[row]))
                    at, row, code = at[order], row[order], code[order]
                    new = np.append(True, (code[1:] != code[:-1]) | (places[row[1:]] != places[row[:-1]]))
                    keep = new | np.append(True, row[1:] != row[:-1])  # a text that comes again, in another block
                    at, row, new = at[keep], row[keep], new[keep]
                    first = np.flatnonzero(new)
                    for i in range(0, len(first), 1 << 16):
                        f = first[i:i + (1 << 16)]
                        end = first[i + len(f)] if i + len(f) < len(first) else len(at)
                        ids = piece.column("id").take(pa.array(row[f[0]:end]))
                        yield pa.RecordBatch.from_arrays([
                            _around(raw, at[f], at[f] + size), pa.array(places[row[f]]),
                            pa.ListArray.from_arrays(pa.array(np.append(f, end) - f[0], pa.int32()), ids)], names=["kb", "place", "ids"])
    return occur


def match(texts: DataFrame, keywords: DataFrame, split: int = SPLIT) -> DataFrame:
    """``keyword`` and ``id`` for every keyword contained in the text of an id, once each. ``texts``: ``id``, ``lc`` (lower case);
    ``keywords``: ``keyword``, distinct and not empty."""
    spark = texts.sparkSession
    texts = texts.where(F.length("lc") > 0).select("id", "lc")
    keywords = keywords.select("keyword", F.col("keyword").cast("binary").alias("kb"))
    size = F.octet_length("kb")
    most, entries = keywords.agg(F.max(size), F.sum(F.least(size, F.lit(DENSE)) + F.log2(size) + 2)).first()
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS * (entries or 1)).bit_length()))
    made = (keywords.select("kb").mapInArrow(_enter(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
            .toArrow())  # at most 2 ** (MOST_BITS - 6) rows
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[made.column("word").to_numpy()] = made.column("value").to_numpy().view(np.uint64)
    copies = texts.groupBy("id").count().agg(F.sum("count").alias("n"), F.count("*").alias("ids")).first()
    places = (copies.n or 0) // split + 1
    texts = texts.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(places)))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(_occur(spark.sparkContext.broadcast((words, bits, most or 0))), f"kb binary, place long, ids array<{kind}>")
    spread = keywords.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))))
    key = ["kb", "place"]
    if copies.n == copies.ids:
        return found.join(spread, key).select("keyword", F.explode("ids").alias("id"))
    # an id that comes in several rows counts once; it has one place, so this takes no further exchange
    pair = found.repartition(*key).join(spread.select(*key), key).select(*key, F.explode("ids").alias("id")).distinct()
    return pair.select(F.col("kb").cast("string").alias("keyword"), "id")
