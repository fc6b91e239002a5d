"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared by their plain words: compatibility forms are made one (NFKC), letters lower
case, and punctuation and symbols separate words like white space does. A text is
contaminated by an item if it holds the item's words with at most
``floor(error * words)`` word insertions, deletions or replacements (k). An item is split into
k + 1 pieces of nearly equal length; k edits leave one piece whole, so every match
contains an exact piece. Texts are scanned for the first words of any piece, and
around each hit the whole item is verified with Myers' bit-parallel distance, one bit
for each of its words. Items of short pieces (all have fewer than 8 words) are scanned for
by a width of their own, so that they do not shorten the pieces that the others are found by.

Items are a stated query set: they are taken in blocks of bounded size, by a hash, and
each block is broadcast; a text meets all blocks one after the other in one pass. Nothing is shuffled.

Defined cases: null and empty texts and items, and items of punctuation alone, match nothing; items of one to six
words match exactly (their budget is 0), and a caller can leave out those under ``min_words``; equal items with
different ids all match; repeated rows match alike; empty tables give an empty table; extra columns are not
read, and ``drop_contaminated`` gives all columns back as they were, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm import words as K
from sentiscope.llm.common import table, text_bytes, units, whole_row

ERROR = 0.15
MIN_WORDS = 1
#: Text of the items that are broadcast at once, about.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
#: Pieces of this many words and more are scanned for together.
_LONG_PIECE = 4


def plain(texts: pa.Array) -> pa.Array:
    """Texts as their plain words: NFKC, lower case, blanks for punctuation and symbols."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.utf8_normalize(texts, "NFKC")), pattern=r"[\pP\pS]+", replacement=" ")


def budget(words: int, error: float = ERROR) -> int:
    return int(error * words)


def split(words: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) of ``parts`` pieces of nearly equal length."""
    cuts = [words * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


class Probe:
    """The keys of pieces, (item, start, end): the first words of each, as many as the shortest has."""

    def __init__(self, items: list, cuts: list[tuple[int, int, int]]):
        self.width = min(b - a for _, a, b in cuts)
        keys = np.array([K.windows(items[n][1][a:a + self.width], self.width)[0] for n, a, _ in cuts], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.array([n for n, _, _ in cuts], np.int64)[order]
        self.offset = np.array([a for _, a, _ in cuts], np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, first: np.ndarray, h: np.ndarray) -> set[tuple[int, int, int]]:
        at = K.inside(first, len(h), self.width)
        key = K.windows(h, self.width)[at] if len(at) else np.zeros(0, np.uint64)
        good = self.filter[key >> np.uint64(64 - _FILTER_BITS)]
        at, key = at[good], key[good]
        low = np.searchsorted(self.keys, key, side="left")
        count = np.searchsorted(self.keys, key, side="right") - low
        at, low = np.repeat(at, count), np.repeat(low, count)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        piece = low + turn
        row = np.searchsorted(first, at, side="right") - 1
        return set(zip(row.tolist(), self.item[piece].tolist(), (at - self.offset[piece]).tolist()))


class Items:
    """One block of items: the words of each, and the keys of their pieces."""

    def __init__(self, ids: list, texts: list[str], error: float, min_words: int):
        first, _, _, h, _ = K.words(plain(pa.array(texts, pa.string())))
        self.items = [(i, h[a:b], budget(b - a, error))
                      for i, a, b in zip(ids, first[:-1], first[1:]) if b - a >= min_words]
        kinds: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, w, k) in enumerate(self.items):
            cut = split(len(w), k + 1)
            kinds.setdefault(min(_LONG_PIECE, *(b - a for a, b in cut)), []).extend((n, a, b) for a, b in cut)
        self.probes = [Probe(self.items, kinds[x]) for x in sorted(kinds)]
        self.masks: dict[int, dict[int, int]] = {}

    def hits(self, first: np.ndarray, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word at which the item would start) for every exact piece hit."""
        return set().union(*(p.hits(first, h) for p in self.probes))

    def mask(self, n: int) -> dict[int, int]:
        if n not in self.masks:
            made: dict[int, int] = {}
            for bit, w in enumerate(self.items[n][1].tolist()):
                made[w] = made.get(w, 0) | 1 << bit
            self.masks[n] = made
        return self.masks[n]


def best_distance(mask: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(distance, end): least edit distance of the pattern to any part of the text, and
    where that part ends (the first such place)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for n, w in enumerate(text, 1):
        eq = mask.get(w, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise = down | ~(across | up) & full
        fall = up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        if score < best:
            best, end = score, n
    return best, end


def matches(block: Items, first: np.ndarray, h: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (distance, end word) of the verified matches in the words of a piece of a column."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for row, n, start in sorted(block.hits(first, h)):
        if found.get((row, n), (1, 0))[0] == 0:  # a later start has no earlier end
            continue
        _, w, k = block.items[n]
        lo, hi = max(int(first[row]), start - k), min(int(first[row + 1]), start + len(w) + k)
        d, end = best_distance(block.mask(n), len(w), h[lo:hi].tolist())
        place = lo - int(first[row]) + end
        if d <= k and (d, place) < found.get((row, n), (k + 1, 0)):
            found[row, n] = d, place
    return found


def _scan(blocks):
    def scan(batches):
        for batch in batches:
            for piece in K.pieces(batch):
                first, _, _, h, _ = K.words(plain(piece.column("text")))
                for block in blocks:
                    if found := matches(block.value, first, h):
                        yield pa.RecordBatch.from_arrays([
                            piece.column("doc_id").take(pa.array([r for r, _ in found])),
                            pa.array([block.value.items[n][0] for _, n in found], pa.int64()),
                            pa.array([d for d, _ in found.values()], pa.int32()),
                            pa.array([e for _, e in found.values()], pa.int32())],
                            names=["doc_id", "item_id", "distance", "end_word"])
    return scan


def _clean(blocks):
    def clean(batches):
        for batch in batches:
            for piece in K.pieces(batch):
                first, _, _, h, _ = K.words(plain(piece.column("text")))
                stay = np.ones(piece.num_rows, bool)
                for block in blocks:
                    stay[[r for r, _ in matches(block.value, first, h)]] = False
                yield piece.select(["row"]).filter(pa.array(stay))
    return clean


def item_blocks(benchmark: DataFrame, error: float, min_words: int) -> list:
    """The items, in broadcast blocks of bounded size."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct())
    blocks, out = units(text_bytes(items), 1, BLOCK_BYTES), []
    for n in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(
            Items([r.item_id for r in mine], [r.text for r in mine], error, min_words)))
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` (plain words) and ``end_word`` (the plain word after which the best match
    ends), a row for each document row and item that it holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scan(item_blocks(benchmark, error, min_words)), "doc_id long, item_id long, distance int, end_word int")


def documents_per_item(found: DataFrame) -> DataFrame:
    """``item_id`` and the number of document rows that hold it: shows items too short or common to mean anything."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    rows = docs.select(whole_row(docs).alias("row"))
    kept = rows.select("row", "row.text").mapInArrow(_clean(item_blocks(benchmark, error, min_words)), rows.schema)
    return kept.select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds within the error budget."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
